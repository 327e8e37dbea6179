"""Pieces of DuckDB SQL that several counterparts need."""

#: A table `tab` of one row: `t` holds the 256 steps of crc32 (the polynomial is a fixed value).
CRC_TABLE = "tab AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def crc32(hexed: str) -> str:
    """Unsigned crc32 of the bytes in a column of hexadecimal text, beside `tab`."""
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length({hexed}) // 2), lambda i: ('0x' || substr({hexed}, 2 * i + 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"
