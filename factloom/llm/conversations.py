"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate.

A conversation is a lattice of (turns read, what was kept last); keeping, re-roling, deleting and
inserting are its edges. A search from each end meets in the middle, and goes on until no crossing of
equal cost is left unseen. Of the cheapest ways the one whose letters come first is taken.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.duck import CRC_TABLE, crc32
from factloom.llm.frames import cut, merge_join, small_batches

#: White space as strings end with it: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
#: What was kept last: nothing, a system turn, a user turn, an assistant turn; and the role initials that may follow.
FOLLOW = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that an edit may write after each of them.
WRITES = ("u", "u", "a", "u")
ENDS = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
_FAR = 1 << 60


def _out(codes: str, node: int) -> Iterator[tuple[str, int, int]]:
    """Edges (letter, node, cost) that leave a node, letters in order. Node 4 * i + k has read i turns."""
    i, k = divmod(node, 4)
    code = codes[i] if i < len(codes) else None
    written = FOLLOW[k][WRITES[k]]
    if code:
        yield "D", node + 4, DELETE
    yield "I", 4 * i + written, INSERT
    if code and code != "-":
        extra = CUT_OFF if code.isupper() else 0
        kept = FOLLOW[k].get(code.lower())
        if kept is not None:
            yield "K", 4 * i + 4 + kept, KEEP + extra
        yield "R", 4 * i + 4 + written, REROLE + extra


def _into(codes: str, node: int) -> Iterator[tuple[int, int]]:
    """Edges (node, cost) that lead to a node."""
    i, k = divmod(node, 4)
    for before in range(4):
        if FOLLOW[before][WRITES[before]] == k:
            yield 4 * i + before, INSERT
    if i:
        code = codes[i - 1]
        yield node - 4, DELETE
        if code != "-":
            extra = CUT_OFF if code.isupper() else 0
            for before in range(4):
                if FOLLOW[before].get(code.lower()) == k:
                    yield 4 * i - 4 + before, KEEP + extra
                if FOLLOW[before][WRITES[before]] == k:
                    yield 4 * i - 4 + before, REROLE + extra


def cheapest(codes: str) -> tuple[int, str]:
    """Least cost and, of the ways of that cost, the one whose letters are least in ASCII order.

    A code is a turn's role initial, `x` for any other than s, u, a, in upper case if the turn is cut off;
    `-` is a turn that must go. Two ways of equal letters are one way, since the role that an edit writes
    follows from what stands before it. Memory is some 80 bytes a turn.
    """
    size = 4 * len(codes) + 4
    dist = [array("q", [_FAR]) * size, array("q", [_FAR]) * size]
    done = [bytearray(size), bytearray(size)]
    heaps = [[(0, 0)], [(0, size - 4 + k) for k in ENDS]]
    for side in (0, 1):
        for d, node in heaps[side]:
            dist[side][node] = d
    best = _FAR
    while all(heaps) and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = int(heaps[1][0] < heaps[0][0])
        d, node = heapq.heappop(heaps[side])
        if done[side][node]:
            continue
        done[side][node] = 1
        own, other = dist[side], dist[1 - side]
        best = min(best, d + other[node])
        for to, cost in ((e[1:] for e in _out(codes, node)) if side == 0 else _into(codes, node)):
            if d + cost < own[to]:
                own[to] = d + cost
                heapq.heappush(heaps[side], (d + cost, to))
                best = min(best, d + cost + other[to])
    ahead, behind = dist
    for k in ENDS:
        done[1][size - 4 + k] = 1  # the way there from itself is known
    # the forward half of every cheapest way, marked from the crossings back
    reaches, stack = bytearray(size), []
    for node in range(size):
        if done[0][node] and (done[1][node] and ahead[node] + behind[node] == best or any(done[1][to] and ahead[node] + cost + behind[to] == best for _, to, cost in _out(codes, node))):
            reaches[node] = 1
            stack.append(node)
    while stack:
        node = stack.pop()
        for before, cost in _into(codes, node):
            if done[0][before] and not reaches[before] and ahead[before] + cost == ahead[node]:
                reaches[before] = 1
                stack.append(before)
    letters, node, spent = [], 0, 0
    while not (spent == best and node >= size - 4 and node - size + 4 in ENDS):
        for letter, to, cost in _out(codes, node):
            at = spent + cost
            if done[1][to] and at + behind[to] == best or done[0][to] and reaches[to] and at == ahead[to]:
                letters.append(letter)
                node, spent = to, at
                break
        else:
            raise AssertionError("a cheapest way breaks off")
    return best, "".join(letters)


_remembered = lru_cache(maxsize=100_000)(cheapest)


def plan(codes: str) -> tuple[int, str]:
    """cheapest(), remembered for short conversations."""
    return _remembered(codes) if len(codes) <= 64 else cheapest(codes)


def _text(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(" "))


def damaged(rows: DataFrame, kinds: int = 20) -> DataFrame:
    """(conv_id, turn, role, text, gone): turns with faults put in by crc32 of `conv_id:turn` modulo `kinds`:
    0 drops the turn (`gone` keeps its conversation in sight), 1 empties it, 2 takes `.!?` out, 3 repeats
    it, 4 makes it a user's. Nulls in the hashed text, in roles and texts are one space."""
    kind = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn"))) % kinds
    text = F.when(kind == 1, "").when(kind == 2, F.translate(_text("text"), ".!?", "")).otherwise(_text("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(_text("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), times.alias("_")).drop("_")


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows as both passes sort them: `held` names role and text, so turns of one number stand alike in both."""
    text = F.col("text")
    core = F.rtrim(text, F.lit(BLANKS))
    blank = core == ""
    held = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", text), 256))
    return rows.select("conv_id", "turn", "role", "text", "gone", held.alias("held"), blank.alias("blank"), (~blank & ~F.right(core, F.lit(1)).isin(".", "!", "?")).alias("cut_off"))


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def repair_plans(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation.

    `rows` is (conv_id, turn, role, text, gone); turns are taken by number, nulls first, equal numbers by
    role and a hash of the text; `gone` turns only name their conversation. A turn's first fault counts:
    blank, a repeat of an earlier role and text, cut off (no `.!?` at its end). Null ids are one
    conversation. Texts stay out of the shuffle: a turn takes some 60 bytes there, and a task holds some
    200 bytes a turn of one conversation.
    """
    small_batches(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    few = _ordered(rows).select("conv_id", F.col("turn").cast("long").alias("turn"), F.substring("role", 1, 1).alias("initial"), "role", "held", "blank", "cut_off", "gone")
    few = few.repartition("conv_id").sortWithinPartitions("conv_id", "gone", "turn", "role", "held").drop("role")

    def tell(batches):
        def row():
            first = turns[0] if turns else 0
            gaps = turns[1] - first + 1 - turns[2] if turns else 0
            return (conv, gaps, *faults, illegal, *plan("".join(codes)))

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

        schema, out = None, []
        conv, begun = None, False
        for batch in batches:
            if schema is None:
                longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
                schema = pa.schema([("conv_id", batch.schema.field(0).type), *((n, pa.int64()) for n in longs), ("audit", pa.string())])
            for key, turn, initial, held, blank, cut_off, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or key != conv:
                    if begun:
                        out.append(row())
                    conv, begun = key, True
                    turns, faults, illegal, codes, seen, last = [], [0, 0, 0], 0, [], set(), None
                if gone:
                    continue
                if turn is not None:
                    if not turns:
                        turns = [turn, turn, 1]
                    elif turn != turns[1]:
                        turns[1:] = [turn, turns[2] + 1]
                illegal += last is not None and last + initial not in ("su", "ua", "au")
                last = initial
                code = initial if initial in ("s", "u", "a") else "x"
                if blank or held in seen:
                    faults[0 if blank else 1] += 1
                    code = "-"
                elif cut_off:
                    faults[2] += 1
                    code = code.upper()
                seen.add(held)
                codes.append(code)
            if len(out) >= 2000:
                yield batch_of(out)
                out = []
        if begun:
            out.append(row())
        if out:
            yield batch_of(out)

    return few.mapInArrow(tell, f"conv_id {kind}, {SUMMARY}")


def repaired_turns(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text) of the turns that the plans keep, write or insert, places from 0.

    The turns of a conversation come one after another in order. A task reads them in a stream, behind
    the letters of their plan; it holds those and one batch of turns.
    """
    small_batches(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    turns = _ordered(rows).where("NOT gone").select("conv_id", F.lit(1).alias("step"), F.col("turn").cast("long").alias("turn"), "role", "held", "text")
    heads = plans.select("conv_id", F.lit(0).alias("step"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("held"), F.col("audit").alias("text"))
    both = heads.union(turns).repartition("conv_id").sortWithinPartitions("conv_id", "step", "turn", "role", "held").drop("turn", "held")

    def write(batches):
        conv, letters, at, place, state = None, "", 0, 0, 0

        def inserted():
            nonlocal at, place, state
            while at < len(letters) and letters[at] == "I":
                out.append((conv, place, "I", NAMES[WRITES[state]], ""))
                at, place, state = at + 1, place + 1, FOLLOW[state][WRITES[state]]

        def batch_of(id_type):
            types = (id_type, pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["conv_id", "place", "edit", "role", "text"])

        out, id_type = [], None
        for batch in batches:
            out, id_type = [], batch.schema.field(0).type
            for key, step, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                inserted()
                if step == 0:
                    conv, letters, at, place, state = key, text, 0, 0, 0
                    continue
                letter, at = letters[at], at + 1
                if letter != "D":
                    initial = role[:1] if letter == "K" else WRITES[state]
                    out.append((conv, place, letter, role if letter == "K" else NAMES[initial], text))
                    place, state = place + 1, FOLLOW[state][initial]
            yield batch_of(id_type)
        out = []
        inserted()
        if out:
            yield batch_of(id_type)

    return both.mapInArrow(write, f"conv_id {kind}, place long, edit string, role string, text string")


def text_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the lines `role:text` of conversations whose turns come together and in order, as
    repaired_turns gives them. The hash takes turn after turn, so no conversation is held."""
    import hashlib

    kind = turns.schema["conv_id"].dataType.simpleString()

    def digest(batches):
        conv, held, keys, sums, kind_of = None, None, [], [], None
        for batch in batches:
            kind_of = batch.schema.field(0).type
            for key, place, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place == 0:
                    if held is not None:
                        keys.append(conv)
                        sums.append(held.hexdigest())
                    conv, held = key, hashlib.sha256()
                else:
                    held.update(b"\n")
                held.update(f"{role}:{text}".encode())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, kind_of), pa.array(sums, pa.string())], ["conv_id", "sha256"])
                keys, sums = [], []
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind_of), pa.array([held.hexdigest()])], ["conv_id", "sha256"])

    return turns.select("conv_id", "place", "role", "text").mapInArrow(digest, f"conv_id {kind}, sha256 string")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired texts of all conversations, damaged first."""
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    plans = cut(repair_plans(rows))
    sums = text_digests(repaired_turns(rows, plans)).withColumnRenamed("conv_id", "of")
    joined = plans.join(sums.hint("merge"), F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    return joined.withColumn("repaired_sha256", F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256))).drop("sha256")


def _step(state: str, cost: str, letter: str) -> str:
    """SQL of a way (eight digits of cost, then letters) after one more edit."""
    return f"(printf('%08d', substr({state}, 1, 8)::INT + {cost}) || substr({state}, 9) || '{letter}')"


def _least(*ways: str) -> str:
    return f"least({', '.join(ways)})"


_CLOSED = f"SELECT conv_id, pos, s0, s1, s2, {_least('s3', _step('s2', '3', 'I'))} AS s3 FROM (SELECT conv_id, pos, s0, s1, {_least('s2', *(_step(s, '3', 'I') for s in ('s0', 's1', 's3')))} AS s2, s3 FROM walk)"


def _kept(initial: str, state: str) -> str:
    return f"CASE WHEN must = 0 AND initial = '{initial}' THEN {_step(state, 'extra', 'K')} END"


def _written(state: str) -> str:
    return f"CASE WHEN must = 0 THEN {_step(state, '3 + extra', 'R')} END"


OP11_SQL = rf"""
WITH RECURSIVE {CRC_TABLE}, keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS txt, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h FROM conversations
), kinds AS (
  SELECT conv_id, turn, role, txt, {crc32('h')} % 20 AS kind FROM keyed, tab
), broken AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(txt, '.!?', '') ELSE txt END AS txt,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds
), placed AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || txt)) AS pos,
         rtrim(txt, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core FROM broken
), judged AS (
  SELECT *, core = '' AS blank, core <> '' AND row_number() OVER (PARTITION BY conv_id, role, txt ORDER BY pos) > 1 AS again FROM placed
), codes AS (
  SELECT *, (blank OR again)::INT AS must, NOT blank AND NOT again AND right(core, 1) NOT IN ('.', '!', '?') AS cut_off, CASE WHEN right(core, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS extra,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS two FROM judged
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again) AS duplicate,
         count(*) FILTER (WHERE cut_off) AS truncated, count(*) FILTER (WHERE two NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM codes GROUP BY conv_id
), walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, '00000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM conversations
  UNION ALL
  SELECT w.conv_id, c.pos, {_step('s0', '4', 'D')}, {_least(_step('s1', '4', 'D'), _kept('s', 's0'))},
         {_least(_step('s2', '4', 'D'), *(_kept('u', s) for s in ('s0', 's1', 's3')), *(_written(s) for s in ('s0', 's1', 's3')))},
         {_least(_step('s3', '4', 'D'), _kept('a', 's2'), _written('s2'))}
  FROM ({_CLOSED}) w JOIN codes c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND c.pos = w.pos + 1
), ended AS (
  SELECT w.conv_id, least(w.s0, w.s3) AS way, t.* EXCLUDE (conv_id) FROM ({_CLOSED}) w LEFT JOIN counted t ON w.conv_id IS NOT DISTINCT FROM t.conv_id WHERE w.pos = coalesce(t.n, 0)
), letters AS (
  SELECT conv_id, unnest(range(1, length(way) - 7)) AS k, substr(way, (k + 8)::INT, 1) AS l FROM ended
), edits AS (
  SELECT conv_id, k, l, sum((l <> 'I')::INT) OVER w AS pos, sum((l <> 'D')::INT) OVER w AS o FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)
), lines AS (
  SELECT e.conv_id, e.k, e.o, c.role, c.txt, e.l, max((e.o = 1 AND e.l = 'K' AND c.initial = 's')::INT) OVER (PARTITION BY e.conv_id) AS led
  FROM edits e LEFT JOIN codes c ON e.l <> 'I' AND e.conv_id IS NOT DISTINCT FROM c.conv_id AND e.pos = c.pos WHERE e.l <> 'D'
), texts AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN l = 'K' THEN role WHEN (o - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN l = 'I' THEN '' ELSE txt END, chr(10) ORDER BY k)) AS sum FROM lines GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       substr(way, 1, 8)::BIGINT AS cost, substr(way, 9) AS audit, coalesce(t.sum, sha256('')) AS repaired_sha256
FROM ended e LEFT JOIN texts t ON e.conv_id IS NOT DISTINCT FROM t.conv_id
"""
