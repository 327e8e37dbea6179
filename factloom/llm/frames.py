"""Tables written between jobs, in the folder that the cluster shares, and joins that stay small."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import arrays


def shared_dir(spark: SparkSession) -> str:
    """Folder of spark.checkpoint.dir. Where that is unset a local master gets a temporary one; a cluster
    has no folder of its own that executors share, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, *by: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder, in a folder for each value of the columns `by`, and read
    it back: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete tables made by cut() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_written_at", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def forgotten_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query are deleted as soon as it has ended, not when the driver happens
    to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of at most `size` from here on, so that long texts don't swell Python workers, and
    large arrays that a worker gives back to the system as soon as they are freed."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    for name, value in (("MALLOC_MMAP_THRESHOLD_", "1048576"), ("MALLOC_TRIM_THRESHOLD_", "1048576"), ("MALLOC_ARENA_MAX", "2")):
        spark.sparkContext.environment.setdefault(name, value)


def merge_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the input: never by a broadcast, skewed keys are split at run time."""
    return left.join(right.hint("merge"), on, how)


def _low(values: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of a hash, so that ids which differ in their high bits only stand apart too."""
    return arrays.mix(values) & np.uint64((1 << bits) - 1)


def bit_set(rows: DataFrame, col: str, bits: int) -> np.ndarray:
    """One bit for each hashed value of a long column: a set of fixed size that may hold more values than
    the column, but none less."""

    def run(batches):
        for batch in batches:
            low = np.unique(_low(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array((low >> np.uint64(6)).view(np.int64)), pa.array((np.uint64(1) << (low & np.uint64(63))).view(np.int64))], ["at", "bit"])

    words = rows.select(col).mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << bits - 6, np.uint64)
    out[words["at"].to_numpy()] = words["bit"].to_numpy().view(np.uint64)
    return out


def maybe(values: np.ndarray, found: np.ndarray | None) -> np.ndarray:
    """Whether each unsigned value may be in the bit set; without one all are."""
    if found is None:
        return np.ones(len(values), bool)
    low = _low(values, (64 * len(found)).bit_length() - 1)
    return (found[low >> np.uint64(6)] >> (low & np.uint64(63)) & np.uint64(1)).astype(bool)


ALONE, LEADS, TOLD = 0, 1, 2


def shared(rows: DataFrame, key: str, other: str) -> DataFrame:
    """The rows whose `key` stands beside two or more values of `other`. Both are longs, `key` may be an
    array of them, which gives a row for each.

    One shuffle by key. Each batch settles what it can before: of a key that it holds with two values,
    only one row goes to the key's task, marked as shared, and the others are dealt evenly. So a key of a
    third of all rows costs its task one row a batch. Rows with a null in either column are left out.
    """
    schema = rows.schema
    fields = [f"`{f.name}` {'bigint' if f.name == key else f.dataType.simpleString()}" for f in schema.fields]
    names = [f.name for f in schema.fields]

    def flat(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(names.index(key))
        if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
            rest = batch.take(pc.list_parent_indices(column))
            batch = pa.RecordBatch.from_arrays([column.flatten() if n == key else rest.column(i) for i, n in enumerate(names)], names)
        return batch.filter(pc.and_(pc.is_valid(batch.column(names.index(key))), pc.is_valid(batch.column(names.index(other)))))

    def settle(batches):
        for batch in map(flat, batches):
            if not batch.num_rows:
                continue
            k, o = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in (key, other))
            order = np.lexsort((o, k))
            k, o = k[order], o[order]
            head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            many = o[head] != o[np.append(head[1:], len(k)) - 1]
            state = np.repeat(np.where(many, TOLD, ALONE), np.diff(np.append(head, len(k)))).astype(np.int8)
            state[head[many]] = LEADS
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(order)).columns, pa.array(state)], [*names, "state"])

    def meet(batches):
        """Rows come by key, and what is told already is passed on."""
        waiting, known = None, None  # the open key's rows while they hold one value; the key, once it is known to be shared
        for batch in batches:
            if waiting is not None:
                batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
                waiting = None
            if not batch.num_rows:
                continue
            state = batch.column(len(names)).to_numpy(zero_copy_only=False)
            keep = state == TOLD
            at = np.flatnonzero(~keep)
            if len(at):
                k, o = (batch.column(names.index(c)).to_numpy(zero_copy_only=False)[at] for c in (key, other))
                head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                found = (np.minimum.reduceat(o, head) != np.maximum.reduceat(o, head)) | (np.maximum.reduceat(state[at], head) == LEADS) | (k[head] == known if known is not None else False)
                keep[at] = np.repeat(found, np.diff(np.append(head, len(k))))
                known = None
                if found[-1]:
                    known = k[-1]
                else:
                    waiting = batch.take(pa.array(at[head[-1] :]))
            if keep.any():
                out = batch.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays(out.columns[:-1], names)

    dealt = rows.mapInArrow(settle, ", ".join([*fields, "state byte"]))
    place = F.when(F.col("state") == TOLD, F.xxhash64(key, other)).otherwise(F.col(key))
    return dealt.repartition(place).sortWithinPartitions(key, "state", other).mapInArrow(meet, ", ".join(fields))
