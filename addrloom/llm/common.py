"""What the operators of this subpackage share: reading tables, the shared folder and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_MADE: list[list[DataFrame]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset and Spark runs on one machine (tests) a
    fresh local one. On a cluster it must be set."""
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='addrloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts the lineage without one-copy blocks."""
    path = fresh_path(df.sparkSession, label)
    schema = df.schema
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out.written_to = path
    for made in _MADE[-1:]:
        made.append(out)
    return out


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Lists the tables that `materialise` writes inside, so that those of no more use can be discarded."""
    _MADE.append([])
    try:
        yield _MADE[-1]
    finally:
        _MADE.pop()


def discard(df: DataFrame) -> None:
    """Deletes a table that `materialise` has written, once nothing reads it any more."""
    hadoop_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
    hadoop_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def _slots(ids, bits: int):
    """A number of so many bits for each id of an Arrow array."""
    return (ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def maybe_among(ids: DataFrame, most_bits: int = 26) -> Callable[[pa.Array], pa.Array]:
    """ids: a written table of one long column. A test of Arrow arrays that is true for each of its ids, and by chance for a few others: joins
    with the table need only the rows that pass. A bitmap of 16 bits an id, 8 MB at most, goes to the workers; null counts as 0."""
    bits = max(10, min(most_bits, (16 * ids.count()).bit_length()))

    def words(batches):
        for b in batches:
            slots = np.unique(_slots(b.column(0), bits))
            word, at = np.unique(slots >> np.uint64(6), return_inverse=True)
            marks = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(marks, at, np.uint64(1) << (slots & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(marks.view(np.int64))], names=["word", "marks"])

    found = ids.select(F.coalesce(F.col(ids.columns[0]), F.lit(0)).cast("long").alias("id")).mapInArrow(words, "word long, marks long")
    found = found.groupBy("word").agg(F.bit_or("marks").alias("marks")).toArrow()
    bitmap = np.zeros(1 << bits - 6, np.uint64)
    bitmap[found["word"].to_numpy()] = found["marks"].to_numpy().view(np.uint64)

    def among(x: pa.Array) -> pa.Array:
        slots = _slots(x.fill_null(0), bits)
        return pa.array(bitmap[slots >> np.uint64(6)] >> (slots & np.uint64(63)) & np.uint64(1) == 1)

    return among


def maybe_in(ids: DataFrame, column: Column) -> Column:
    """`maybe_among` of a column of longs."""
    among = maybe_among(ids)

    @F.arrow_udf("boolean")
    def test(x: pa.Array) -> pa.Array:
        return among(x)

    return test(column.cast("long"))


def release() -> None:
    """Gives memory that a task of a Python worker has freed back to the machine; workers live on between tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_KEPT: dict = {}


def kept(key, make):
    """What a Python worker keeps between tasks under a key, made where it is missing. A worker keeps one thing at a time."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drops what tasks of another operator have left in this Python worker, as tasks of several stages share an executor's memory."""
    if _KEPT:
        _KEPT.clear()
        release()


def keep_rows(df: DataFrame, text: str, make_mask, group_bytes: int = 4 << 20) -> DataFrame:
    """The rows of df, with all their columns, for which a mask over groups of texts is true. make_mask() is called once a task and
    returns a function from a list of texts, as bytes, to their verdicts. Nothing is shuffled."""
    place = df.columns.index(text)

    def run(batches):
        forget()
        mask = make_mask()
        for batch in batches:
            keep, group, size, x = [], [], 0, None
            for x in batch.column(place).cast(pa.large_binary()):
                group.append(x.as_py() or b"")
                size += len(group[-1])
                if size >= group_bytes:
                    keep += mask(group)
                    group, size = [], 0
            keep += mask(group) if group else []
            yield batch.filter(pa.array(keep, pa.bool_()))
            del batch, group, x
        del mask
        release()

    return df.mapInArrow(run, df.schema)
