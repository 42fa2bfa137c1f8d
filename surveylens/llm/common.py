"""Helpers shared by the operators: column selection, Arrow text slices, checkpoints."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from surveylens.session import ensure_checkpoint_dir

#: Text bytes that one numpy step works on; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


#: Rows of an Arrow batch between Spark and Python: texts are long.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, in which whole texts travel."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` with null text as the empty string; other columns go,
    so that names that clash with an operator's own columns do no harm."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def counted(df: DataFrame, *conditions: Column) -> tuple:
    """``df`` as ``cut_lineage`` gives it, its number of rows, and of rows that meet each of the
    ``conditions``: counted while it is written, without a job or a shuffle of their own."""
    seen = Observation()
    sums = [F.count_if(c).alias(f"n{i}") for i, c in enumerate(conditions)]
    df = cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("n"), *sums))
    return df, seen.get["n"], *(seen.get[f"n{i}"] for i in range(len(conditions)))


#: Ids (eight bytes each, several times that in a hash table) that a task may get as a broadcast.
BROADCAST_IDS = 1 << 18
#: Rows of one key beyond which a join treats it by itself.
HOT_ROWS = 1 << 10


def is_few(ids: DataFrame) -> bool:
    """Whether ``ids`` has so few rows that it may be a broadcast."""
    return ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS


def _by_id(df: DataFrame, ids: DataFrame, column: str, how: str, n: int | None) -> DataFrame:
    """Join with the distinct ``ids``, under a name that ``df`` does not have; up to
    ``BROADCAST_IDS`` of them (``n``, or counted) go to the rows as a broadcast, more are shuffled."""
    name = "_id"
    while name in df.columns:
        name += "_"
    ids = ids.select(F.col(ids.columns[0]).cast("long").alias(name))
    few = is_few(ids) if n is None else n <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, F.col(column).cast("long") == F.col(name), how)


def rows_with_ids(df: DataFrame, ids: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Rows of ``df`` whose ``column`` is among the distinct ``ids``."""
    return _by_id(df, ids, column, "left_semi", n)


def rows_without_ids(df: DataFrame, ids: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Rows of ``df`` whose ``column`` is not among the distinct ``ids``, or null."""
    return _by_id(df, ids, column, "left_anti", n)


def join_hot(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``left`` with the one row of ``right`` (or none) that has its ``key``. The keys in ``hot``, each
    of which has many rows of ``left``, are few: their rows stay where they are and get the
    right side as a broadcast. Should they be too many, the join is an ordinary one, which AQE can split."""
    hot, n = counted(hot)
    if not 0 < n <= BROADCAST_IDS:
        return left.join(right, key, "left")
    of_hot = F.broadcast(hot.join(right, key, "left"))
    return left.join(of_hot, key).unionByName(left.join(F.broadcast(hot), key, "left_anti").join(right, key, "left"))


def shards_for(n_rows: int, per_shard: int) -> int:
    return max(1, math.ceil(n_rows / per_shard))


def utf8_flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column as one byte array and their offsets (n + 1)."""
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    if data is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]]
    return flat, offsets - offsets[0]


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text",
                slice_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most ``slice_bytes`` of text
    (or one row): what numpy builds per slice stays bounded."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.diff(utf8_flat(batch.column(batch.schema.get_field_index(column)))[1])
        start, size = 0, 0
        for i, s in enumerate(sizes.tolist()):
            if i > start and size + s > slice_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += s
        yield batch.slice(start)


def runs(flat: np.ndarray, inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of bytes that are ``inside``; the borders of
    texts part runs too."""
    border = np.zeros(len(flat) + 1, bool)
    border[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    begin = np.flatnonzero(inside & (~before | border[:-1]))
    return begin, np.flatnonzero(inside & (~after | border[1:])) + 1


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over a uint64 array."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
