"""What several of the operators share: words, many-to-one joins with hot keys, runs of sorted keys."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Below this many rows a key is never hot; at most HOT_KEYS keys are.
HOT_ROWS = 1000
HOT_KEYS = 2000
SPREAD = 4096

# A-Z become a-z; every ASCII character that is neither a digit nor a letter becomes a space.
_WORD_BYTES = bytes(
    c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: bytes | None) -> list[bytes]:
    """The lower-case words of a UTF-8 text: runs of digits, letters and characters beyond ASCII."""
    return text.translate(_WORD_BYTES).split() if text else []


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A text column as UTF-8 bytes, without decoding it."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_by_size(left: DataFrame, right: DataFrame, key: str, size: str, salt: Column) -> DataFrame:
    """``left`` with the columns of ``right``, which has one row per ``key`` (left join, null-free keys).

    ``right[size]`` must be the number of left rows of the key. The keys that hold at least a
    2000th of all rows are at most 2000; their rows of ``right`` are broadcast. The left rows they
    serve leave the shuffle's hash of the key by ``salt`` (a number per left row), so no task gets
    a hot key. ``right`` should be a written table: it is read three times.
    """
    total = right.agg(F.sum(size)).first()[0] or 0
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    others = [c for c in right.columns if c != key]
    hot = right.where(F.col(size) >= least).select(F.col(key).alias("_hot_key"), F.struct(*others).alias("_hot"))
    cold = right.where(F.col(size) < least).select(
        F.col(key).alias("_cold_key"), F.lit(0).cast("long").alias("_cold_salt"), F.struct(*others).alias("_cold")
    )
    rows = left.join(F.broadcast(hot), left[key] == F.col("_hot_key"), "left").withColumn(
        "_salt", F.when(F.col("_hot_key").isNull(), F.lit(0)).otherwise(F.pmod(salt, F.lit(SPREAD)) + 1).cast("long")
    )
    both = rows.join(cold, (F.col(key) == F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt")), "left")
    found = F.coalesce(F.col("_hot"), F.col("_cold"))
    return both.select(*[F.col(c) for c in left.columns], *[found[c].alias(c) for c in others])


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, from batches that are sorted by the integer column ``key``."""
    pending: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            if pending and keys[start] != last:
                yield pa.Table.from_batches(pending).combine_chunks()
                pending = []
            pending.append(batch.slice(start, end - start))
            last = keys[start]
    if pending:
        yield pa.Table.from_batches(pending).combine_chunks()


def give_back() -> None:
    """Hand memory that Python and Arrow have freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` over batches. A Python worker outlives its task, so the task gives its memory back."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        give_back()

    return run


def one_chunk(column: pa.ChunkedArray) -> pa.Array:
    combined = column.combine_chunks()
    return combined.chunk(0) if isinstance(combined, pa.ChunkedArray) else combined


def list_matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def list_slices(column: pa.Array) -> list[np.ndarray]:
    """A list column as one array per row."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(values, ends[:-1]) if len(ends) else []
