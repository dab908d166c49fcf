"""What several operators share: words, Arrow plumbing, label folds and table reading."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Largest number of keys that is hinted for broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 500_000
#: Largest Arrow batch that goes to Python, so that long texts do not add up in a worker.
BATCH_BYTES = 8 << 20

WORD_BREAKS = bytes([0x20, *range(0x09, 0x0E)])
#: UTF-8 continuation bytes: all other bytes begin a code point.
CONTINUATION = bytes(range(0x80, 0xC0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    values = batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()
    return [v or b"" for v in values]


def code_points(raw: bytes) -> int:
    return len(raw.translate(None, CONTINUATION))


def map_arrow(df: DataFrame, fn: Callable, schema: StructType) -> DataFrame:
    """`mapInArrow` with batches bounded by bytes as well as by rows (a setting of the session)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict] | dict], schema: str
) -> DataFrame:
    """Per Arrow batch: a dict of output columns. Only what `df` selects crosses to Python."""
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield to_batch(fn(batch), arrow)

    return map_arrow(df, run, out)


def to_batch(columns: dict, arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
            for f in arrow
            for c in [columns[f.name]]
        ],
        schema=arrow,
    )


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def with_labels(docs: DataFrame, labels: DataFrame, label: str, keep: Column) -> DataFrame:
    """Rows of `docs` whose id has a label, restricted to the ids that `keep` allows.

    Labels are one row per id (the largest wins where they are repeated). Few labels travel to
    the documents; many are joined by a shuffle.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & keep)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )
    if known.count() <= BROADCAST_KEYS:
        known = F.broadcast(known)
    return docs.join(known, "doc_id")


def keep_ids(docs: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """`docs` semi- or anti-joined with distinct `ids`; broadcast only when they are few."""
    small = ids.count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(ids) if small else ids, key, how)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))
