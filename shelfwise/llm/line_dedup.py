"""Line dedup: levelled sorted runs of line keys.

A line's key is the line without white space at its ends, A-Z lowered, as a 128-bit hash. Batches of
documents arrive one after the other. A run is a table of (key, number of documents), bucketed and
sorted by key, so that runs meet by merging, without a shuffle:

1. a batch is counted (each document once a key, first within its tasks);
2. keys that some run already holds as common are anti-joined away, as more counts tell nothing new;
3. the rest becomes a run of level 0. A level with `FAN_OUT` runs is compacted to one run of the next:
   counts are added, up to the number that makes a key common.

At the end all runs are compacted; lines with a common key go, in every document. The state of
earlier batches is never rewritten but by compaction, so a key is rewritten a logarithmic number of times.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from shelfwise.llm import text as tx
from shelfwise.llm.text import code_points, map_arrow, texts, to_batch
from shelfwise.scale import scratch_dir, written

FAN_OUT = 4
#: Batches that a table is dealt into when it is cleaned in one go.
BATCHES = 8
#: Keys a task counts before it hands them on.
FLUSH = 200_000
#: Counted keys, of all batches together, that make one more bucket.
BUCKET_ROWS = 200_000
SPACE = b" \t\n\x0b\x0c\r"


def key_of(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line; None for one that is too short to be dropped."""
    line = line.strip(SPACE).lower()  # bytes: A-Z only
    return xxhash.xxh3_128_digest(line) if code_points(line) >= min_chars else None


def keys_of(raw: bytes, min_chars: int) -> list[bytes | None]:
    return [key_of(line, min_chars) for line in raw.split(b"\n")]


def line_counts(docs: DataFrame, min_chars: int) -> DataFrame:
    """(batch, key, n_docs) of `batch` and `text`: partial counts of each task."""
    out = docs.sparkSession.createDataFrame([], "batch int, key binary, n_docs long").schema
    arrow = to_arrow_schema(out)

    def run(batches):
        held: dict[tuple[int, bytes], int] = {}

        def flush():
            part = {"batch": [b for b, _ in held], "key": [k for _, k in held], "n_docs": list(held.values())}
            return to_batch(part, arrow)

        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), texts(batch)):
                for k in set(keys_of(raw, min_chars)) - {None}:
                    held[b, k] = held.get((b, k), 0) + 1
                if len(held) >= FLUSH:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    return map_arrow(docs.select("batch", "text"), run, out)


def bucket_count(counts: DataFrame) -> int:
    """Buckets of the runs of `counts`: by its rows, at most the session's shuffle partitions.

    Each bucket of each run is a file, so more buckets than the keys need are many tiny files. Where the
    session forbids Spark to merge small partitions, its own number holds.
    """
    conf = counts.sparkSession.conf
    most = int(conf.get("spark.sql.shuffle.partitions"))
    if conf.get("spark.sql.adaptive.coalescePartitions.enabled") != "true":
        return most
    return min(most, max(1, -(-counts.count() // BUCKET_ROWS)))


class LineRuns:
    """Sorted runs of (key, n_docs) on levels; `add` takes a batch, `common` gives the common keys."""

    def __init__(self, spark: SparkSession, min_docs: int, fan_out: int = FAN_OUT, buckets: int | None = None):
        self.spark, self.min_docs, self.fan_out = spark, min_docs, fan_out
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []

    def _run(self, counts: DataFrame) -> DataFrame:
        """One run: a bucketed table in the shared folder, sorted within its files."""
        name = f"line_run_{uuid.uuid4().hex}"
        counts.write.bucketBy(self.buckets, "key").sortBy("key").option("path", scratch_dir(self.spark)).saveAsTable(name)
        return self.spark.table(name)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """Runs merged by key: a full outer merge join of each two neighbours, bucket by bucket.

        Results of joins are dealt by bucket again, so that each task of the last join writes one file.
        """
        n = F.least(F.coalesce("n_docs", F.lit(0)) + F.coalesce("n_more", F.lit(0)), F.lit(self.min_docs))
        while len(runs) > 1:
            pairs = [runs[i : i + 2] for i in range(0, len(runs), 2)]
            runs = [
                p[0].join(p[1].withColumnRenamed("n_docs", "n_more"), "key", "full_outer").select("key", n.alias("n_docs"))
                if len(p) == 2 else p[0]
                for p in pairs
            ]
            if len(runs) > 1:  # a full outer join's rows lie by bucket, but Spark does not know it
                runs = [r.repartition(self.buckets, "key") for r in runs]
        return runs[0]

    def add(self, counts: DataFrame) -> None:
        """Take a batch's (key, n_docs); keys may repeat."""
        fresh = counts.repartition(self.buckets, "key").groupBy("key").agg(
            F.least(F.sum("n_docs"), F.lit(self.min_docs)).alias("n_docs"))
        for run in (r for level in self.levels for r in level):
            fresh = fresh.join(run.where(F.col("n_docs") >= self.min_docs), "key", "left_anti")
        self._push(0, self._run(fresh))

    def _push(self, level: int, run: DataFrame) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan_out:
            whole = self._run(self._merged(self.levels[level]))
            self.levels[level] = []
            self._push(level + 1, whole)

    def common(self) -> DataFrame:
        """Keys of at least `min_docs` documents, one column, distinct."""
        runs = [r for level in self.levels for r in level]
        return self._merged(runs).where(F.col("n_docs") >= self.min_docs).select("key")


def common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = BATCHES) -> DataFrame:
    """(key) of the lines that at least `min_docs` rows of `docs` hold, by batches of its rows."""
    dealt = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"), "text")
    counts = written(line_counts(dealt, min_chars))
    runs = LineRuns(docs.sparkSession, min_docs, buckets=bucket_count(counts))
    for b in range(batches):
        runs.add(counts.where(F.col("batch") == b).select("key", "n_docs"))
    return written(runs.common())


def _cleaned(docs: DataFrame, min_chars: int, gone_of) -> DataFrame:
    """`docs` less the lines that `gone_of(batch)` names per row, with n_lines and n_dropped."""
    base = [f for f in docs.schema if f.name not in ("n_lines", "n_dropped", "_gone")]
    out = StructType([*base, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            text, lines, dropped = [], [], []
            for raw, gone in zip(texts(batch), gone_of(batch)):
                all_lines = raw.split(b"\n")
                kept = [x for x in all_lines if key_of(x, min_chars) not in gone] if gone else all_lines
                text.append(b"\n".join(kept))
                lines.append(len(all_lines))
                dropped.append(len(all_lines) - len(kept))
            columns = {f.name: batch.column(batch.schema.get_field_index(f.name)) for f in base}
            columns |= {"text": pa.array(text, pa.binary()).cast(arrow.field("text").type), "n_lines": lines, "n_dropped": dropped}
            yield to_batch(columns, arrow)

    return map_arrow(docs.drop("n_lines", "n_dropped"), run, out)


def drop_common_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = BATCHES, travel: int = tx.BROADCAST_KEYS
) -> DataFrame:
    """`docs` with its texts less their common lines, and the columns n_lines and n_dropped.

    `docs` needs doc_id and text; other columns pass through (columns named n_lines or n_dropped are
    replaced). A line is common when at least `min_docs` rows hold its key, and the key has
    `min_chars` code points or more; repeated rows count each. A null or empty text is one empty
    line and comes out as the empty text; a text that loses all its lines too. An empty table stays empty.

    Up to `travel` common keys go to the documents; more are joined to them by a hash of the text.
    """
    common = common_lines(docs, min_docs, min_chars, batches)
    if common.count() <= travel:
        keys = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r[0]) for r in common.collect()))

        def everywhere(batch):
            return [keys.value] * batch.num_rows

        return _cleaned(docs, min_chars, everywhere)

    pair = docs.sparkSession.createDataFrame([], "_of string, key binary").schema
    arrow = to_arrow_schema(pair)

    def held(batches):
        for batch in batches:
            rows = [
                (of, k) for of, raw in zip(batch.column(0).to_pylist(), texts(batch)) for k in set(keys_of(raw, min_chars)) - {None}
            ]
            yield to_batch({"_of": [of for of, _ in rows], "key": [k for _, k in rows]}, arrow)

    # rows of one text lose the same lines, so a text's hash names them, whatever the ids
    named = F.md5(F.coalesce("text", F.lit("")))
    mine = map_arrow(docs.select(named.alias("_of"), "text"), held, pair).distinct()
    gone = mine.join(common, "key", "left_semi").groupBy("_of").agg(F.collect_list("key").alias("_gone"))
    marked = docs.withColumn("_of", named).join(gone, "_of", "left").drop("_of")

    def own(batch):
        found = batch.column(batch.schema.get_field_index("_gone")).to_pylist()
        return [frozenset(f or ()) for f in found]

    return _cleaned(marked, min_chars, own)
