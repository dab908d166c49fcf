"""Sharding by extendible hashing.

A row's shard is a prefix of its hash. The directory has an entry for each prefix of `global`
bits; a bucket owns all entries that begin with its own, shorter prefix. A bucket splits on its
next bit only while it is over the byte limit, so a directory entry names a bucket of any depth
up to the global one. Sizes are summed once per directory entry and rolled up; documents meet the
directory in one equi-join.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.scale import written

BITS = 60
#: Bits added to the directory while a bucket is still over the limit.
DEEPEN = 4


def key_hash(key: Column) -> Column:
    """60 hash bits of a key (md5, so that every engine agrees); a null key hashes as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def _prefix(h: str, depth: int) -> Column:
    return F.shiftright(h, BITS - depth)


def _directory(rows: DataFrame, limit: int, base: str, total: int) -> tuple[DataFrame, int]:
    """(base, entry -> bucket bits, depth, bytes, rows, single) and the directory's bits.

    `rows` has the text column `base` (buckets never span two), h and n_bytes. A bucket of one
    hash value cannot split and is marked single.
    """
    depth = min(BITS, max(1, ceil(log2(max(1, total) / limit)) + 2 if total > limit else 1))
    while True:
        entries = written(
            rows.groupBy(base, _prefix("h", depth).alias("entry")).agg(
                F.sum("n_bytes").alias("n"), F.count("*").alias("c"), F.min("h").alias("lo"), F.max("h").alias("hi")
            )
        )
        if depth == BITS or entries.where((F.col("n") > limit) & (F.col("lo") < F.col("hi"))).isEmpty():
            break
        depth = min(BITS, depth + DEEPEN)
    own = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    paths = entries.select("*", own.alias("depth")).withColumn(
        "prefix", F.expr(f"shiftright(entry, {depth} - depth)")
    )
    nodes = written(
        paths.groupBy(base, "depth", "prefix").agg(
            F.sum("n").alias("shard_bytes"), F.sum("c").alias("shard_rows"),
            F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        ).withColumn("single", F.col("lo") == F.col("hi"))
        .withColumn("fits", (F.col("shard_bytes") <= limit) | F.col("single"))
    )
    parents = nodes.select(
        F.col(base).alias("_b"), (F.col("depth") + 1).alias("_d"), F.col("prefix").alias("_p"), F.col("fits").alias("_fits")
    )
    buckets = nodes.join(
        parents,
        (F.col(base) == F.col("_b")) & (F.col("depth") == F.col("_d")) & (F.shiftright("prefix", 1) == F.col("_p")),
        "left",
    ).where("fits and (depth = 0 or not _fits)")
    bits = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    found = paths.select(base, "entry", "depth", "prefix").join(
        buckets.select(base, "depth", "prefix", "shard_bytes", "shard_rows", "single"), [base, "depth", "prefix"]
    )
    return written(found.select(base, "entry", bits.alias("bits"), "depth", "shard_bytes", "shard_rows", "single")), depth


def _placed(rows: DataFrame, limit: int, base: str, total: int) -> DataFrame:
    directory, depth = _directory(rows, limit, base, total)
    return rows.withColumn("entry", _prefix("h", depth)).join(directory, [base, "entry"]).drop("entry")


def assign_shards(rows: DataFrame, limit: int) -> DataFrame:
    """`rows` (key columns of your own, h, n_bytes, row) with shard, depth, shard_bytes, shard_rows.

    Rows of one hash value that together exceed the limit (the same key, repeated) split again on
    the hash of `row`, a number unique to each; their shard is `bits.bits`. A single row beyond
    the limit is a shard of its own, the only kind that exceeds it.
    """
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    first = written(_placed(rows.withColumn("base", F.lit("")), limit, "base", total).withColumnRenamed("bits", "shard"))
    heavy = F.col("single") & (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)
    done = first.where(~heavy)
    more = first.where(heavy)
    largest = more.agg(F.max("shard_bytes")).first()[0]
    if largest is not None:
        again = more.select(*rows.columns, F.col("shard").alias("base"), F.col("depth").alias("above")).withColumn(
            "key_h", F.col("h")
        ).withColumn("h", key_hash(F.col("row")))
        split = _placed(again, limit, "base", largest)
        done = done.unionByName(
            split.withColumn("h", F.col("key_h"))
            .withColumn("shard", F.concat_ws(".", "base", "bits"))
            .withColumn("depth", F.col("depth") + F.col("above"))
            .select(done.columns)
        )
    return done.drop("base", "single")


def extendible_shards(docs: DataFrame, limit: int) -> DataFrame:
    """One row per document: doc_id, n_bytes, shard, depth, shard_bytes, shard_rows.

    n_bytes is the text's UTF-8 size; null and empty texts have 0. Only doc_id and text are read.
    An empty table gives no rows. A null doc_id hashes as empty text.
    """
    rows = written(
        docs.select(
            "doc_id",
            key_hash(F.col("doc_id")).alias("h"),
            F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    return assign_shards(rows, limit).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_rows")


def write_shards(docs: DataFrame, path: str, limit: int) -> None:
    """Write `docs` as Parquet, a folder per shard (`shard=<bits>`, `shard=all` for no bits)."""
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = written(docs.select(
        kept,
        key_hash(F.col("doc_id")).alias("h"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.monotonically_increasing_id().alias("row"),
    ))
    shards = assign_shards(rows.select("h", "n_bytes", "row"), limit).select(
        "row", F.when(F.col("shard") == "", "all").otherwise(F.col("shard")).alias("shard")
    )
    clash = "shard" in docs.columns
    out = rows.join(shards, "row").select("doc.*", F.col("shard").alias("_shard" if clash else "shard"))
    out.repartition(out.columns[-1]).write.partitionBy(out.columns[-1]).parquet(path)
