"""Helpers that keep skewed or very large inputs distributed.

Groups keyed by a series (product x market) hold at most one row per week, so window functions
over them are bounded by the calendar. Everything keyed by less than a series (a brand, a channel,
the whole portfolio) can hold any share of the data; those paths use the helpers below instead of
a single-task sort or an exact-percentile buffer.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Largest configuration list that may be shipped to every executor.
MAX_BROADCAST_ROWS = 10_000
#: Largest table of few numbers that Spark may broadcast by the size of its files: some 150 MB in memory.
MAX_LOOKUP_ROWS = 2_000_000
#: Rank error of the sketch used to bracket exact quantiles is n / SKETCH_ACCURACY.
SKETCH_ACCURACY = 10_000


def config_lookup(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A lookup built from configuration; hinted for broadcast only when its length is bounded.

    Larger lists are left to the optimizer, which compares sizes with
    spark.sql.autoBroadcastJoinThreshold and otherwise shuffles.
    """
    df = spark.createDataFrame(list(rows), schema)
    return F.broadcast(df) if len(rows) <= MAX_BROADCAST_ROWS else df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: spark.checkpoint.dir, or a temporary one in local mode."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to storage that every executor can reach")
        folder = tempfile.mkdtemp(prefix="shelfwise-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def scratch_dir(spark: SparkSession) -> str:
    """A new, not yet existing path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/shelfwise-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage on reliable storage, so lost executors lose no state."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    For inputs that a job scans several times: unlike a checkpoint, the parquet copy keeps column
    pruning, filter pushdown and size statistics.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def growing(df: DataFrame) -> DataFrame:
    """A side of a join by series, pair or event: it grows with the data and is never sent whole.

    Spark would decide by the size of files. Repeated keys take a hundredth of their memory there, so
    a table of a few MB can be GB in the driver. A key's rows have to be bounded.
    """
    return df.hint("merge")


def counted(df: DataFrame, rows: int) -> DataFrame:
    """A lookup of that many rows: the optimizer's to place while they are few, else `growing`."""
    return df if rows <= MAX_LOOKUP_ROWS else growing(df)


@contextmanager
def keys_in_part(spark: SparkSession) -> Iterator[None]:
    """Within it, a join runs where both sides lie if both are dealt by the same part of its keys.

    Spark's default deals them again by all keys, against skew; use it where the part's groups are
    bounded. A plan is made when a job starts, so the job has to run inside.
    """
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, was)


@contextmanager
def sizes_measured(spark: SparkSession) -> Iterator[None]:
    """Within it, a side of a join is broadcast only if a stage has found it small, not because its files are.

    For jobs over stored tables whose joins hold few keys or many, which only the run can tell: the
    same limit then applies to rows as they lie in memory. Both sides are dealt before that is
    known, so lookups should be joined outside. The job has to run inside.
    """
    files, stages = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    limit, was = spark.conf.get(files), spark.conf.get(stages, None)
    spark.conf.set(stages, limit if was is None else was)
    spark.conf.set(files, "-1")
    try:
        yield
    finally:
        spark.conf.set(files, limit)
        spark.conf.unset(stages) if was is None else spark.conf.set(stages, was)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on `keys` in which null meets null; keeps the left side's keys."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact interpolated quantiles per key without buffering a key's values in one task.

    A mergeable sketch brackets each wanted rank; plain aggregation counts the values below the
    bracket; only the distinct values inside it (about 4 n / SKETCH_ACCURACY) are ordered. Equal
    values are folded to (value, count) first, with map-side combine. Same result as `percentile`.
    """
    keys = list(keys)
    slack = 2.0 / SKETCH_ACCURACY
    src = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    names, points = list(probs), list(probs.values())
    edges = [max(0.0, p - slack) for p in points] + [min(1.0, p + slack) for p in points]
    bounds = src.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_total"),
        F.percentile_approx("_v", edges, SKETCH_ACCURACY).alias("_e"),
    )
    # a small group is ordered whole; in a larger one the slack is at least two ranks
    small = F.col("_total") <= SKETCH_ACCURACY
    brackets = bounds.select(
        *keys,
        "_total",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("name"),
                        F.lit(p).alias("prob"),
                        F.when(small, float("-inf")).otherwise(F.col("_e")[i]).alias("lo"),
                        F.when(small, float("inf")).otherwise(F.col("_e")[i + len(points)]).alias("hi"),
                    )
                    for i, (n, p) in enumerate(zip(names, points))
                ]
            )
        ).alias("_q"),
    )
    counts = src.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    if keys:
        joined = join_null_safe(counts, brackets, keys)
    else:
        # the few brackets of the whole table travel as one scalar
        packed = brackets.agg(F.collect_list(F.struct("_total", "_q")).alias("_b"))
        joined = counts.select(
            "*", F.explode(packed.select("_b").scalar()).alias("_b")
        ).select("_v", "_n", "_b._total", "_b._q")
    low, high = F.col("_q.lo"), F.col("_q.hi")
    below = joined.where(F.col("_v") < low).groupBy(*keys, "_q.name").agg(
        F.sum("_n").alias("_below")
    )
    inside = joined.where((F.col("_v") >= low) & (F.col("_v") <= high)).select(
        *keys, F.col("_q.name").alias("name"), F.col("_q.prob").alias("prob"), "_total", "_v", "_n"
    )
    ranked = (
        join_null_safe(inside, below, [*keys, "name"], "left")
        .withColumn(
            "_upto",
            F.coalesce("_below", F.lit(0))
            + F.sum("_n").over(
                Window.partitionBy(*keys, "name").orderBy("_v").rowsBetween(
                    Window.unboundedPreceding, Window.currentRow
                )
            ),
        )
        .withColumn("_pos", F.col("prob") * (F.col("_total") - 1))
    )
    at = ranked.groupBy(*keys, "name").agg(
        F.min(F.when(F.col("_upto") > F.floor("_pos"), F.col("_v"))).alias("_a"),
        F.min(F.when(F.col("_upto") > F.ceil("_pos"), F.col("_v"))).alias("_b"),
        F.max(F.col("_pos") - F.floor("_pos")).alias("_frac"),
    )
    quantile = F.when(F.col("_frac") == 0, F.col("_a")).otherwise(
        F.col("_a") * (1 - F.col("_frac")) + F.col("_b") * F.col("_frac")
    )
    return at.groupBy(*keys).agg(
        *[F.max(F.when(F.col("name") == n, quantile)).alias(n) for n in names]
    )


def running_totals(
    df: DataFrame, keys: Sequence[str], order: str, amounts: dict[str, str], buckets: int = 64
) -> DataFrame:
    """Inclusive running sums per key in two levels, for keys of any size.

    `order` must be unique per key and numeric. Rows are cut into ordered buckets at sketched
    quantiles, sums run inside a bucket, and the totals of earlier buckets are added. The cut
    points only balance work; the result does not depend on them.
    """
    keys = list(keys)
    cuts = df.groupBy(*keys).agg(
        F.percentile_approx(
            F.col(order).cast("double"), [i / buckets for i in range(1, buckets)], SKETCH_ACCURACY
        ).alias("_cuts")
    )
    placed = join_null_safe(df, cuts, keys).withColumn(
        "_bucket",
        F.size(F.filter("_cuts", lambda c: c < F.col(order).cast("double"))),
    ).drop("_cuts")
    totals = placed.groupBy(*keys, "_bucket").agg(
        *[F.sum(c).alias(f"_t_{out}") for out, c in amounts.items()]
    )
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in amounts],
    )
    within = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return join_null_safe(placed, offsets, [*keys, "_bucket"]).select(
        *df.columns,
        *[(F.sum(c).over(within) + F.col(f"_o_{o}")).alias(o) for o, c in amounts.items()],
    )
