"""Quality rules with host-level verdicts.

Every document is measured against a few rules. Failures are counted by host; a host's failure
rate per rule is shrunk to the corpus by a beta prior whose two parameters are fitted to all hosts
(method of moments), so a host with two bad pages is not condemned and one with thousands is. The
verdict per host and rule is joined back: documents of a host that is held strictly must meet the
rule's strict limit, others its loose one. A clean document meets both, wherever it comes from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfwise.llm.text import CONTINUATION, WORD_BREAKS, map_arrow, mix64, texts
from shelfwise.scale import written

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
NOT_SYMBOLS = bytes(set(range(256)) - set(SYMBOLS))
STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """`measure` (SQL over STATS) may not exceed `strict`, or `loose` where the host is trusted."""

    name: str
    measure: str
    strict: float
    loose: float


RULES = (
    Rule("symbols", "n_symbols / greatest(n_words, 1)", 0.1, 0.3),
    Rule("dup_lines", "n_dup_lines / greatest(n_lines, 1)", 0.3, 0.6),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", 0.1, 0.2),
    Rule("long_words", "word_chars / greatest(n_words, 1)", 15, 30),
)
#: A host is held strictly on a rule when its shrunk failure rate is above both.
STRICT_RATE = 0.2
STRICT_TIMES_MEAN = 1.5
#: Prior strength where hosts differ no more than chance explains.
MAX_STRENGTH = 1e6


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words within 5-word windows that occur at least twice (compared by 64-bit hash)."""
    if len(words) <= WINDOW:
        return 0
    h = word_hashes(words)
    size = len(h) - WINDOW + 1
    acc = mix64(h[:size])
    for i in range(1, WINDOW):
        acc = mix64(acc * np.uint64(0x100000001B3) + h[i : i + size])
    order = np.argsort(acc)
    run = acc[order]
    same = np.zeros(size + 1, bool)
    same[1:-1] = run[1:] == run[:-1]
    starts = order[same[1:] | same[:-1]]
    if not len(starts):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def text_stats(raw: bytes) -> tuple[int, ...]:
    """STATS of one text; n_lines counts lines that hold a word."""
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(WORD_BREAKS)]
    return (
        len(words),
        len(raw.translate(None, WORD_BREAKS + CONTINUATION)),
        len(raw.translate(None, NOT_SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def with_stats(docs: DataFrame, column: str) -> DataFrame:
    """`docs` with its text's STATS as struct `column`."""
    kind = T.StructType([T.StructField(s, T.LongType()) for s in STATS])
    schema = T.StructType([*docs.schema.fields, T.StructField(column, kind)])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            found = [text_stats(t) for t in texts(batch)]
            parts = [pa.array([x[i] for x in found], pa.int64()) for i in range(len(STATS))]
            more = pa.StructArray.from_arrays(parts, fields=list(arrow.field(column).type))
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) for c, f in zip(batch.columns, arrow)] + [more], schema=arrow
            )

    return map_arrow(docs, run, schema)


def host_verdicts(failures: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per host: n_docs and, per rule, fail_, rate_ (shrunk) and strict_.

    `failures` has host and one 0/1 column per rule. The null host is a host of its own.
    """
    hosts = failures.groupBy("host").agg(
        F.count("*").alias("n_docs"), *[F.sum(r.name).alias(f"fail_{r.name}") for r in rules]
    )
    n = F.sum("n_docs")
    fits = []
    for r in rules:
        fail = F.col(f"fail_{r.name}")
        mean = F.sum(fail) / n
        spread = F.sum(fail * fail / F.col("n_docs")) / n - mean * mean
        tau2 = spread - mean * (1 - mean) * (F.count("*") - 1) / n
        strength = F.when(tau2 <= 0, MAX_STRENGTH).otherwise(
            F.least(F.greatest(mean * (1 - mean) / F.nullif(tau2, F.lit(0.0)) - 1, F.lit(1.0)), F.lit(MAX_STRENGTH))
        )
        fits.append(F.struct(mean.alias("mean"), strength.alias("strength")).alias(r.name))
    prior = hosts.agg(F.struct(*fits).alias("p")).scalar()
    out = hosts.withColumn("prior", prior)
    for r in rules:
        p = F.col(f"prior.{r.name}")
        rate = (F.col(f"fail_{r.name}") + p["mean"] * p["strength"]) / (F.col("n_docs") + p["strength"])
        out = out.withColumn(f"rate_{r.name}", rate).withColumn(
            f"strict_{r.name}",
            (rate > STRICT_RATE) & (rate > STRICT_TIMES_MEAN * p["mean"]),
        )
    return out.drop("prior")


def _failures(stats: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    return stats.select("host", *[F.expr(f"int({r.measure} > {r.strict})").alias(r.name) for r in rules])


def _judged(stats: DataFrame, verdicts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """`stats` with base_failed and kept."""
    own = verdicts.select(
        F.col("host").alias("_host"), *[F.col(f"strict_{r.name}").alias(f"_strict_{r.name}") for r in rules]
    )
    base = F.expr(f"n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    beyond = F.lit(False)
    for r in rules:
        limit = F.when(F.col(f"_strict_{r.name}"), r.strict).otherwise(r.loose)
        beyond = beyond | (F.expr(r.measure) > limit)
    return (
        stats.join(own, F.col("host").eqNullSafe(F.col("_host")))
        .withColumn("base_failed", base)
        .withColumn("kept", ~base & ~beyond)
        .drop("_host", *[f"_strict_{r.name}" for r in rules])
    )


def host_quality(docs: DataFrame, host: str = "source", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of `docs`: doc_id, host, STATS, base_failed, kept.

    `docs` needs doc_id, text and the host column; others are ignored. A null text is empty: no
    words, so base_failed. Rows without host share one. Repeated rows count and come out each.
    """
    rows = docs.select("doc_id", F.col(host).cast("string").alias("host"), "text")
    stats = written(with_stats(rows, "s").select("doc_id", "host", "s.*"))
    return _judged(stats, host_verdicts(_failures(stats, rules), rules), rules)


def drop_bad_documents(docs: DataFrame, host: str = "source", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of `docs`, all columns, that `host_quality` keeps.

    Texts are measured twice (for the host counts, then for the filter), which costs less than
    shuffling them to meet their statistics; only host verdicts move.
    """
    measured = with_stats(docs.select(F.col(host).cast("string").alias("host"), "text"), "s").select("host", "s.*")
    verdicts = written(host_verdicts(_failures(measured, rules), rules))
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", F.col(host).cast("string").alias("host"))
    judged = _judged(with_stats(inner, "s").select("row", "host", "s.*"), verdicts, rules)
    return judged.where("kept").select("row.*")
