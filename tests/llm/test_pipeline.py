"""Queries against their SQL, and the pipeline stage by stage against the operators' brute force."""

import pytest
from oracle_check import TESTDATA, compare, duck

import __spark_entry__ as entry
import corpus_pipeline
from shelfwise.llm import queries

SF = TESTDATA / "sf0.001"
pytestmark = pytest.mark.skipif(not SF.exists(), reason="fixture tables not present")


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_matches_sql(spark, name):
    _, problem = compare(spark, duck(SF), name, entry.queries(), entry.oracle_sql(), SF)
    assert problem == ""


def test_every_operator_has_a_query():
    names = [q for q in entry.queries() if q.startswith("op")]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_stages(spark):
    from test_text_ops import brute_components, brute_stats, pii_base

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "pii", "best_fit_packing"]

    def rows(df):
        return {r["doc_id"]: r["text"] for r in df.collect()}

    raw = rows(docs)
    good = stages["quality_rules"](spark, docs, str(SF))
    assert good.columns == columns
    kept = rows(good)
    for d, t in raw.items():
        n, _, symbols, _, _, repeats = brute_stats(t)
        if n < 10 or 5 * repeats > n:
            assert d not in kept
        elif not symbols and not repeats:
            assert d in kept
    once = stages["ngram_jaccard_join"](spark, good, str(SF))
    ids, texts = zip(*sorted(kept.items()))
    assert once.columns == columns
    assert set(rows(once)) == {c for _, _, c in brute_components(texts, ids, 5, 80, 100)}
    clean = stages["benchmark_decontamination"](spark, once, str(SF))
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert clean.columns == columns
    assert set(rows(clean)) == {d for d, t in rows(once).items() if not any(i in " ".join(t.lower().split()) for i in items)}
    safe = stages["pii"](spark, clean, str(SF))
    assert safe.columns == columns
    assert all(not pii_base(t) for t in rows(safe).values()) and set(rows(safe)) == set(rows(clean))
    packed = stages["best_fit_packing"](spark, safe, str(SF)).collect()
    assert {r["doc_id"] for r in packed} == set(rows(safe))
    assert sum(r["length"] for r in packed) == sum(r["length"] for r in corpus_pipeline.run(spark, str(SF)).collect())
