"""Line dedup, hard negatives and ranked search against brute force on small, awkward tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_ops import frame, words_of

from shelfwise.llm import hard_negatives as hn
from shelfwise.llm import line_dedup as ld
from shelfwise.llm import ranked_search as rs


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# 11 line dedup


def brute_lines(texts, min_docs, min_chars):
    lines = [(t or "").split("\n") for t in texts]
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    seen = Counter(k for own in lines for k in {key(x) for x in own})
    out = []
    for own in lines:
        kept = [x for x in own if len(key(x)) < min_chars or seen[key(x)] < min_docs]
        out.append((len(own), len(own) - len(kept), "\n".join(kept)))
    return out


@pytest.fixture(scope="module")
def lined():
    rng = random.Random(11)
    common = ["License: MIT", "\tlicense: mit \x0b", "É é", "é É", "x", "", "  ", "東京"]
    out = [None, "", "\n", " \n\n", "License: MIT", "x\nx\nx"]
    for _ in range(80):
        out.append("\n".join(rng.choice(common) if rng.random() < 0.3 else f"line {rng.randrange(60)}" for _ in range(rng.randrange(9))))
    return out + out[10:30] + ["\n".join(f"own {i}" for i in range(20_000)) + "\nx", "long " * 50_000 + "\nx"]


@pytest.mark.parametrize("travel", [1000, 0])  # common keys go to the documents, or are joined
@pytest.mark.parametrize("min_docs,min_chars", [(3, 1), (10, 2), (1, 1)])
def test_common_lines_go(spark, lined, travel, min_docs, min_chars):
    ids = [None if i % 17 == 5 else i // 2 for i in range(len(lined))]  # null and repeated ids
    docs = frame(spark, lined, ids).repartition(5)
    got = ld.drop_common_lines(docs, min_docs, min_chars, travel=travel)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    rows = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect())
    assert rows == Counter((i, *b) for i, b in zip(ids, brute_lines(lined, min_docs, min_chars)))


def test_runs_are_compacted(spark):
    runs = ld.LineRuns(spark, min_docs=3, fan_out=2, buckets=3)
    batches = [[(b"a", 1), (b"b", 2)], [(b"a", 1), (b"a", 1)], [(b"a", 5), (b"c", 1)], [(b"b", 1)], [(b"c", 1), (b"d", 3)]]
    for rows in batches:
        runs.add(spark.createDataFrame([(bytearray(k), n) for k, n in rows], "key binary, n_docs long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    # a was common after two batches, so the third one adds nothing to it
    held = {bytes(r["key"]): r["n_docs"] for r in runs.levels[2][0].collect()}
    assert held == {b"a": 3, b"b": 3, b"c": 1}
    assert {bytes(r[0]) for r in runs.common().collect()} == {b"a", b"b", b"d"}


def test_runs_have_no_more_files_than_their_keys_need(spark, tmp_path, monkeypatch):
    """One file a bucket and run, buckets by the keys: many shuffle partitions made as many tiny files a run."""
    at = iter(range(100))
    monkeypatch.setattr(ld, "scratch_dir", lambda _: str(tmp_path / f"run{next(at)}"))
    docs = frame(spark, [f"same\nline {i}\nline {i % 400}" for i in range(800)]).repartition(3)
    was = spark.conf.get("spark.sql.shuffle.partitions")

    def files():
        runs = [len(list(d.glob("*.parquet"))) for d in tmp_path.iterdir()]
        got = {r["text"] for r in ld.drop_common_lines(docs, 10).collect()}
        assert got == {f"line {i}\nline {i % 400}" for i in range(800)}
        return [len(list(d.glob("*.parquet"))) for d in tmp_path.iterdir()][len(runs):]

    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        assert set(files()) == {1}
        monkeypatch.setattr(ld, "BUCKET_ROWS", 300)
        assert 2 <= max(files()) <= 8  # compacted runs too: some 2000 counted keys
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_no_documents_no_lines(spark):
    assert ld.drop_common_lines(frame(spark, [])).count() == 0
    clash = frame(spark, ["a\nb"] * 3).withColumn("n_lines", F.lit("mine"))
    assert {(r["text"], r["n_lines"]) for r in ld.drop_common_lines(clash, 3).collect()} == {("", 2)}


# 12 hard negatives


@pytest.mark.parametrize("shape", [(1, 1, 1), (17, 64, 33), (40, 63, 41), (5, 100, 70), (33, 17, 0)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(sum(shape))
    n, d, c = shape
    for top in (200, 2**27):
        a, b = rng.integers(-top, top, (n, d)), rng.integers(-top, top, (d, c))
        for leaf in (1, 3, 16):
            assert (hn.strassen(a, b, leaf) == a @ b).all()


def brute_negatives(rows, k_pos, k_neg, low, high):
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(256 * x) for x in v]
        if sum(float(x) * x for x in v) < 2.0**62:
            best[i] = min(best.get(i, (label, v)), (label, v))
    out = set()
    for a, (label, v) in best.items():
        if a % 5:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, own) for i, (own, w) in best.items() if i != a]
        for s, p, own in sorted(x for x in scored if x[2] == label)[:k_pos]:
            inside = sorted(x for x in scored if x[2] != label and low * -s <= high * -x[0] <= high * -s)
            out |= {(a, p, r, n, -s, -t) for r, (t, n, _) in enumerate(inside[:k_neg], 1)}
    return out


VECTORS = "vec_id long, embedding array<float>, label int, row string, cell int, kind string, v string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, None, 7, "k", "v") for i, label, v in rows], VECTORS)


@pytest.mark.parametrize("cells", [(16_384, 8_192, 512, 2_048), (4, 16, 3, 5)])
def test_hard_negatives(spark, monkeypatch, cells):
    for name, value in zip(("CELL_ANCHORS", "CELL_ROWS", "TILE_ANCHORS", "TILE_ROWS"), cells):
        monkeypatch.setattr(hn, name, value)
    rng = random.Random(4)
    rows = [(i, rng.randrange(3), [float(np.float32(rng.uniform(-0.1, 0.5))) for _ in range(rng.choice([6, 6, 7]))]) for i in range(90)]
    same = rows[3][2]
    rows += [(i, i % 3, same) for i in range(100, 140)]  # ties
    rows += rows[10:14] + [(20, 2, same), (20, 0, same)]  # repeated rows and ids
    rows += [(None, 1, same), (201, None, same), (202, 1, None), (203, 1, [0.1, None]), (204, 1, [float("nan")]),
             (205, 1, [float("inf"), 0.0]), (206, 1, []), (207, 1, [3e38] * 6), (210, 2, [-0.2] * 6), (-5, 0, same)]
    want = brute_negatives([(i, label, v and [x if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows], 5, 5, 80, 100)
    got = hn.hard_negatives(vectors(spark, rows).repartition(4), F.col("vec_id") % 5 == 0, F.col("label"))
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 100


def test_no_vectors(spark):
    assert hn.hard_negatives(vectors(spark, []), F.col("vec_id") % 5 == 0, F.col("label")).count() == 0
    alone = vectors(spark, [(5, 1, [0.5]), (6, 2, [0.5])])
    assert hn.hard_negatives(alone, F.col("vec_id") % 5 == 0, F.col("label")).count() == 0


# 13 ranked search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_ranks(docs, items, k=10):
    bags = [(i, TERM.findall(lower(t or ""))) for i, t in docs]
    bags = [(i, Counter(w), len(w)) for i, w in bags if w]
    total, df = sum(n for _, _, n in bags), Counter(t for _, bag, _ in bags for t in bag)
    weight = {t: math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * c + 1))) for t, c in df.items()}
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(TERM.findall(lower(t or "")))
    out = Counter()
    for item, terms in asked.items():
        scored = []
        for i, bag, n in bags:
            m = 100 - 90 + (90 * n * len(bags)) // total
            score = sum(weight[t] * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in terms if bag[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1):
            out[item, rank, None if none else i, -s] += 1
    return out


@pytest.mark.parametrize("block_rows,lookups", [(8192, 1 << 15), (37, 8), (1, 1)])
def test_ranked_documents(spark, monkeypatch, block_rows, lookups):
    monkeypatch.setattr(rs, "LOOKUPS", lookups)
    monkeypatch.setattr(rs, "ITEMS", max(3, lookups))
    rng = random.Random(13)
    texts = [" ".join(words_of(rng, rng.randrange(1, 60), 50)) for _ in range(70 if block_rows > 1 else 20)]
    texts += texts[:8] * 3 + [None, "", ".,;", "W1-w1 É é", "w3 " * 30_000, " ".join(f"u{i} w{i % 50}" for i in range(20_000))]
    ids = [None if i % 19 == 7 else i - (i % 23 == 0) for i in range(len(texts))]
    items = [(i, texts[i]) for i in range(12)]
    items += [(50, None), (51, "nothing known"), (52, "w1"), (52, "w2 w2"), (None, "w4 É"), (53, texts[-1][:2000])]
    docs = frame(spark, texts, ids).repartition(3)
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, term string, block int")
    got = rs.ranked_documents(docs, asked, block_rows=block_rows)
    assert Counter(tuple(r) for r in got.collect()) == brute_ranks(list(zip(ids, texts)), items)


def test_search_leaves_documents_unread():
    rng = np.random.default_rng(5)
    n = 4000
    rows = np.repeat(np.arange(n), 6)
    terms = np.concatenate([rng.choice(50, 6, replace=False) for _ in range(n)])
    impact = rng.integers(1, 100, 6 * n)
    impact[(rows < 12) & (terms < 20)] += 10_000
    index = rs.BlockIndex(terms, rows, rows, impact)
    calls, wide = [], index._best
    index._best = lambda tables, values, lo, hi, better: calls.append(lo.size) or wide(tables, values, lo, hi, better)
    places, scores = index.search(np.arange(20), 10)
    brute = np.bincount(rows, np.where(terms < 20, impact, 0))
    order = np.lexsort((np.arange(n), -brute))[:10]
    assert (index.doc_id[places] == order).all() and (scores == brute[order]).all()
    assert sum(calls) < 20 * n  # far fewer lookups than documents times terms


def test_nothing_to_rank(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert rs.ranked_documents(frame(spark, ["a b"]), none).count() == 0
    assert rs.ranked_documents(frame(spark, []), some).count() == 0
    assert rs.ranked_documents(frame(spark, [None, " "]), some).count() == 0
