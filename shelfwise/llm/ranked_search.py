"""Ranked lexical search: best-first document intervals over range-maximum sparse tables.

Documents are dealt into blocks of a bounded number; a block holds the posting lists of the query
terms, each posting with its impact (what the term adds to the document's score), and for every list
sparse tables: the place of the largest impact among 2**j neighbouring postings. Any run of a list has
its maximum in two lookups.

A query starts with one interval, the whole block. The sum of its terms' range maxima bounds the
score of every document inside. The intervals with the highest bounds are taken first; each is split at
the document of its largest single impact: that document is scored, the parts left and right of it
become intervals. Intervals whose bound cannot beat the k-th best document so far are dropped; at an
equal bound, those that hold no smaller doc_id. When none is left, the block's k best are exact.
Several intervals are split at a time, so that the lookups are numpy calls over (interval, term).

Documents of a block lie in an order that makes intervals alike: by their commonest query term (which
tells languages and subjects apart), then by total impact.

Documents travel as postings of query terms only. Queries come to every block after its postings, in groups
of a few thousand, so that neither the documents nor the queries have to fit a task, the driver or a broadcast.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from shelfwise.llm.text import map_arrow, map_batches, texts, to_batch
from shelfwise.scale import written

#: Runs of digits, ASCII letters and anything beyond ASCII; UTF-8 bytes from 0x80 on are the latter.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Documents of a block.
BLOCK_ROWS = 8192
#: (interval, term) pairs looked up at once.
LOOKUPS = 1 << 15
#: Queries whose terms a task holds at once, about.
ITEMS = 4096
NO_ID = np.iinfo(np.int64).max


def terms_of(raw: bytes) -> list[bytes]:
    return TERM.findall(raw.lower())  # bytes: A-Z only


class BlockIndex:
    """Posting lists of a block, sorted by (term, document place), and their sparse tables."""

    def __init__(self, term: np.ndarray, row: np.ndarray, doc_id: np.ndarray, impact: np.ndarray):
        self.terms, term = np.unique(term, return_inverse=True)
        rows, first, doc = np.unique(row, return_index=True, return_inverse=True)
        ids, total = doc_id[first], np.bincount(doc, impact)
        common = np.bincount(term)
        commonest = np.lexsort((term, common[term], doc))
        last = np.r_[doc[commonest][1:] != doc[commonest][:-1], True]
        order = np.lexsort((-total, term[commonest][last]))
        place = np.empty(len(rows), np.int64)
        place[order] = np.arange(len(rows))
        self.size = len(rows)
        self.doc_id = ids[order]
        # smaller ids first; rows without id after all others
        by_id = np.lexsort((rows[order], self.doc_id))
        self.rank = np.empty(self.size, np.int64)
        self.rank[by_id] = np.arange(self.size)
        at = place[doc]
        order = np.lexsort((at, term))
        self.place, self.impact = at[order], impact[order]
        self.keys = term[order] * self.size + self.place
        longest = int(np.bincount(term).max())
        self.top = self._tables(self.impact, longest, np.greater_equal)
        self.lowest = self._tables(self.rank, self.size, np.less_equal)

    @staticmethod
    def _tables(values: np.ndarray, longest: int, better) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Level j holds the place of the best of 2**j values, the leftmost of equal ones; the levels lie
        one after the other. Also where each level starts, and floor(log2) of lengths up to `longest`."""
        tables = [np.arange(len(values), dtype=np.int32)]
        width = 1
        while 2 * width <= longest:
            a, b = tables[-1][:-width], tables[-1][width:]
            tables.append(np.where(better(values[a], values[b]), a, b))
            width *= 2
        start = np.cumsum([0, *map(len, tables[:-1])])
        return np.concatenate(tables), start, np.frexp(np.arange(longest + 1))[1] - 1

    @staticmethod
    def _best(tables, values, lo, hi, better) -> np.ndarray:
        """Place of the best value of every run [lo, hi); where a run is empty, any place."""
        flat, start, log = tables
        lo = np.minimum(lo, len(values) - 1)
        hi = np.maximum(hi, lo + 1)
        level = log[hi - lo]
        first = start[level]
        a, b = flat[first + lo], flat[first + hi - (1 << level)]
        return np.where(better(values[a], values[b]), a, b)

    def search(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents with a score above 0."""
        found = np.searchsorted(self.terms, terms)
        found = found[(found < len(self.terms)) & (self.terms[np.minimum(found, len(self.terms) - 1)] == terms)]
        best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(found):
            return best, score
        base = (found * self.size)[None, :]

        def bounded(left, right, lo, hi):
            """Intervals with their bound and the document to split at."""
            at = self._best(self.top, self.impact, lo, hi, np.greater_equal)
            value = np.where(hi > lo, self.impact[at], 0)
            most = value.argmax(axis=1)
            row = np.arange(len(left))
            return np.stack([left, right, value.sum(axis=1), self.place[at[row, most]]])

        def lookup(place):
            return np.searchsorted(self.keys, base + place[:, None])

        ends = np.array([0]), np.array([self.size])
        open_ = bounded(*ends, lookup(ends[0]), lookup(ends[1]))
        most_wide, wide = max(1, LOOKUPS // len(found)), 1
        while True:
            left, right, bound, _ = open_
            alive = bound > 0
            if len(score) == k:
                least = self._best(self.lowest, self.rank, left, right, np.less_equal)
                alive &= (bound > score[-1]) | ((bound == score[-1]) & (self.rank[least] < self.rank[best[-1]]))
            open_ = open_[:, alive]
            if not open_.shape[1]:
                return best, score
            if open_.shape[1] > wide:
                order = np.argpartition(-open_[2], wide)
                now, open_ = open_[:, order[:wide]], open_[:, order[wide:]]
            else:
                now, open_ = open_, open_[:, :0]
            wide = min(2 * wide, most_wide)
            left, right, _, split = now
            lo, mid, hi = lookup(left), lookup(split), lookup(right)
            near = np.minimum(mid, len(self.place) - 1)
            hit = (mid < hi) & (self.place[near] == split[:, None])
            best = np.concatenate([best, split])
            score = np.concatenate([score, np.where(hit, self.impact[near], 0).sum(axis=1)])
            order = np.lexsort((self.rank[best], -score))[:k]
            best, score = best[order], score[order]
            parts = bounded(np.r_[left, split + 1], np.r_[split, right], np.r_[lo, mid + hit], np.r_[mid, hi])
            open_ = np.concatenate([open_, parts[:, parts[0] < parts[1]]], axis=1)


def document_terms(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n, term, tf): a row per distinct term, and one with the empty term and n per document with terms."""

    def run(batch):
        n, names, counts = [], [], []
        for raw in texts(batch):
            found = terms_of(raw)
            tf = Counter(found)
            n.append(len(found))
            names.append([b"", *tf] if found else [])
            counts.append([len(found), *tf.values()] if found else [])
        terms = pa.array(names, pa.list_(pa.binary())).cast(pa.list_(pa.string()))
        return {"row": batch.column(0), "doc_id": batch.column(1), "n": n, "terms": terms, "tfs": counts}

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    lists = map_batches(numbered, run, "row long, doc_id long, n long, terms array<string>, tfs array<long>")
    return lists.select("row", "doc_id", "n", F.inline(F.arrays_zip("terms", "tfs"))).withColumnsRenamed({"terms": "term", "tfs": "tf"})


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 10, b: int = 90, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """item_id, rank, doc_id, score: the `k` best rows of `docs` (doc_id long, text) for each item (item_id long, text).

    With N documents that hold a term, L their terms, n a document's, df the documents with a term and
    tf its occurrences: weight w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 100 - b + (b n N) div L,
    and a document's score is the sum over the item's distinct terms of w * ((10**9 tf) div (1000 tf + 8 m)).

    A null, empty or termless text has no terms and never ranks; an item without known terms has no rows.
    Rows of `items` with one item_id (null too) are one item with the terms of all. Repeated documents rank
    each; equal scores go by doc_id, rows without doc_id last. Other columns are ignored.
    """
    spark = docs.sparkSession

    def split(batch):
        names = [sorted(set(terms_of(raw))) for raw in texts(batch)]
        return {"item_id": batch.column(0), "term": pa.array(names, pa.list_(pa.binary())).cast(pa.list_(pa.string()))}

    wanted = map_batches(items.select("item_id", "text"), split, "item_id long, term array<string>")
    wanted = written(wanted.select("item_id", F.explode("term").alias("term")).distinct())
    marker = spark.createDataFrame([("", -1)], "term string, term_id long")
    known = wanted.select("term").distinct().select("term", F.monotonically_increasing_id().alias("term_id"))
    names = written(known.unionByName(marker))
    postings = written(document_terms(docs).join(names, "term").drop("term"))

    documents, total = postings.where("term_id < 0").agg(F.count("*"), F.sum("tf")).first()
    df = postings.where("term_id >= 0").groupBy("term_id").agg(F.count("*").alias("df"))
    w = F.floor(1000 * F.log((2 * F.lit(documents) + 2) / (2 * F.col("df") + 1)))
    weights = written(df.select("term_id", w.alias("w")).where("w > 0"))
    # decimals: the product may exceed 64 bits, the quotient does not
    m = F.expr(f"{100 - b} + cast(n * {b} as decimal(20,0)) * cast({documents} as decimal(18,0)) div {max(total or 0, 1)}")
    impact = F.expr("w * ((1000000000 * tf) div (1000 * tf + 8 * m))")
    blocks = max(1, -(-documents // block_rows))
    scored = (
        postings.join(weights, "term_id").withColumn("m", m)
        .select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("group"), "term_id", "row", "doc_id", impact.alias("impact"))
        .where("impact > 0")
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    asked = wanted.join(names, "term").join(weights.select("term_id"), "term_id").withColumn("item", F.xxhash64("item_id"))
    item_groups = 1 + items.count() // ITEMS
    group = 1 + F.pmod("item", F.lit(item_groups)).cast("int")
    asked = asked.select(every, group.alias("group"), "term_id", "item", "item_id")
    # one long tells block, kind and group of queries: rows sort by it alone; postings have group 0
    groups = 1 + item_groups
    key = (F.col("block").cast("long") * groups + F.col("group")).alias("key")
    cells = scored.select("block", key, "term_id", "row", "doc_id", "impact").unionAll(
        asked.select("block", key, "term_id", "item", "item_id", F.lit(0).cast("long")))
    placed = cells.repartitionById(blocks, F.col("block")).drop("block").sortWithinPartitions("key")
    out = spark.createDataFrame([], "item_id long, doc_id long, score long").schema
    arrow = to_arrow_schema(out)

    def answers(index, terms, item, item_id):
        order = np.argsort(item, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(item[order]) != 0, True])
        for x, y in zip(edges[:-1], edges[1:]):
            places, scores = index.search(np.sort(terms[order[x:y]]), k)
            ids, asker = index.doc_id[places], np.repeat(item_id[order[x]], len(places))
            yield to_batch({
                "item_id": pa.array(asker, mask=asker == NO_ID),
                "doc_id": pa.array(ids, mask=ids == NO_ID),
                "score": pa.array(scores),
            }, arrow)

    def run(batches):
        now, held, index = None, [], None

        def done():
            """The rows of one key are complete: a block's postings, or a group of its queries."""
            nonlocal index
            columns = list(map(np.concatenate, zip(*held)))
            if now % groups == 0:
                index = (now // groups, BlockIndex(*columns))
            elif index is not None and index[0] == now // groups:
                yield from answers(index[1], *columns[:3])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            columns = [batch.column(i).fill_null(NO_ID).to_numpy() for i in (1, 2, 3, 4)]
            for x, y in zip(edges[:-1], edges[1:]):
                if held and key[x] != now:
                    yield from done()
                    held = []
                now = int(key[x])
                held.append([c[x:y] for c in columns])
        if held:
            yield from done()

    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return map_arrow(placed, run, out).withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
