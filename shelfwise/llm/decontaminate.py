"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may be met with up to `k = m * rate` edits. Cut into k + 1 pieces, at
least one survives any k edits unharmed, so exact hits of pieces (one Aho-Corasick pass over a
text) name every place worth a look. Each place is verified by Myers' bit-parallel distance.
An item too short for a single edit is its own only piece and is met exactly, between word borders.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.text import map_arrow, map_batches, texts

#: Edits per character of an item.
RATE = 1 / 16
#: Characters of items that a task matches at once; a larger benchmark takes several passes.
BLOCK_CHARS = 1_000_000


def normal(text: str) -> str:
    """Lower case, white space folded."""
    return " ".join(text.lower().split())


def bits(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(eq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of `text`, and the first end that has it."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for at, c in enumerate(text, 1):
        e = eq.get(c, 0)
        v = e | minus
        h = (((e & plus) + plus) ^ plus) | e
        up = minus | (full & ~(h | plus))
        down = plus & h
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, end = score, at
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(v | up))
        minus = up & v
    return best, end


class Matcher:
    """Items of one block, ready to search texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float, single_words: bool = False):
        import ahocorasick

        self.items, self.whole, short = [], {}, {}
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            t = normal(text)
            k = int(len(t) * rate)
            if not k:
                if t:
                    (short if single_words or " " in t else self.whole).setdefault(t, []).append(item_id)
                continue
            at = [len(t) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(at, at[1:]):
                places.setdefault(t[a:b], []).append((len(self.items), a))
            self.items.append((item_id, t, k, bits(t), bits(t[::-1])))
        self.pieces = ahocorasick.Automaton()
        for piece in places.keys() | short.keys():
            self.pieces.add_word(piece, (len(piece), places.get(piece, ()), short.get(piece, ())))
        self.any = bool(places or short)
        if self.any:
            self.pieces.make_automaton()

    @staticmethod
    def _apart(t: str, at: int) -> bool:
        """Whether no word runs across this place."""
        return not (0 < at < len(t) and t[at - 1].isalnum() and t[at].isalnum())

    def search(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best place of each item within its budget."""
        t = normal(text)
        for item_id in self.whole.get(t, ()):
            yield item_id, 0, 0, len(t)
        if not self.any:
            return
        starts: dict[int, set[int]] = {}
        met: set[str] = set()
        for last, (size, where, short) in self.pieces.iter(t):
            a, b = last + 1 - size, last + 1
            if short and t[a:b] not in met and self._apart(t, a) and self._apart(t, b):
                met.add(t[a:b])
                for item_id in short:
                    yield item_id, 0, a, b
            for item, offset in where:
                starts.setdefault(item, set()).add(last + 1 - size - offset)
        for item, found in starts.items():
            item_id, pattern, k, eq, back = self.items[item]
            m, best, seen = len(pattern), None, None
            for s in sorted(found):
                if seen is not None and s <= seen:
                    continue
                # hits up to k later lie in the same window
                a, b = max(0, s - k), min(len(t), s + m + 2 * k)
                seen = s + k
                if t.startswith(pattern, max(0, s)):
                    got = (0, max(0, s), max(0, s) + m)
                else:
                    d, end = myers(eq, m, t[a:b])
                    if d > k:
                        continue
                    got = (d, a + end - myers(back, m, t[a : a + end][::-1])[1], a + end)
                if best is None or got < best:
                    best = got
            if best:
                yield item_id, *best


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of about BLOCK_CHARS, each small enough to travel."""
    items = benchmark.where("text is not null").select("item_id", "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-total // BLOCK_CHARS))
    for k in range(count):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k)
        if rows := part.collect():
            yield sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, single_words: bool = False) -> DataFrame:
    """One row per document and item it contains: doc_id, item_id, distance, start, end.

    Places are in the normalised text (lower case, white space folded), the least distance first,
    then the earliest. Items too short for an edit (`int(length * rate)` is 0) are met exactly,
    between word borders. Such an item of one word names any text about it, so by default only a
    text that is nothing else matches; `single_words` meets it between word borders as well.
    Null and empty texts and items match nothing; a repeated document or item matches each time.
    `docs` needs doc_id and text, `benchmark` item_id and text.
    """
    out = None
    schema = "doc_id long, item_id long, distance int, start long, end long"
    for items in blocks(benchmark):

        def run(batch, items=items, held={}):
            if "m" not in held:  # once per task
                held["m"] = Matcher(items, rate, single_words)
            rows = [
                (d, *hit)
                for d, raw in zip(batch.column(0).to_pylist(), texts(batch))
                for hit in held["m"].search(raw.decode())
            ]
            return dict(zip(("doc_id", "item_id", "distance", "start", "end"), map(list, zip(*rows)) if rows else ([],) * 5))

        part = map_batches(docs.select("doc_id", "text"), run, schema)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, single_words: bool = False) -> DataFrame:
    """The rows of `docs`, all columns, that hold no item by the rules of `benchmark_hits`.

    Rows with null or empty texts stay, as they hold none; of repeated rows all stay or all go.
    Nothing is shuffled.
    """
    for items in blocks(benchmark):

        def run(batches, items=items):
            matcher = Matcher(items, rate, single_words)
            for batch in batches:
                clean = [next(matcher.search(raw.decode()), None) is None for raw in texts(batch)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = map_arrow(docs, run, docs.schema)
    return docs
