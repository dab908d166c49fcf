"""Language-model scores from a subword lattice.

The pieces of an existing subword vocabulary weight every segmentation of a word; a forward
recursion in log space sums them, so a word's probability does not hang on one segmentation. Piece
weights come from the corpus: the vocabulary's own segmentation of all training words, counted by
use, then one round of expected uses over all their segmentations (forward-backward). A word seen in
training adds one more arc, spanning it whole, with its corpus share. The weight of these arcs against
the pieces is the likeliest for the training words, each judged by the counts without it.

All costly work is done once per distinct word. Documents then need one look-up per word: frequent
words travel to the documents, in a table of bounded size; the others are joined by a shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from shelfwise.llm.text import map_arrow, map_batches, mix64, texts, to_batch
from shelfwise.scale import written

FOLDS = 10
#: Words that travel to the documents at most (24 bytes each).
HEAD = 300_000
#: Distinct words a task counts before it hands them on.
FLUSH = 200_000
#: Documents whose words a task holds at once.
SLICE = 500
#: Log odds of the whole-word arcs that are tried.
ODDS = np.arange(-8, 8.01, 0.1)
SMOOTH = 0.1
#: Bytes of a piece; a vocabulary with longer ones is refused.
LONGEST = 1024
LN10 = float(np.log(10))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def vocabulary(path: str):
    """The subword model, and each piece as bytes (a space begins a word); None where it has none."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: list[bytes | None] = []
    for i in range(model.vocab_size()):
        p = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i):
            pieces.append(None)
        elif model.is_byte(i):
            pieces.append(bytes([int(p[1:-1], 16)]))
        else:
            pieces.append(p.replace("▁", " ").encode())
    return model, pieces


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def word_counts(docs: DataFrame) -> DataFrame:
    """word, count in training documents (0 for words of held-out documents alone)."""
    schema = docs.sparkSession.createDataFrame([], "word binary, count long").schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        counts: Counter = Counter()

        def flush():
            out = to_batch({"word": list(counts), "count": list(counts.values())}, arrow)
            counts.clear()
            return out

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), texts(batch)):
                words = raw.lower().split()
                if held_out(doc_id):
                    for w in words:
                        counts[w] += 0
                else:
                    counts.update(words)
                if len(counts) >= FLUSH:
                    yield flush()
        if counts:
            yield flush()

    found = map_arrow(docs.select("doc_id", "text"), run, schema)
    return found.groupBy("word").agg(F.sum("count").alias("count"))


def piece_counts(words: DataFrame, path: str) -> dict[int, int]:
    """Uses of each piece in all training words; at most one number per vocabulary entry."""
    schema = words.sparkSession.createDataFrame([], "piece int, uses long").schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        model, pieces = vocabulary(path)
        total = np.zeros(len(pieces))
        for batch in batches:
            text = [w.decode() for w in batch.column(0).to_pylist()]
            found = model.encode(text, num_threads=1)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((p for f in found for p in f), np.int64, int(sizes.sum()))
            total += np.bincount(flat, np.repeat(batch.column(1).to_numpy(), sizes), len(pieces))
        used = np.flatnonzero(total)
        yield to_batch({"piece": used.astype(np.int32), "uses": total[used].astype(np.int64)}, arrow)

    rows = map_arrow(words.where("count > 0").select("word", "count"), run, schema)
    return {r["piece"]: r["uses"] for r in rows.groupBy("piece").agg(F.sum("uses").alias("uses")).collect()}


class Lattice:
    """Marginal log probabilities of words over all segmentations into pieces."""

    def __init__(self, path: str, uses: dict[int, int], ends: int):
        weights: dict[bytes, float] = {}
        for i, p in enumerate(vocabulary(path)[1]):
            if p:
                weights[p] = weights.get(p, 0.0) + uses.get(i, 0)
        for b in range(256):
            weights.setdefault(bytes([b]), 0.0)
        self.longest = max(map(len, weights))
        if self.longest > LONGEST:
            raise ValueError(f"a piece of {self.longest} bytes")
        total = sum(weights.values()) + ends + SMOOTH * (len(weights) + 1)
        logs = {p: float(np.log((n + SMOOTH) / total)) for p, n in weights.items()}
        self.ends = ends
        self.keys, self.logs, self.begins = [np.zeros(0, np.uint64)], [np.zeros(0)], [np.zeros(0, bool)]
        for size in range(1, self.longest + 1):
            of = sorted(p for p in logs if len(p) == size)
            grid = np.frombuffer(b"".join(of), np.uint8).reshape(-1, size)
            keys = np.zeros(len(of), np.uint64)
            low = high = keys
            for back in range(1, size + 1):
                low, high, keys = self._extend(low, high, grid[:, size - back], back)
            order = np.argsort(keys)
            self.keys.append(keys[order])
            self.logs.append(np.array([logs[p] for p in of])[order])
            self.begins.append(np.array([p[:1] == b" " for p in of], bool)[order])

    @property
    def end(self) -> float:
        """Log probability that a text ends here rather than going on with a word."""
        begins = sum(float(np.exp(v[b]).sum()) for v, b in zip(self.logs, self.begins))
        pieces = sum(float(np.exp(v).sum()) for v in self.logs)
        return float(np.log((1 - pieces) / (1 - pieces + begins)))

    def reweigh(self, uses: list[np.ndarray]) -> None:
        total = sum(float(u.sum()) for u in uses) + self.ends + SMOOTH * (sum(map(len, uses)) + 1)
        self.logs = [np.log((u + SMOOTH) / total) for u in uses]

    @staticmethod
    def _extend(low, high, byte, size):
        """Key of a string one byte longer to the left: its bytes for up to 8, a hash beyond."""
        byte = byte.astype(np.uint64)
        if size <= 8:
            low = low | byte << np.uint64(8 * (size - 1))
            return low, high, low
        if size > 16:
            high = mix64(high + byte + np.uint64(1))
            return low, high, low ^ high
        high = high | byte << np.uint64(8 * (size - 9))
        return low, high, low ^ mix64(high)

    def words(self, words: list[bytes]) -> np.ndarray:
        out = np.empty(len(words))
        for at, grid in self._grids(words):
            out[at] = self._forward(grid, self._arcs(grid))[-1]
        return out

    @staticmethod
    def _grids(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of one length at a time: their places, and their bytes after a space."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            yield at, np.frombuffer(b"".join(b" " + words[i] for i in at), np.uint8).reshape(len(at), -1)

    def _arcs(self, grid: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(end, size, rows, piece numbers of that size) of all pieces within the words, by end."""
        n, size = grid.shape
        for end in range(1, size + 1):
            low = high = np.zeros(n, np.uint64)
            for back in range(1, min(end, self.longest) + 1):
                low, high, key = self._extend(low, high, grid[:, end - back], back)
                keys = self.keys[back]
                if not len(keys):
                    continue
                pos = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = np.flatnonzero(keys[pos] == key)
                if len(hit):
                    yield end, back, hit, pos[hit]

    def _forward(self, grid: np.ndarray, arcs) -> np.ndarray:
        alpha = np.full((grid.shape[1] + 1, len(grid)), -np.inf)
        alpha[0] = 0.0
        for end, back, rows, piece in arcs:
            alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[end - back, rows] + self.logs[back][piece])
        return alpha

    def expected(self, words: list[bytes], counts: np.ndarray) -> list[np.ndarray]:
        """Expected uses of each piece, per size, over all segmentations of words with counts."""
        uses = [np.zeros(len(k)) for k in self.keys]
        for at, grid in self._grids(words):
            arcs = list(self._arcs(grid))
            alpha = self._forward(grid, arcs)
            beta = np.full(alpha.shape, -np.inf)
            beta[-1] = 0.0
            for end, back, rows, piece in reversed(arcs):
                through = self.logs[back][piece] + beta[end, rows]
                beta[end - back, rows] = np.logaddexp(beta[end - back, rows], through)
                share = np.exp(alpha[end - back, rows] + through - alpha[-1, rows])
                uses[back] += np.bincount(piece, share * counts[at[rows]], len(uses[back]))
        return uses


def expected_uses(words: DataFrame, lattice: Lattice) -> list[np.ndarray]:
    """`Lattice.expected` over all training words; one number per piece reaches the driver."""
    schema = words.sparkSession.createDataFrame([], "size int, piece int, uses double").schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        total = [np.zeros(len(k)) for k in lattice.keys]
        for batch in batches:
            found = lattice.expected(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float))
            total = [a + b for a, b in zip(total, found)]
        for size, uses in enumerate(total):
            at = np.flatnonzero(uses)
            yield to_batch({"size": np.full(len(at), size, np.int32), "piece": at.astype(np.int32), "uses": uses[at]}, arrow)

    rows = map_arrow(words.where("count > 0").select("word", "count"), run, schema)
    out = [np.zeros(len(k)) for k in lattice.keys]
    for r in rows.groupBy("size", "piece").agg(F.sum("uses").alias("uses")).collect():
        out[r["size"]][r["piece"]] = r["uses"]
    return out


def hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def word_logs(words: DataFrame, lattice: Lattice) -> DataFrame:
    """hash, count and the lattice's log probability of every distinct word."""

    def run(batch):
        text = batch.column(0).to_pylist()
        return {"hash": hashes(text).view(np.int64), "count": batch.column(1), "inner": lattice.words(text)}

    return map_batches(words.select("word", "count"), run, "hash long, count long, inner double")


def likelihoods(count: np.ndarray, inner: np.ndarray, tokens: int) -> np.ndarray:
    """Log likelihood of the counted words per entry of ODDS, each use judged by the counts without it."""
    share = 1 / (1 + np.exp(-ODDS))
    once = (count - 1) / max(tokens - 1, 1)
    out = np.zeros(len(ODDS))
    for i, w in enumerate(share):
        whole = np.log(w) + np.log(once, out=np.full(len(once), -np.inf), where=once > 0)
        out[i] = (count * np.logaddexp(whole, np.log1p(-w) + inner)).sum()
    return out


def whole_share(logs: DataFrame, tokens: int, ends: int, end: float) -> float:
    """Likeliest weight of the whole-word arcs; 0 without training words."""
    schema = logs.sparkSession.createDataFrame([], "i int, log double").schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        total = np.zeros(len(ODDS))
        for batch in batches:
            total += likelihoods(batch.column(0).to_numpy().astype(float), batch.column(1).to_numpy(), tokens)
        yield to_batch({"i": np.arange(len(ODDS), dtype=np.int32), "log": total}, arrow)

    rows = map_arrow(logs.where("count > 0").select("count", "inner"), run, schema).collect()
    if tokens < 2:
        return 0.0
    total = likelihoods(np.array([float(ends)]), np.array([end]), tokens) if ends else np.zeros(len(ODDS))
    for x in sorted((r["i"], r["log"]) for r in rows):
        total[x[0]] += x[1]
    return float(1 / (1 + np.exp(-ODDS[np.argmax(total)])))


def word_scores(logs: DataFrame, whole: float, tokens: int, kinds: int) -> DataFrame:
    """hash, count, base and score (log10) of every distinct word."""
    inner = F.col("inner") / LN10 + float(np.log10(1 - whole))
    mixed = F.log10(whole * F.col("count") / max(tokens, 1) + F.pow(F.lit(10.0), F.greatest(inner, F.lit(-300.0))))
    return logs.select(
        "hash", "count",
        F.log10((F.col("count") + 0.1) / (tokens + 0.1 * (kinds + 1))).alias("base"),
        # a word without the arc may lie below what a double holds
        (F.when(F.col("count") > 0, mixed).otherwise(inner) if whole > 0 else inner).alias("score"),
    )


def document_parts(docs: DataFrame, head: pa.Table) -> DataFrame:
    """Per document (hash null): sums over its frequent words; per other word: hash and uses."""
    schema = docs.sparkSession.createDataFrame(
        [], "row long, doc_id long, tokens long, known long, base double, score double, hash long, uses long"
    ).schema
    arrow = to_arrow_schema(schema)
    keys = head["hash"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys = keys[order]
    count, base, score = (head[c].to_numpy()[order] for c in ("count", "base", "score"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            each = [hashes(t.lower().split()) for t in texts(batch)]
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            n = len(each)
            doc = np.repeat(np.arange(n), sizes)
            h = np.concatenate(each)
            if len(keys):
                pos = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[pos] == h
                at, of = pos[hit], doc[hit]
            else:
                hit, at, of = np.zeros(len(h), bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
            rest = np.stack([doc[~hit].astype(np.uint64), h[~hit]], axis=1)
            order = np.lexsort((rest[:, 1], rest[:, 0]))
            rest = rest[order]
            new = np.flatnonzero(np.r_[True, (rest[1:] != rest[:-1]).any(axis=1)]) if len(rest) else np.zeros(0, np.int64)
            uses = np.diff(np.r_[new, len(rest)])
            tail = rest[new]
            m = len(tail)

            def both(per_doc, empty):
                return pa.concat_arrays([pa.array(per_doc), pa.nulls(m, pa.array(per_doc).type) if empty is None else pa.array(np.full(m, empty))])

            yield to_batch({
                "row": np.r_[first + np.arange(n), first + tail[:, 0].astype(np.int64)],
                "doc_id": pa.concat_arrays([batch.column(0).cast(pa.int64()), pa.nulls(m, pa.int64())]),
                "tokens": both(sizes, 0),
                "known": both(np.bincount(of, count[at] > 0, n).astype(np.int64), 0),
                "base": both(np.bincount(of, base[at], n), 0.0),
                "score": both(np.bincount(of, score[at], n), 0.0),
                "hash": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(tail[:, 1].view(np.int64))]),
                "uses": both(np.zeros(n, np.int64), 0) if not m else pa.array(np.r_[np.zeros(n, np.int64), uses]),
            }, arrow)
            first += n

    return map_arrow(docs.select("doc_id", "text"), run, schema)


def lattice_scores(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Scores are log10 probabilities of the whole text, words and one end. `docs` needs doc_id and
    text. A null or empty text is its end alone. A null doc_id is not held out. Repeated rows count
    in training and come out each. Without training documents only the smoothing is left. Words
    meet by 64-bit hash.
    """
    path = path or default_vocabulary()
    words = written(word_counts(docs))
    folds = docs.groupBy(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False)).alias("held")).count().collect()
    ends = sum(r["count"] for r in folds if not r["held"])
    sums = words.agg(F.sum("count"), F.count_if(F.col("count") > 0)).first()
    tokens, kinds = (sums[0] or 0) + ends, sums[1] + (ends > 0)
    lattice = Lattice(path, piece_counts(words, path), ends)
    lattice.reweigh(expected_uses(words, lattice))
    logs = written(word_logs(words, lattice))
    whole = whole_share(logs, tokens, ends, lattice.end)
    scored = word_scores(logs, whole, tokens, kinds)
    # the head: all words at least as frequent as the smallest count that keeps it within HEAD
    by_count = scored.where("count > 1").groupBy(F.least("count", F.lit(10_000)).alias("c")).agg(F.count("*").alias("n")).collect()
    size, least = 0, 10_001
    for r in sorted(by_count, key=lambda r: -r["c"]):
        size += r["n"]
        if size > HEAD:
            break
        least = r["c"]
    head = scored.where(F.col("count") >= least).toArrow()
    parts = written(document_parts(docs, head))
    rest = parts.where("hash is not null").select("row", "hash", "uses").join(
        scored.where(F.col("count") < least), "hash"
    ).select(
        "row", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("tokens"),
        F.when(F.col("count") > 0, F.col("uses")).otherwise(0).alias("known"),
        (F.col("uses") * F.col("base")).alias("base"), (F.col("uses") * F.col("score")).alias("score"),
    )
    end_base = float(np.log10((ends + 0.1) / (tokens + 0.1 * (kinds + 1))))
    end_score = float(np.log10(whole * ends / max(tokens, 1) + (1 - whole) * np.exp(lattice.end)))
    per_row = parts.where("hash is null").select(rest.columns).unionAll(rest).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("tokens").alias("tokens"), F.sum("known").alias("known"),
        F.sum("base").alias("base"), F.sum("score").alias("score"),
    )
    return per_row.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False)).alias("held_out"),
        (F.col("tokens") + 1).alias("n_tokens"),
        (F.col("known") + int(ends > 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + end_base).alias("base_score"),
        (F.col("score") + end_score).alias("score"),
    )
