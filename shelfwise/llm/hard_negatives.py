"""Hard-negative mining: exact integer scores by Strassen tiles, then mergeable heaps.

Vectors are scaled to whole numbers. Anchors are cut into groups, all rows into other groups, and a
cell is one pair of groups, so a task holds a bounded number of anchors and streams its candidates.
Within a cell, tiles of int64 anchors and candidates are multiplied by Strassen's recursion, odd sides
padded with zeros; additions wrap modulo 2**64, which leaves every product that fits 64 bits exact.

Two rounds, as a window is known only with its positive's score: the first keeps each anchor's best
rows of its own label, the second, for each positive, the best rows of other labels whose score lies
in the window below. Both keep a small heap a row in the cell; cells' heaps merge by order alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from shelfwise.llm.text import map_arrow, to_batch
from shelfwise.scale import written

#: Anchors and candidates of a cell, rows of a tile on either side, side at which recursion ends.
CELL_ANCHORS, CELL_ROWS = 16_384, 8_192
TILE_ANCHORS, TILE_ROWS = 512, 2_048
LEAF = 16
#: Rows with a larger squared norm could score beyond 64 bits.
MAX_NORM2 = 2.0**62
NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices by seven products of halves; exact modulo 2**64."""
    n, d, c = *a.shape, b.shape[1]
    if min(n, d, c) <= leaf:
        return a @ b
    a = np.pad(a, ((0, n % 2), (0, d % 2)))
    b = np.pad(b, ((0, d % 2), (0, c % 2)))
    i, k, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :k], a[:i, k:], a[i:, :k], a[i:, k:]
    b11, b12, b21, b22 = b[:k, :j], b[:k, j:], b[k:, :j], b[k:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * j), np.int64)
    out[:i, :j] = p1 + p4 - p5 + p7
    out[:i, j:] = p3 + p5
    out[i:, :j] = p2 + p4
    out[i:, j:] = p1 - p2 + p3 + p6
    return out[:n, :c]


class Heaps:
    """The k best (score, id) of each row: higher scores first, then smaller ids. Order alone decides,
    so heaps of different tiles and cells merge to the same result whatever the order they come in."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.score = np.full((rows, k), NONE)
        self.id = np.full((rows, k), np.iinfo(np.int64).max)

    def push(self, first: int, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """Offer a tile: `scores` and `allowed` of rows from `first` on by candidates `ids`."""
        offered = np.where(allowed, scores, NONE)
        floor = self.score[first : first + len(scores), -1]
        if offered.shape[1] > self.k:
            # the tile's own k-th best bounds what can enter, ties included
            cut = np.partition(offered, offered.shape[1] - self.k, axis=1)[:, offered.shape[1] - self.k]
            floor = np.maximum(floor, cut)
        row, col = np.nonzero((offered >= floor[:, None]) & allowed)
        if not len(row):
            return
        touched = np.unique(row)
        rows = np.concatenate([np.repeat(touched, self.k), row])
        score = np.concatenate([self.score[first + touched].ravel(), offered[row, col]])
        names = np.concatenate([self.id[first + touched].ravel(), ids[col]])
        # ~score falls as score grows, and cannot overflow
        order = np.lexsort((names, ~score, rows))
        rows, score, names = rows[order], score[order], names[order]
        start = np.r_[0, np.flatnonzero(np.diff(rows)) + 1]
        place = np.arange(len(rows)) - np.repeat(start, np.diff(np.r_[start, len(rows)]))
        best = place < self.k
        self.score[first + rows[best], place[best]] = score[best]
        self.id[first + rows[best], place[best]] = names[best]

    def filled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, id and score of every entry."""
        row, place = np.nonzero(self.score != NONE)
        return row, self.id[row, place], self.score[row, place]


def scaled(vectors: DataFrame, scale: int, label: Column, is_anchor: Column) -> DataFrame:
    """vec_id, label, anchor and whole components v of the rows that can take part."""

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))

    def whole(x: Column) -> Column:
        # beyond the limits the norm rules the row out
        limit = F.lit(float(1 << 62))
        return F.floor(F.greatest(F.least(x.cast("double") * scale, limit), -limit))

    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return (
        vectors.where(
            F.col("vec_id").isNotNull() & label.isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite)
        )
        .select("vec_id", label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
                F.transform("embedding", whole).alias("v"))
        .where(norm2 < MAX_NORM2)
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, zeros after the shorter ones."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), _places(lengths)] = flat
    return out


def _places(lengths: np.ndarray) -> np.ndarray:
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


class _Cell:
    """Anchors of a cell and the heaps that its candidates fill."""

    def __init__(self, k: int, low: int, high: int, negatives: bool):
        self.k, self.low, self.high, self.negatives = k, low, high, negatives
        self.parts: list[tuple] = []
        self.waiting: list[tuple] = []
        self.rows = 0
        self.heaps: Heaps | None = None

    def anchors(self, part: tuple) -> None:
        self.parts.append(part)

    def candidates(self, part: tuple) -> None:
        self.waiting.append(part)
        self.rows += len(part[0])
        if self.rows >= TILE_ROWS:
            self.flush()

    def _ready(self) -> bool:
        if self.heaps is None and self.parts:
            ids, labels, v, pos_id, pos_score = zip(*self.parts)
            self.ids, order = np.unique(np.concatenate(ids), return_index=True)
            self.labels, self.v = np.concatenate(labels)[order], _stacked(v)[order]
            if self.negatives:
                lists = [x for part in pos_score for x in part], [x for part in pos_id for x in part]
                self.pos_score = [lists[0][o] for o in order]
                self.pos_id = [lists[1][o] for o in order]
                self.width = max(map(len, self.pos_score))
                # a window that no score reaches stands for positives that are not there
                self.top = np.full((len(self.ids), self.width), NONE)
                self.bottom = np.full((len(self.ids), self.width), np.iinfo(np.int64).max)
                for i, scores in enumerate(self.pos_score):
                    for p, s in enumerate(scores):
                        whole, rest = divmod(s, self.high)
                        down = whole * (self.high - self.low) + rest * (self.high - self.low) // self.high
                        self.top[i, p], self.bottom[i, p] = s, s - down
                self.heaps = [Heaps(len(self.ids), self.k) for _ in range(self.width)]
            else:
                self.heaps = [Heaps(len(self.ids), self.k)]
            self.parts = []
        return self.heaps is not None

    def flush(self) -> None:
        waiting, self.waiting, self.rows = self.waiting, [], 0
        if not waiting or not self._ready():
            return
        ids, labels, v, _, _ = zip(*waiting)
        ids, labels, v = np.concatenate(ids), np.concatenate(labels), _stacked(v)
        width = max(v.shape[1], self.v.shape[1])
        if self.v.shape[1] < width:
            self.v = np.pad(self.v, ((0, 0), (0, width - self.v.shape[1])))
        across = np.ascontiguousarray(np.pad(v, ((0, 0), (0, width - v.shape[1]))).T)
        for first in range(0, len(self.ids), TILE_ANCHORS):
            own = slice(first, first + TILE_ANCHORS)
            scores = strassen(self.v[own], across)
            same = self.labels[own, None] == labels[None, :]
            if self.negatives:
                for p, heaps in enumerate(self.heaps):
                    inside = ~same & (scores <= self.top[own, p, None]) & (scores >= self.bottom[own, p, None])
                    heaps.push(first, scores, inside, ids)
            else:
                self.heaps[0].push(first, scores, same & (self.ids[own, None] != ids[None, :]), ids)

    def rows_out(self):
        """anchor_id, positive_id, positive_score, id, score."""
        self.flush()
        for p, heaps in enumerate(self.heaps or []):
            row, ids, scores = heaps.filled()
            yield (
                self.ids[row],
                np.array([self.pos_id[r][p] for r in row], np.int64) if self.negatives else ids,
                np.array([self.pos_score[r][p] for r in row], np.int64) if self.negatives else scores,
                ids,
                scores,
            )


def _stacked(parts) -> np.ndarray:
    width = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])


def _best(anchors: DataFrame, rows: DataFrame, k: int, low: int, high: int, negatives: bool) -> DataFrame:
    """Heaps of every cell: anchor_id, positive_id, positive_score, id, score."""
    spark = rows.sparkSession
    groups = max(1, -(-anchors.count() // CELL_ANCHORS))
    spans = max(1, -(-rows.count() // CELL_ROWS))
    hashed = F.xxhash64("vec_id")
    if not negatives:
        anchors = anchors.withColumns({"pos_id": F.array().cast("array<long>"), "pos_score": F.array().cast("array<long>")})
    # rows of one id meet in one cell, where all but the least go
    left = anchors.select(
        F.explode(F.sequence(F.lit(0), F.lit(spans - 1))).alias("span"), F.pmod(hashed, F.lit(groups)).cast("int").alias("group"),
        F.lit(0).alias("kind"), "vec_id", "label", "v", "pos_id", "pos_score")
    right = rows.select(
        F.pmod(hashed, F.lit(spans)).cast("int").alias("span"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
        F.lit(1).alias("kind"), "vec_id", "label", "v", F.lit(None).cast("array<long>").alias("pos_id"),
        F.lit(None).cast("array<long>").alias("pos_score"))
    cells = left.unionByName(right).select(
        (F.col("span") * groups + F.col("group")).alias("cell"), "kind", "vec_id", "label", "v", "pos_id", "pos_score")
    placed = cells.repartitionById(groups * spans, F.col("cell")).sortWithinPartitions("cell", "kind", "vec_id", "label", "v")
    out = spark.createDataFrame([], "anchor_id long, positive_id long, positive_score long, id long, score long").schema
    arrow = to_arrow_schema(out)

    def run(batches):
        now, cell, last = None, None, None

        def done():
            for columns in cell.rows_out():
                yield to_batch(dict(zip(arrow.names, columns)), arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            names, kind, ids = (batch.column(i).to_numpy() for i in (0, 1, 2))
            new = np.ones(len(ids), bool)
            new[1:] = (ids[1:] != ids[:-1]) | (kind[1:] != kind[:-1]) | (names[1:] != names[:-1])
            new[0] = last != (names[0], kind[0], ids[0])
            last = (names[-1], kind[-1], ids[-1])
            batch = batch.filter(pa.array(new))
            if not batch.num_rows:
                continue
            names, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (kind[1:] != kind[:-1]), True])
            for a, b in zip(edges[:-1], edges[1:]):
                if names[a] != now:
                    if cell is not None:
                        yield from done()
                    now, cell = names[a], _Cell(k, low, high, negatives)
                part = batch.slice(a, b - a)
                v = part.column(4)
                width = max(1, int(v.value_lengths().to_numpy(zero_copy_only=False).max()))
                row = (part.column(2).to_numpy(), part.column(3).to_numpy(), _matrix(v, width),
                       part.column(5).to_pylist(), part.column(6).to_pylist())
                (cell.anchors if kind[a] == 0 else cell.candidates)(row)
        if cell is not None:
            yield from done()

    return map_arrow(placed, run, out)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, scale: int = 256,
    positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `vectors` needs vec_id (long) and embedding (numbers); `label` and `is_anchor` are expressions on
    it. A component x counts as floor(scale * x). An anchor's positives are its `positives` best other
    rows of the same label; for each, the `negatives` best rows of another label with
    low * positive_score <= high * negative_score <= high * positive_score follow, rank 1 the best.
    Equal scores go by smaller vec_id.

    Rows with a null vec_id, label, vector or component, a component that is not finite, or a scaled norm of
    2**31 or more (scores beyond 64 bits) take no part. Rows that repeat a vec_id are one row, the one with
    the smallest label, then vector. Vectors of different length count as padded with zeros. An anchor
    without positives, or a positive without rows in its window, has no rows; an empty table gives none.
    """
    rows = written(scaled(vectors, scale, label, is_anchor))
    anchors = rows.where("anchor").drop("anchor")
    rows = rows.drop("anchor")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    top = written(
        _best(anchors, rows, positives, low, high, False)
        .withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    )
    lists = top.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("p"))
    with_lists = written(anchors.join(lists, "vec_id").select(
        "vec_id", "label", "v", F.col("p.id").alias("pos_id"), F.col("p.score").alias("pos_score")))
    each = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
    return (
        _best(with_lists, rows, negatives, low, high, True)
        .withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
