"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Documents are rows, distinct word n-grams (64-bit hashes) columns. Two rows link when
`den * |A & B| >= num * |A | B|`. From the sizes follow two bounds: a partner holds at least
`num/den` as many n-grams, and the rows differ in at most `(|A|+|B|) * (den-num) / (den+num)`
columns.

1. Columns are cut into more blocks than a pair of that size may differ in, so a linked pair agrees
   on a whole block. About 10 percent more blocks than that are cut: a row with no more empty blocks
   than are spare need not show them, as an agreement that is not empty is left over. Each row contributes one hash per block; the product over blocks is
   taken in column stripes, a stripe per task, and names the rows that agree somewhere. Unlike
   single n-grams, a block holds many, so a passage that many documents share makes no pairs.
2. Rows that agree on a block are compared by their column counts in cells, about one for each
   dozen columns, and by the parity of 512 finer ones; neither distance ever exceeds the
   difference, the first tells long rows apart, the second short ones. Pairs beyond the size-derived bound are discarded.
3. The rest are multiplied exactly, stripe by stripe, and dropped as soon as the count so far plus
   what is left cannot reach the bound.

Groups of near copies are not expanded to all pairs. Rows of a block meet in parts of bounded size, and
no step gives more rows than it takes:

* the first round multiplies a spanning forest of each part, the second one of the components' smallest
  rows, which joins the parts;
* rows that could still link with another component of their block (by pairs of parts) are named, not
  their pairs; those named are compared once more by finer parities. Only the sets that are left are brought to the block, in tiles of bounded bytes that meet pairwise, are
  multiplied there, and each tile gives a spanning forest of links that hold.

Together they find every component exactly. Rows with equal sets are one row from the start. Templated
texts whose pairs all lie just beyond the bound still cost a comparison each, in memory, spread over tiles.

N-grams are compared by 64-bit hash: with a billion distinct sets, odds of one wrong merge are
about 3 percent.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from shelfwise.llm.text import keep_ids, map_arrow, map_batches, mix64, texts, to_batch
from shelfwise.scale import written

#: Count cells of a row at least, and columns per cell beyond that.
CELLS, PER_CELL = 32, 12
PARITIES = 512
STRIPES = 16
#: Rows of a block that meet in one task, and n-grams of a tile's side.
PART = 2048
TILE_GRAMS = 2_000_000
#: Rows of an output batch, about.
OUT_ROWS = 10_000
#: Block hashes a task gathers before it deals them out, and that a stripe holds on average.
FLUSH = 1_000_000
PER_STRIPE = 2_000_000


def ngram_set(raw: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of word n-grams; a text of fewer words is one n-gram."""
    words = raw.lower().split()  # bytes: A-Z only, and exactly the ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
    take = min(n, len(h))
    size = len(h) - take + 1
    acc = mix64(h[:size] + np.uint64(take))
    for i in range(1, take):
        acc = mix64(acc * np.uint64(0x100000001B3) + h[i : i + size])
    return np.unique(acc)


def set_id(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


@lru_cache(maxsize=8)
def bands(num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest size of each band; for pairs whose smaller row is in it, column blocks and spare ones."""
    last, blocks, spare, size = [], [], [], 1
    while size < 1 << 40:
        top = size * den // num
        need = (top + top * den // num) * (den - num) // (den + num) + 1
        last.append(top)
        spare.append(0 if need == 1 else -(-need // 10))
        blocks.append(need + spare[-1])
        size = top + 1
    return np.array(last), np.array(blocks), np.array(spare)


def block_hashes(grams: np.ndarray, num: int, den: int) -> np.ndarray:
    """A hash for each column block to show, at the levels where a partner may look."""
    last, blocks, spare = bands(num, den)
    own = int(np.searchsorted(last, len(grams)))
    mixed = mix64(grams)
    out = []
    for level in range(max(0, own - 1), own + 1):
        count = int(blocks[level])
        cut = (mixed >> np.uint64(33)).astype(np.int64) % count
        sums = np.zeros(count, np.uint64)
        np.add.at(sums, cut, grams)
        at = np.arange(count, dtype=np.uint64) + np.uint64(level << 40)
        own_blocks = mix64(sums ^ mix64(at))
        held = np.bincount(cut, minlength=count) > 0
        out.append(own_blocks[held] if count - held.sum() <= spare[level] else own_blocks)
    return np.concatenate(out)


def cells(grams: np.ndarray) -> bytes:
    """Parity bits of PARITIES cells, then counts (at most 255) of columns in a power of two of cells."""
    size = CELLS
    while size * PER_CELL < len(grams):
        size *= 2
    counts = np.bincount((grams >> np.uint64(7)).astype(np.int64) % size, minlength=size)
    odd = np.bincount((grams >> np.uint64(17)).astype(np.int64) % PARITIES, minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes()


def aligned(signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity words and cell counts of rows, counts folded to the coarsest row's cells."""
    bits = PARITIES // 8
    size = min(map(len, signatures)) - bits
    odd = np.frombuffer(b"".join(s[:bits] for s in signatures), np.uint64).reshape(len(signatures), -1)
    counts = [np.frombuffer(s, np.uint8, offset=bits).reshape(-1, size).sum(axis=0, dtype=np.int64) for s in signatures]
    return odd, np.stack(counts)


def parities(grams: np.ndarray) -> bytes:
    """Parity bits of a power of two of cells, four or more to a column: almost the whole difference shows."""
    size = 512
    while size < 4 * len(grams):
        size *= 2
    odd = np.bincount((grams >> np.uint64(17)).astype(np.int64) % size, minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def aligned_parities(signatures) -> tuple[np.ndarray, np.ndarray]:
    """Parity words folded to the coarsest row's cells; no counts."""
    size = min(map(len, signatures)) // 8
    odd = [np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, size), axis=0) for s in signatures]
    return np.stack(odd), np.zeros((len(odd), 1), np.int64)


SIGNATURES = {"cells": (cells, aligned), "parities": (parities, aligned_parities)}


def row_sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, set_id (null for an empty set)."""

    def run(batch):
        sets = [ngram_set(t, n) for t in texts(batch)]
        return {
            "doc_id": batch.column(0),
            "n_shingles": [len(s) for s in sets],
            "set_id": [set_id(s) if len(s) else None for s in sets],
        }

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, set_id long")


def agreeing_rows(docs: DataFrame, n: int, num: int, den: int, stripes: int) -> DataFrame:
    """(block, set_id) of every group of different rows that agree on a column block.

    Near copies agree on many blocks; groups of the same rows are named alike, and are one. Within
    a stripe, blocks are told apart by 32 bits more; a chance agreement only adds a candidate.
    """
    bits = (stripes - 1).bit_length()
    spark = docs.sparkSession
    dealt = spark.createDataFrame([], "stripe int, blocks binary, sets binary").schema
    found = spark.createDataFrame([], "block long, set_id long").schema
    dealt_arrow, found_arrow = to_arrow_schema(dealt), to_arrow_schema(found)

    def once(blocks, sets):
        order = np.lexsort((sets, blocks))
        blocks, sets = blocks[order], sets[order]
        new = np.ones(len(blocks), bool)
        new[1:] = (blocks[1:] != blocks[:-1]) | (sets[1:] != sets[:-1])
        return blocks[new], sets[new]

    def deal(batches):
        held, size = [], 0

        def flush():
            blocks, sets = once(
                np.concatenate([b for b, _ in held]),
                np.repeat(np.array([s for _, s in held], np.int64), [len(b) for b, _ in held]),
            )
            edges = np.searchsorted(blocks >> np.uint64(64 - bits), np.arange(stripes + 1)) if bits else [0, len(blocks)]
            rows = [(k, edges[k], edges[k + 1]) for k in range(stripes) if edges[k] < edges[k + 1]]
            return to_batch({
                "stripe": [k for k, _, _ in rows],
                "blocks": [blocks[a:b].astype(np.uint32).tobytes() for _, a, b in rows],
                "sets": [sets[a:b].tobytes() for _, a, b in rows],
            }, dealt_arrow)

        for batch in batches:
            for t in texts(batch):
                grams = ngram_set(t, n)
                if len(grams):
                    held.append((b := block_hashes(grams, num, den), set_id(grams)))
                    size += len(b)
                    if size >= FLUSH:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    def product(batches):
        def stripe(parts):
            blocks, sets = once(
                np.frombuffer(b"".join(b for b, _ in parts), np.uint32),
                np.frombuffer(b"".join(s for _, s in parts), np.int64),
            )
            first = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
            count = np.diff(np.r_[first, len(blocks)])
            name = mix64(np.add.reduceat(mix64(sets.view(np.uint64)), first))
            shared = np.flatnonzero(count > 1)
            shared = shared[np.unique(name[shared], return_index=True)[1]]
            kept = np.repeat(np.isin(np.arange(len(first)), shared), count)
            return to_batch({
                "block": pa.array(np.repeat(name, count)[kept].view(np.int64)), "set_id": pa.array(sets[kept]),
            }, found_arrow)

        parts = [
            pair
            for batch in batches
            for pair in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
        ]
        if parts:
            yield stripe(parts)

    by_stripe = map_arrow(docs.select("text"), deal, dealt).repartitionById(stripes, F.col("stripe"))
    return map_arrow(by_stripe, product, found).distinct()


def candidate_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, n: int, column: str) -> DataFrame:
    """set_id, size and a signature or the sorted "grams" of the sets that `wanted` names, written, once per set."""
    form = SIGNATURES[column][0] if column in SIGNATURES else np.ndarray.tobytes

    def run(batch):
        sets = [ngram_set(t, n) for t in texts(batch)]
        return {
            "set_id": [set_id(s) if len(s) else None for s in sets],
            "size": [len(s) for s in sets],
            column: [form(s) for s in sets],
        }

    ids = written(
        classes.join(wanted.select("set_id").distinct(), "set_id").select(F.col("first_id").alias("doc_id")).distinct()
    )
    some = keep_ids(docs.select("doc_id", "text"), ids, "doc_id", "left_semi").select("text")
    if not ids.where("doc_id is null").isEmpty():  # sets that only rows without id have
        some = some.unionAll(docs.where("doc_id is null").select("text"))
    found = written(map_batches(some, run, f"set_id long, size long, {column} binary").where("set_id is not null"))
    # ids are as good as unique: only where rows repeat one do sets come twice
    if found.count() == found.select("set_id").distinct().count():
        return found
    return written(found.dropDuplicates(["set_id"]))


def in_parts(rows: DataFrame, weight: Column, limit: int, pairwise: bool) -> DataFrame:
    """Rows with `cell` (long) and `part`: blocks of more than `limit` weight are cut into parts by id.

    A cell is a part or, `pairwise`, two of them; the rows then come once for each part of their block.
    Cells are named by hash: should two ever share a name, rows only meet more rows than needed.
    """
    heavy = rows.groupBy("block").agg(F.sum(weight).alias("_w")).where(F.col("_w") > limit)
    cut = rows.join(heavy.select("block", F.ceil(F.col("_w") / limit).cast("int").alias("_n")), "block", "left").withColumn(
        "_n", F.coalesce("_n", F.lit(1)))
    part = F.pmod(F.xxhash64("set_id"), F.col("_n")).cast("int")
    cut = cut.withColumn("part", part)
    if not pairwise:
        return cut.withColumn("cell", F.xxhash64("block", "part")).drop("_n")
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    return cut.withColumn("_o", other).withColumn(
        "cell", F.xxhash64("block", F.least("part", "_o"), F.greatest("part", "_o"))).drop("_n", "_o")


def by_cell(rows: DataFrame, work, schema: StructType) -> DataFrame:
    """What `work(columns)` finds in the rows of each cell: arrays of longs, or None. `cell` is the first column."""
    arrow = to_arrow_schema(schema)

    def arrays(batch):
        out = []
        for c in batch.columns:
            if pa.types.is_binary(c.type):
                own = np.empty(len(c), object)
                own[:] = c.to_pylist()
                out.append(own)
            else:
                out.append(c.to_numpy())
        return out

    def complete(batches):
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = arrays(batch)
            cell = columns[0]
            edges = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
            for x, y in zip(edges[:-1], edges[1:]):
                if held and held[-1][0][0] != cell[x]:
                    yield [np.concatenate(c) for c in zip(*held)]
                    held = []
                held.append([c[x:y] for c in columns])
        if held:
            yield [np.concatenate(c) for c in zip(*held)]

    def run(batches):
        out, size = [], 0

        def flush():
            return to_batch(dict(zip(arrow.names, map(np.concatenate, zip(*out)))), arrow)

        for columns in complete(batches):
            found = work(columns) if len(columns[0]) > 1 else None
            if found is not None:
                out.append(found)
                size += len(found[0])
                if size >= OUT_ROWS:
                    yield flush()
                    out, size = [], 0
        if out:
            yield flush()

    return map_arrow(rows.repartition("cell").sortWithinPartitions("cell"), run, schema)


def passing(i, j, sizes: np.ndarray, sig: tuple, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows j row i may link with by both bounds, and their distances at least."""
    low, high = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    odd, counts = sig
    apart = np.abs(counts[j] - counts[i]).sum(axis=-1)
    apart = np.maximum(apart, np.bitwise_count(odd[j] ^ odd[i]).sum(axis=-1, dtype=np.int64))
    return (low * den >= high * num) & (apart <= (low + high) * (den - num) // (den + num)), apart


def spanning_pairs(members: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): a spanning forest of the pairs within each cell that pass both bounds.

    `members` has cell, set_id, size, cells.
    """
    out = members.sparkSession.createDataFrame([], "a long, b long").schema

    def forest(columns):
        """Prim's, nearest first. Ties go to the pair with the smallest id, so that cells with many
        rows in common choose the same pairs."""
        _, ids, sizes, sig = columns
        sig = aligned(sig)
        rest, new = np.arange(1, len(ids)), 0
        best = np.full(len(ids) - 1, np.iinfo(np.int64).max)
        link = np.zeros(len(ids) - 1, np.int64)
        a, b = [], []
        while len(rest):
            ok, apart = passing(new, rest, sizes, sig, num, den)
            far = (apart << 32) + (np.minimum(ids[new], ids[rest]) >> 32) + (1 << 31)
            nearer = ok & (far < best)
            best[nearer], link[nearer] = far[nearer], new
            at = int(best.argmin())
            new = int(rest[at])
            if best[at] < np.iinfo(np.int64).max:
                a.append(ids[link[at]])
                b.append(ids[new])
            left = np.arange(len(rest)) != at
            rest, best, link = rest[left], best[left], link[left]
        return (np.minimum(a, b), np.maximum(a, b)) if a else None

    return by_cell(members.select("cell", "set_id", "size", "cells"), forest, out).distinct()


def contested(members: DataFrame, num: int, den: int, signature: str = "cells") -> DataFrame:
    """(block, set_id, component) of rows that pass both bounds with a row of another component of their block.

    `members` has block, set_id, size, component and the signature. At most as many rows as come in.
    """
    folded = SIGNATURES[signature][1]
    out = members.sparkSession.createDataFrame([], "block long, set_id long, component long").schema

    def named(columns):
        _, block, ids, sizes, sig, component, part = columns
        if (component == component[0]).all():
            return None
        sig = folded(sig)
        hit = np.zeros(len(ids), bool)
        two = (part != part[0]).any()
        for i in range(len(ids) - 1):
            j = np.arange(i + 1, len(ids))
            # two parts: rows of one part meet in that part's own cell
            j = j[(component[j] != component[i]) & ((part[j] != part[i]) | ~two)]
            if len(j):
                ok = j[passing(i, j, sizes, sig, num, den)[0]]
                hit[ok] = True
                hit[i] |= len(ok) > 0
        return block[hit], ids[hit], component[hit]

    met = in_parts(members, F.lit(1), PART, True)
    return by_cell(met.select("cell", "block", "set_id", "size", signature, "component", "part"), named, out).distinct()


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets overlap enough, counted stripe by stripe until it cannot be."""
    need = -(-num * (len(x) + len(y)) // (num + den))
    step = np.linspace(0, 2**64 - 1, STRIPES + 1)[1:-1].astype(np.uint64)
    ex, ey = (np.r_[0, np.searchsorted(v, step), len(v)] for v in (x, y))
    overlap, left = 0, np.minimum(len(x) - ex, len(y) - ey)
    for k in range(STRIPES):
        if overlap + left[k] < need:
            return False
        both = np.concatenate([x[ex[k] : ex[k + 1]], y[ey[k] : ey[k + 1]]])
        both.sort()
        overlap += int((both[1:] == both[:-1]).sum())
    return overlap >= need


def links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose exact overlap reaches the bound."""

    def run(batch):
        keep = [
            linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den)
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
        ]
        kept = pa.array(keep, pa.bool_())
        return {"a": batch.column(0).filter(kept), "b": batch.column(1).filter(kept)}

    side = sets.select("set_id", "grams")
    both = pairs.join(side.toDF("a", "x"), "a").join(side.toDF("b", "y"), "b")
    return map_batches(both.select("a", "b", "x", "y"), run, "a long, b long")


def joining_links(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links that hold between components of a block; of each tile a spanning forest.

    `rows` has block, set_id, size, grams, component. A tile gives fewer rows than it takes.
    """
    out = rows.sparkSession.createDataFrame([], "a long, b long").schema

    def forest(columns):
        _, ids, sizes, grams, component = columns
        names, root = np.unique(component, return_inverse=True)
        if len(names) == 1:
            return None
        sets = [np.frombuffer(g, np.uint64) for g in grams]
        sig = aligned_parities([parities(s) for s in sets])
        i, j, apart = [], [], []
        for k in range(len(ids) - 1):
            rest = np.arange(k + 1, len(ids))
            rest = rest[root[rest] != root[k]]
            if len(rest):
                ok, far = passing(k, rest, sizes, sig, num, den)
                j.append(rest[ok])
                i.append(np.full(ok.sum(), k))
                apart.append(far[ok])
        i, j, apart = map(np.concatenate, (i, j, apart))
        a, b = [], []
        for at in np.argsort(apart, kind="stable"):
            x, y = int(i[at]), int(j[at])
            if root[x] != root[y] and linked(sets[x], sets[y], num, den):
                a.append(ids[x])
                b.append(ids[y])
                root[root == root[y]] = root[x]
        return (np.array(a), np.array(b)) if a else None

    met = in_parts(rows, F.col("size"), TILE_GRAMS, True)
    return by_cell(met.select("cell", "set_id", "size", "grams", "component"), forest, out)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node each node reaches, by alternating star contractions."""

    def neighbours(e):
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )

    def state(e):
        return e.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()

    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while (after := state(now)) != before:
        before = after
        both = neighbours(now)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = (
            large.join(low, large["a"] == low["u"])
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        now = written(small)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def ngram_jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_class.

    `docs` needs doc_id (long) and text; other columns are ignored. component_id is the smallest
    doc_id reachable by links; n_class the number of rows with the same n-gram set. A null, empty
    or blank text has an empty set, links with nothing and is its own component (n_class 1). Repeated
    rows come out once each. A row whose doc_id is null takes part like any other; it cannot lend
    its id, so a component made of such rows alone has a null component_id.
    """
    rows = written(row_sets(docs, n))
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    per_row = 2 * (den - num) / num
    stripes = 1 << max(3, int(np.ceil(np.log2(max(1, total * per_row / PER_STRIPE)))))
    agree = written(agreeing_rows(docs, n, num, den, stripes))
    classes = written(
        rows.where("set_id is not null")
        .groupBy("set_id")
        .agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_class"))
    )
    sets = candidate_sets(docs, classes, agree, n, "cells")
    members = written(agree.join(sets, "set_id"))

    def held(cells_of: DataFrame) -> DataFrame:
        # only rows of pairs within the bounds are multiplied, so only theirs are written as sets
        pairs = written(spanning_pairs(cells_of, num, den))
        named = pairs.select(F.col("a").alias("set_id")).unionAll(pairs.select("b"))
        return written(links(pairs, candidate_sets(docs, classes, named, n, "grams"), num, den))

    def apart(roots: DataFrame) -> DataFrame:
        """Rows of blocks that still hold several components, with theirs."""
        now = members.join(roots, members["set_id"] == roots["node"], "left").select(
            members["*"], F.coalesce("root", "set_id").alias("component"))
        split = now.groupBy("block").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a <> _b")
        return written(now.join(split.select("block"), "block", "left_semi"))

    found = held(in_parts(members, F.lit(1), PART, False))
    roots = components(found)
    rest = apart(roots)
    if not rest.isEmpty():
        first = F.min(F.struct("set_id", "size", "cells")).alias("_f")
        ends = rest.groupBy("block", "component").agg(first).select("block", "_f.*")
        more = held(in_parts(ends, F.lit(1), PART, False))
        if not more.isEmpty():
            found = written(found.unionAll(more))
            roots = components(found)
            rest = apart(roots)
        named = written(contested(rest, num, den))
        sharp = candidate_sets(docs, classes, named, n, "parities")
        named = written(contested(named.join(sharp, "set_id"), num, den, "parities"))
        grams = candidate_sets(docs, classes, named, n, "grams")
        last = written(joining_links(named.join(grams, "set_id"), num, den))
        if not last.isEmpty():
            roots = components(found.unionAll(last))
    placed = classes.join(roots, classes["set_id"] == roots["node"], "left").select(
        "set_id", "first_id", "n_class", F.coalesce("root", "set_id").alias("root")
    )
    lowest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    per_set = placed.join(lowest, "root").select("set_id", "component_id", "n_class")
    return rows.join(per_set, "set_id", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_class", F.lit(1)).cast("long").alias("n_class"),
    )


def drop_near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """`docs` with one document of each component: the one with the smallest doc_id.

    Columns are those of `docs`. Where that id is on several rows, one of them stays. Rows without
    text, and rows without doc_id, all stay.
    """
    found = ngram_jaccard_components(docs, n, num, den)
    gone = written(
        found.where("n_shingles > 0 and doc_id <> component_id").select("doc_id").distinct()
    )
    kept = keep_ids(docs, gone, "doc_id", "left_anti")
    again = written(
        found.where("n_shingles > 0 and doc_id = component_id")
        .groupBy("doc_id").count().where("count > 1").select("doc_id")
    )
    if again.isEmpty():
        return kept
    once = keep_ids(kept, again, "doc_id", "left_anti")
    blank = F.coalesce(F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")), F.lit(0)) == 0
    repeated = keep_ids(kept, again, "doc_id", "left_semi")
    return once.unionByName(repeated.where(blank)).unionByName(
        repeated.where(~blank).dropDuplicates(["doc_id"])
    )
