"""Best-two-fit packing of tokenised documents into sequences of fixed length.

A sequence is filled greedily, largest piece first; if a gap is left, its smallest piece is
replaced by two unpacked ones that fit the widened gap more tightly. Only pieces shorter than a
sequence are packed: a longer document is cut so that its first piece takes the remainder.

Lengths, not tokens, are packed. Pieces are dealt at random into groups of about GROUP, each packed
in a task; a group wastes at most part of one sequence, so groups cost below 0.01 percent.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from shelfwise.llm.text import map_arrow, texts, to_batch
from shelfwise.scale import written

#: Pieces packed together; bounds a task's memory.
GROUP = 50_000
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """texts -> ids. `vocabulary` is a byte-level BPE file of `tokenizers`.

    Ordinary texts take the faster `tiktoken` with the same merges, read from the `.tiktoken` file
    beside it where there is one; texts that spell the special token take `tokenizers` itself.
    """
    import base64
    import os

    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(vocabulary)
    ranks_file = os.path.splitext(vocabulary)[0] + ".tiktoken"
    if not os.path.exists(ranks_file):
        return lambda ts: [e.ids for e in exact.encode_batch(ts, add_special_tokens=False)]
    import public_tokenizers
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(ts: list[str]) -> list[list[int]]:
        return [
            exact.encode(t, add_special_tokens=False).ids if SPECIAL in t else fast.encode_ordinary(t)
            for t in ts
        ]

    return encode


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, length: int, vocabulary: str, with_ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, row (unique) and, if asked, ids."""
    schema = docs.sparkSession.createDataFrame(
        [],
        "doc_id long, piece int, start long, length long, ids_crc32 long, row long"
        + ", ids array<int>" * with_ids,
    ).schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        from pyspark import TaskContext

        encode = encoder(vocabulary)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in arrow}
            doc_ids = batch.column(0).to_pylist()
            for doc_id, raw in zip(doc_ids, texts(batch)):
                ids = np.array([*encode([raw.decode()])[0], 0], "<u4")
                first = (len(ids) - 1) % length + 1
                for k, start in enumerate([0, *range(first, len(ids), length)]):
                    part = ids[start : first if k == 0 else start + length]
                    out["doc_id"].append(doc_id)
                    out["piece"].append(k)
                    out["start"].append(start)
                    out["length"].append(len(part))
                    out["ids_crc32"].append(zlib.crc32(part.tobytes()))
                    out["row"].append(row)
                    if with_ids:
                        out["ids"].append(part.astype(np.int32))
                    row += 1
            yield to_batch(out, arrow)

    return map_arrow(docs.select("doc_id", "text"), run, schema)


def best_two_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; every length is 1 to `room`."""
    order = np.argsort(lengths, kind="stable")
    waiting: dict[int, list[int]] = {}
    for i in order[::-1]:
        waiting.setdefault(int(lengths[i]), []).append(int(i))
    # bit x of `has`, and bit room - x of `mirror`: pieces of length x are waiting
    has = sum(1 << x for x in waiting)
    mirror = sum(1 << (room - x) for x in waiting)

    def take(x: int) -> int:
        nonlocal has, mirror
        i = waiting[x].pop()
        if not waiting[x]:
            del waiting[x]
            has ^= 1 << x
            mirror ^= 1 << (room - x)
        return i

    def put(x: int, i: int) -> None:
        nonlocal has, mirror
        waiting.setdefault(x, []).append(i)
        has |= 1 << x
        mirror |= 1 << (room - x)

    def two(most: int, least: int) -> tuple[int, int] | None:
        """The waiting pair with the largest sum of `least` to `most`."""
        for total in range(most, least - 1, -1):
            fits = has & (mirror >> (room - total)) & ((1 << total) - 2)
            while fits:
                a = fits.bit_length() - 1
                if 2 * a != total or len(waiting[a]) > 1:
                    return a, total - a
                fits ^= 1 << a
        return None

    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    sequence = 0
    while has:
        bin_, gap = [], room
        while low := has & ((1 << (gap + 1)) - 1):
            x = low.bit_length() - 1
            bin_.append((x, take(x)))
            gap -= x
        if gap and has and len(bin_) > 1:
            small, i = bin_[-1]
            if pair := two(gap + small, small + 1):
                bin_[-1:] = [(x, take(x)) for x in pair]
                put(small, i)
        at = 0
        for x, i in bin_:
            where[i], offset[i] = sequence, at
            at += x
        sequence += 1
    return where, offset


def pack_documents(
    docs: DataFrame, length: int = 2048, vocabulary: str | None = None, with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    `docs` needs doc_id and text. Every document ends with id 0, so a null or empty text is a piece
    of one token. Repeated rows are packed each; a null doc_id stays null. Memory per task: one
    batch of texts, or one group of pieces.
    """
    found = written(pieces(docs, length, vocabulary or default_vocabulary(), with_ids))
    short = found.where(F.col("length") < length)
    groups = max(1, -(-short.count() // GROUP))
    schema = "row long, sequence_id long, offset long"
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)

    def pack(table):
        import pyarrow as pa

        order = np.argsort(table["row"].to_numpy())
        where, offset = best_two_fit(table["length"].to_numpy()[order], length)
        group = table["g"][0].as_py()
        return pa.table({
            "row": table["row"].to_numpy()[order],
            "sequence_id": (np.int64(group) << np.int64(33)) + 2 * where,
            "offset": offset,
        }).cast(arrow)

    packed = (
        short.select("row", "length", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("g"))
        .groupBy("g").applyInArrow(pack, schema)
    )
    alone = found.where(F.col("length") == length).withColumn("sequence_id", 2 * F.col("row") + 1).withColumn("offset", F.lit(0).cast("long"))
    return short.join(packed, "row").unionByName(alone).drop("row")
