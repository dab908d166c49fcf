"""Secret scan by dictionary-primed zstandard novelty.

Three patterns make the base, always reported. Beyond them, every long token after a sensitive
word is a candidate, and so are the tokens adjoining it and the body of a key block. A candidate's
novelty is what it adds, in compressed bytes per character, to its surrounding code under a
compressor primed with the identifiers that the corpus uses around candidates: names, paths and
repeated boilerplate compress away, key material does not. Letters in the proportions of plain
writing go ahead, so that words cost less than key material however short the surroundings are.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.text import map_batches, texts
from shelfwise.scale import written

ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Lines around the body of a key, and what may be left of the body after its last long line.
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----|-----END")
REST = re.compile(r"(?:\\[rn]|[^A-Za-z0-9+/_=])*([A-Za-z0-9+/_=]{1,15})(?:\\[rn]|[^A-Za-z0-9+/_=])*")
SENSITIVE = re.compile(
    r"(?:key|secret|token|passw|pwd|auth|bearer|credential|private|signature|cert|ssh|session|cookie)", re.I | re.A
)
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_.]{3,40}"
#: Characters before a candidate in which a sensitive word counts, and the code it is measured against.
NEAR, AROUND = 48, 256
#: Identifiers in the dictionary, most used first; a resource bound of the compressor (about 64 KB).
DICTIONARY = 4096
#: Compressed bytes a character adds at least.
NOVEL = 0.7
#: A longer value is measured in equal pieces of at most so many characters; one novel piece suffices.
PIECE = 512
#: Characters of plain writing in a thousand.
PLAIN = dict(zip("etaonirshldcumfgpywbvk_-/.xjqzAEISTCRNPDMLOBF0123+=:", [
    115, 82, 75, 68, 62, 65, 58, 56, 50, 38, 38, 29, 25, 24, 21, 19, 20, 17, 19, 14, 10, 8, 8, 6, 6, 6, 3, 2, 2, 2,
    *[2] * 15, *[2] * 4, 1, 2, 2,
]))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def key_blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of the bodies between a BEGIN line with a sensitive word and the next END or BEGIN line."""
    out, opened = [], None
    for m in ARMOUR.finditer(text):
        if opened is not None:
            out.append((opened, m.start()))
        opened = m.end() if m[1] and SENSITIVE.search(m[1]) else None
    return out


def tokens(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, end of the key block or 0) of long tokens with a letter, in order."""
    at = 0
    for a, b in [*key_blocks(text), (len(text), len(text))]:
        for lo, hi, block in ((at, a, 0), (a, b, b)):
            for m in CANDIDATE.finditer(text, lo, hi):
                if any(c.isalpha() for c in m.group()):
                    yield m.start(), m.end(), block
        at = b


def candidates(
    text: str, base: list[tuple[int, int, int]]
) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """(surrounding code, [(start, end, value)]) of adjoining tokens worth measuring, outside the base spans.

    The sensitive word stands before the first of them. The lines of a key block are one value.
    """
    if not SENSITIVE.search(text):
        return
    starts, reach = [s for s, _, _ in base], [0]
    for _, _, e in base:
        reach.append(max(reach[-1], e))
    chain: list[tuple[int, int, str]] = []
    # the last token in context, whether it is in the chain or in a base span
    last, before = None, 0

    def done():
        s, e = chain[0][0], chain[-1][1]
        return text[max(0, s - AROUND) : s] + text[e : e + AROUND], chain

    for s, e, block in tokens(text):
        adjoins = last is not None and not any(c.isalnum() for c in text[last:s])
        near = SENSITIVE.search(text, max(0, s - NEAR), s)
        if not (block or near or adjoins):
            last = None
            continue
        if not block and reach[bisect_left(starts, e)] > s:
            last = e
            continue
        if block and block == before and adjoins:
            chain[-1] = (chain[-1][0], e, chain[-1][2] + text[s:e])
        else:
            if chain and (block or near or not adjoins):
                yield done()
                chain = []
            chain.append((s, e, text[s:e]))
        last, before = e, block
        if block and (rest := REST.fullmatch(text, e, block)):
            last = rest.end(1)
            chain[-1] = (chain[-1][0], last, chain[-1][2] + rest[1])
    if chain:
        yield done()


@lru_cache(maxsize=2)
def compressor(dictionary: bytes):
    import zstandard

    if not dictionary:
        return zstandard.ZstdCompressor(level=3)
    primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=primed)


@lru_cache(maxsize=1)
def plain() -> bytes:
    """PLAIN twice over in a fixed shuffled order: nothing in it repeats, so only its proportions count."""
    letters = [c for c, n in PLAIN.items() for _ in range(2 * n)]
    random.Random(1).shuffle(letters)
    return "".join(letters).encode()


def novelty(value: str, around: str, dictionary: bytes) -> float:
    """Compressed bytes that `value` adds to `around`, per character; the most that a piece adds.

    A value without small letters counts as if written small: its case tells nothing.
    """
    c = compressor(dictionary)
    if value.upper() == value:
        value, around = value.lower(), around.lower()
    context = plain() + around.encode() + b" "
    before, size = len(c.compress(context)), -(-len(value) // -(-len(value) // PIECE))
    pieces = [value[i : i + size] for i in range(0, len(value), size)]
    return max((len(c.compress(context + p.encode())) - before) / len(p) for p in pieces)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_secrets(docs: DataFrame, novel: float = NOVEL) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel.

    `docs` needs doc_id and text; a null or empty text has no spans. Offsets are code points, ends
    exclusive. Repeated rows come out each. Texts are read once; the identifier counts cover the
    surroundings of every candidate of every document.
    """

    def scan(batch):
        base, found = [], []
        for raw in texts(batch):
            text = raw.decode()
            base.append(spans := base_spans(text))
            found.append([
                {"around": a, "parts": [{"start": s, "end": e, "value": v} for s, e, v in parts]}
                for a, parts in candidates(text, spans)
            ])
        return {
            "doc_id": batch.column(0),
            "base": [[{"start": s, "kind": k, "end": e} for s, k, e in spans] for spans in base],
            "found": found,
        }

    spans = written(map_batches(
        docs.select("doc_id", "text"), scan,
        "doc_id long, base array<struct<start:long,kind:int,end:long>>, "
        "found array<struct<around:string,parts:array<struct<start:long,end:long,value:string>>>>",
    ))
    words = spans.select(
        F.explode(F.array_distinct(F.flatten(F.transform(
            "found", lambda c: F.regexp_extract_all(c["around"], F.lit(IDENTIFIER), F.lit(0))
        )))).alias("word")
    ).groupBy("word").count()
    top = words.where("count > 1").orderBy(F.desc("count"), "word").limit(DICTIONARY).collect()
    # zstandard reaches the end of a dictionary most cheaply
    dictionary = " ".join(r["word"] for r in reversed(top)).encode()

    def judge(batch):
        rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")}
        for base, found in rows:
            own = [(s["start"], s["kind"], s["end"]) for s in base]
            more = [
                (p["start"], 3, p["end"])
                for c in found for p in c["parts"] if novelty(p["value"], c["around"], dictionary) >= novel
            ]
            for k, name in enumerate(KINDS[:3]):
                out[f"n_{name}"].append(sum(x[1] == k for x in own))
            out["base_sha256"].append(hashlib.sha256(_joined(own).encode()).hexdigest())
            out["spans"].append(_joined(own + more))
            out["n_novel"].append(len(more))
        return out | {"doc_id": batch.column(0)}

    return map_batches(
        spans, judge,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long",
    )
