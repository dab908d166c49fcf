"""Personal data by weak supervision, in DataFrame functions only.

Regex labelers propose spans: four strict kinds (the base, always reported) and weaker forms that
need support. Regex, gazetteer and context labelers vote yes, no or nothing on every span.
Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability
without any truth; its posteriors then train a logistic span classifier over votes, kind and shape,
which decides on the weaker spans.

Only counts per vote pattern reach the driver; their number is bounded by the kinds, votes and
shape buckets, not by the data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.scale import written

# Matches start where a run of their first characters starts or the last match ended; saying so
# keeps long runs linear. Possessive quantifiers keep Java's matcher off its stack. Neither changes
# what is matched: see test_pii_base_on_awkward_texts.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
WEAK = {
    "masked_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:[\[(](?i:dot)[\])]|\.)\x20?[A-Za-z0-9-]{1,63}+){1,8}+",
    "local_phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9A-Za-z])",
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
}
KINDS = (*BASE, *WEAK)
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
BEFORE, AFTER = 48, 16
#: Code points of the slices that a text is cut into, so that reading a place costs no walk from its start.
SLICE = 256

# Fixed word lists of the labelers.
MAIL_ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "co", "uk", "de", "fr", "es", "it", "eu")
CALLING_CODES = ("+1", "+33", "+34", "+39", "+44", "+49")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
CUES = (
    "mail", "contact", "contacto", "kontakt", "phone", "tel", "telefon", "call", "mobile", "fax", "ssn",
    "social", "security", "card", "visa", "iban", "account", "konto", "cuenta", "compte", "address", "reach",
)
COUNTER_CUES = ("version", "isbn", "order", "invoice", "build", "rev", "license", "licence", "serial", "section")

LABELERS = ("shape", "gazetteer", "context", "boundary", "variety")
EM_ROUNDS = 50
ACCEPT = 0.5


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total, i):
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    """Whether a base match counts."""
    count = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.when(count.between(13, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return count.between(9, 15)
    return F.lit(True)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once however often the body names it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def _running(values: Column, combine: Callable[[Column, Column], Column], neutral: int) -> Column:
    """Running totals of an int array: each round combines every element with the one 2^i before.

    A fold that appends to an array copies it at every step; this takes log2(size) rounds.
    """

    def rounds(v: Column) -> Column:
        def double(state: Column, i: Column) -> Column:
            earlier = F.concat(F.array_repeat(F.lit(neutral), F.pow(F.lit(2), i).cast("int")), state)
            return F.zip_with(state, F.slice(earlier, F.lit(1), F.size(v)), lambda a, b: combine(a, b))

        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(v))).cast("int"))
        return F.when(F.size(v) <= 1, v).otherwise(F.aggregate(steps, v, double))

    return _bound(values, rounds)


def _slices(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{SLICE}}}"), F.lit(0))


def _cut(slices: Column, start: Column, end: Column) -> Column:
    """Code points [start, end) of a text given as slices."""
    first = F.floor(start / SLICE).cast("int")
    count = F.floor((end - 1) / SLICE).cast("int") - first + 1
    part = F.array_join(F.slice(slices, first + 1, F.greatest(count, F.lit(0))), "")
    return F.substring(part, start - first * SLICE + 1, F.greatest(end - start, F.lit(0)))


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """Array of (kind, start, end, value): leftmost, non-overlapping, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = _bound(found, lambda m: F.zip_with(
        m, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)),
        lambda m, g: F.struct(m.alias("value"), F.length(m).alias("len"), (F.length(g) + F.length(m)).alias("step")),
    ))

    def placed(matches: Column) -> Column:
        return F.zip_with(
            matches, _running(F.transform(matches, lambda x: x["step"]), lambda a, b: a + b, 0),
            lambda x, end: F.struct(
                F.lit(kind).alias("kind"), (end - x["len"]).alias("start"), end.alias("end"), x["value"].alias("value")
            ),
        )

    return _bound(both, placed)


def _free(weak: Column, base: Column) -> Column:
    """The weak spans, in their order, that overlap no base span.

    In order of start, a span is free when no base span before it reaches beyond its start (running
    maximum of ends) and none after it starts before its end (running minimum of starts, backwards).
    """
    shape = ("start", "weak", "at", "end", "kind", "value")

    def marked(spans: Column, is_weak: int) -> Column:
        return F.transform(spans, lambda s, i: F.struct(
            s["start"].alias("start"), F.lit(is_weak).alias("weak"), i.alias("at"),
            s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))

    def among(ordered: Column) -> Column:
        far = 2**31 - 1
        reach = _running(F.transform(ordered, lambda s: F.when(s["weak"] == 0, s["end"]).otherwise(0)), F.greatest, 0)
        starts = F.transform(ordered, lambda s: F.when(s["weak"] == 0, s["start"]).otherwise(far))
        following = F.reverse(_running(F.reverse(starts), F.least, far))
        near = F.zip_with(reach, following, lambda r, f: F.struct(r.alias("reach"), f.alias("next")))
        both = F.zip_with(ordered, near, lambda s, n: F.struct(
            s["at"].alias("at"), *[s[c].alias(c) for c in shape if c != "at"], n["reach"].alias("reach"), n["next"].alias("next")))
        clear = F.filter(both, lambda s: (s["weak"] == 1) & (s["reach"] <= s["start"]) & (s["next"] >= s["end"]))
        return F.transform(F.array_sort(clear), lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "value")]))

    ordered = F.array_sort(F.concat(marked(base, 0), marked(weak, 1)))
    return F.when((F.size(weak) == 0) | (F.size(base) == 0), weak).otherwise(_bound(ordered, among))


def _any(words: Sequence[str]) -> str:
    return rf"(?i)(?<![a-z])(?:{'|'.join(words)})"


def _votes(span: Column, slices: Column) -> list[Column]:
    """One vote per labeler: 1 yes, -1 no, 0 nothing."""
    kind, value = span["kind"], span["value"]
    digits = _digits(value)
    before = _cut(slices, F.greatest(span["start"] - BEFORE, F.lit(0)), span["start"])
    after = _cut(slices, span["end"], span["end"] + AFTER)

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, 1).when(no, -1).otherwise(0)

    mail = kind.isin("email", "masked_email")
    shape = vote(
        F.when(mail, value.rlike(r"[A-Za-z]{2,}$"))
        .when(kind == "card", value.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})$"))
        .when(kind == "ip", ~value.rlike(r"^0"))
        .when(kind.isin("phone", "local_phone"), ~digits.rlike("^0{3}"))
        .when(kind == "national_id", ~value.rlike(r"^(?:000|666|9)|-00-|-0000$"))
        .otherwise(F.length(value).between(15, 40)),
        F.lit(True),
    )
    gazetteer = vote(
        F.when(mail, F.lower(value).rlike(rf"(?:{'|'.join(MAIL_ENDINGS)})$"))
        .when(kind == "card", digits.rlike(ISSUERS))
        .when(kind == "phone", value.rlike(rf"^(?:{'|'.join(c.replace('+', '[+]') for c in CALLING_CODES)})"))
        .otherwise(False),
        F.when(kind == "ip", value.rlike(r"^(?:0|127|255)\.")).when(kind == "card", F.lit(True)).otherwise(False),
    )
    context = vote(before.rlike(_any(CUES)), before.rlike(_any(COUNTER_CUES)))
    clean = ~before.rlike(r"[\p{L}\p{N}]$") & ~after.rlike(r"^[\p{L}\p{N}]")
    boundary = vote(clean, ~clean)
    kinds_of_digit = F.size(F.array_distinct(F.split(digits, "")))
    variety = F.when(mail, F.lit(0)).otherwise(vote(kinds_of_digit >= 4, kinds_of_digit <= 2))
    return [shape, gazetteer, context, boundary, variety]


def labelled_spans(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """`keep` columns and `spans`: array of (kind, start, end, base, votes, size, digits).

    Base spans come first, by kind then start; weaker ones that overlap a base span are left out.
    Work grows as n log n with the spans of a text.
    """
    text = F.coalesce("text", F.lit(""))
    # a marker each pattern needs; most documents have none
    marker = {"email": "@", "masked_email": r"[\[(](?i:at)[\])]", "phone": r"\+[0-9]", "iban": "[A-Z]{2}[0-9]{2}"}
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")

    def all_of(kind: str, pattern: str) -> Column:
        return F.when(text.rlike(marker.get(kind, "[0-9]")), _matches(text, kind, pattern)).otherwise(none)

    def valid_of(kind: str, pattern: str) -> Column:
        return F.filter(all_of(kind, pattern), lambda s: _valid(kind, s["value"]))

    base = F.concat(*[valid_of(k, p) for k, p in BASE.items()])
    weak = F.concat(*[all_of(k, p) for k, p in WEAK.items()])
    found = docs.select(*keep, text.alias("_text"), base.alias("_base"), weak.alias("_weak"))
    some = F.size("_base") + F.size("_weak") > 0
    found = found.select(
        *keep, "_base", _free(F.col("_weak"), F.col("_base")).alias("_free"),
        F.when(some, _slices(F.col("_text"))).otherwise(F.array().cast("array<string>")).alias("_slices"),
    )

    def labelled(spans, is_base: bool) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(
                s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                F.lit(is_base).alias("base"),
                F.concat_ws(" ", *[v.cast("string") for v in _votes(s, F.col("_slices"))]).alias("votes"),
                F.least(F.floor(F.length(s["value"]) / 8), F.lit(4)).cast("int").alias("size"),
                F.floor(4 * F.length(_digits(s["value"])) / F.length(s["value"])).cast("int").alias("digits"),
            ),
        )

    return found.select(*keep, F.concat(labelled("_base", True), labelled("_free", False)).alias("spans"))


def estimate(patterns: list[tuple[str, tuple[int, ...], int]]) -> tuple[list[dict], list[float]]:
    """EM over (kind, votes, count): P(vote | class) per labeler, and each pattern's posterior.

    Two classes, labelers independent given the class, a prior per kind. Starts from reliabilities
    a little better than chance, which fixes what class 1 means.
    """
    n = len(LABELERS)
    rates = [{(v, c): (0.5 if v == (1 if c else -1) else 0.25) for v in (-1, 0, 1) for c in (0, 1)} for _ in range(n)]
    prior = {k: 0.5 for k, _, _ in patterns}
    posterior: list[float] = []
    for _ in range(EM_ROUNDS):
        posterior = []
        for kind, votes, _ in patterns:
            odds = log(prior[kind]) - log(1 - prior[kind])
            odds += sum(log(rates[i][v, 1]) - log(rates[i][v, 0]) for i, v in enumerate(votes))
            posterior.append(1 / (1 + exp(-max(-50.0, min(50.0, odds)))))
        for kind in prior:
            of = [(p, c) for p, (k, _, c) in zip(posterior, patterns) if k == kind]
            # two pseudo-counts, so that a kind never becomes certain
            prior[kind] = (1 + sum(p * c for p, c in of)) / (2 + sum(c for _, c in of))
        for i in range(n):
            for cls in (0, 1):
                mass = {v: 1.0 for v in (-1, 0, 1)}
                mass[1 if cls else -1] = 2.0
                for p, (_, votes, c) in zip(posterior, patterns):
                    mass[votes[i]] += c * (p if cls else 1 - p)
                total = sum(mass.values())
                for v in mass:
                    rates[i][v, cls] = mass[v] / total
    return rates, posterior


def features(kind: str, votes: Sequence[int], size: int, digits: int) -> list[str]:
    return [f"kind={kind}", f"size={size}", f"digits={digits}", *[f"{name}={v}" for name, v in zip(LABELERS, votes)]]


def train(rows: list[tuple[list[str], float, float]], steps: int = 400, rate: float = 0.5, decay: float = 1e-3) -> dict[str, float]:
    """Logistic regression on (features, target probability, weight) by gradient steps."""
    total = sum(w for _, _, w in rows) or 1.0
    coef = {f: 0.0 for fs, _, _ in rows for f in fs} | {"": 0.0}
    for _ in range(steps):
        grad = {f: decay * c for f, c in coef.items()}
        for fs, y, w in rows:
            z = coef[""] + sum(coef[f] for f in fs)
            g = (1 / (1 + exp(-max(-50.0, min(50.0, z)))) - y) * w / total
            for f in ("", *fs):
                grad[f] += g
        for f in coef:
            coef[f] -= rate * grad[f]
    return coef


def fit_classifier(spans: DataFrame) -> dict[str, float]:
    """Coefficients of the span classifier, from the pattern counts of all spans."""
    # Strings, since fields of exploded structs are pruned below the explode, each computing all spans
    # again; outer, since a plain explode has its inferred filter, and all spans in it, pushed down.
    pattern = F.transform("spans", lambda s: F.concat_ws("|", s["kind"], s["votes"], s["size"], s["digits"]))
    counts = spans.select(F.explode_outer(pattern).alias("p")).where("p is not null").groupBy("p").count().collect()
    cells = [(*r["p"].split("|"), r["count"]) for r in counts]
    counts = sorted((k, tuple(map(int, v.split())), int(size), int(digits), n) for k, v, size, digits, n in cells)
    by_votes: dict[tuple, int] = {}
    for kind, votes, _, _, n in counts:
        by_votes[kind, votes] = by_votes.get((kind, votes), 0) + n
    patterns = [(k, v, n) for (k, v), n in by_votes.items()]
    _, posterior = estimate(patterns)
    target = {(k, v): p for (k, v, _), p in zip(patterns, posterior)}
    return train([(features(k, v, size, digits), target[k, v], n) for k, v, size, digits, n in counts])


def accepted(spans: Column, coef: dict[str, float]) -> Column:
    """The spans that are base or that the classifier takes."""
    limit = log(ACCEPT / (1 - ACCEPT))
    known = F.create_map(*[x for f, c in coef.items() for x in (F.lit(f), F.lit(float(c)))])

    def weight(feature: Column) -> Column:
        return F.coalesce(F.try_element_at(known, feature), F.lit(0.0))

    def score(s: Column) -> Column:
        votes = F.split(s["votes"], " ")
        total = F.lit(coef.get("", 0.0))
        for name in ("kind", "size", "digits"):
            total = total + weight(F.concat(F.lit(f"{name}="), s[name].cast("string")))
        for i, name in enumerate(LABELERS):
            total = total + weight(F.concat(F.lit(f"{name}="), votes[i]))
        return total

    return F.filter(spans, lambda s: s["base"] | (score(s) >= limit))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    `docs` needs doc_id and text. A null or empty text has no spans. Offsets are code points, ends
    exclusive. Repeated rows come out each.
    """
    found = written(labelled_spans(docs, ["doc_id"]))
    kept = found.withColumn("all", accepted(F.col("spans"), fit_classifier(found)))
    base = F.filter("spans", lambda s: s["base"])

    def count_of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")

    return kept.select(
        "doc_id",
        *[count_of(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("all")).alias("spans"),
        (F.size("all") - F.size(base)).cast("long").alias("n_added"),
    )


def redact_pii(docs: DataFrame) -> DataFrame:
    """`docs`, its text with every span replaced by its kind, as `<EMAIL>`, and n_chars (if there) renewed.

    Overlapping spans become one mark, that of the first. Texts without spans, and null texts, stay.
    Documents are scanned twice, to fit the classifier and to apply it; nothing is shuffled.
    """
    coef = fit_classifier(labelled_spans(docs))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    spans = F.array_sort(
        F.transform(accepted(F.col("spans"), coef), lambda s: F.struct(s["start"], s["end"], s["kind"]))
    )
    found = labelled_spans(docs.select(whole, "text"), ["row", "text"]).select("row", "text", spans.alias("spans"))
    reach = _running(F.transform("spans", lambda s: s["end"]), F.greatest, 0)
    # where the text before a span begins: the furthest end so far
    since = F.concat(F.array(F.lit(0)), F.slice(reach, F.lit(1), F.greatest(F.size(reach) - 1, F.lit(0))))
    marks = F.filter(
        F.zip_with("spans", since, lambda s, at: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), at.alias("at"))),
        lambda s: s["start"] >= s["at"],
    )
    some = F.size("spans") > 0
    found = found.select(
        "row", "text", F.when(some, marks).alias("marks"), F.when(some, F.element_at(reach, -1)).alias("last"),
        F.when(some, _slices(F.col("text"))).alias("slices"),
    )
    marked = F.transform("marks", lambda s: F.concat(
        _cut(F.col("slices"), s["at"], s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")))
    tail = _cut(F.col("slices"), F.col("last"), F.length("text"))
    clean = F.when(F.col("marks").isNull(), F.col("text")).otherwise(F.concat(F.array_join(marked, ""), tail))
    out = found.select("row", clean.alias("clean"))
    return out.select(*[
        F.col("clean").alias(c) if c == "text"
        else F.when(F.col("clean").isNull(), F.col("row")[c]).otherwise(F.length("clean")).cast(docs.schema[c].dataType).alias(c)
        if c == "n_chars"
        else F.col("row")[c].alias(c)
        for c in docs.columns
    ])
