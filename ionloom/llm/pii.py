"""PII: regular expressions propose spans, checksums confirm them, context words adjust the score. JVM only.

Spans are found without a UDF: a pattern both splits a text and extracts its matches; the lengths of the
pieces give the positions, in code points. Every quantifier is possessive or over one character class, so
that no text, however long or repetitive, makes a match recursive or quadratic. Running sums and maxima over a
text's n spans are taken in log2(n) passes, context is read from the pieces around a match, and masking cuts the
text from chunks of ``CHUNK`` characters, so the work grows as n log n with the number of spans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh


@dataclass(frozen=True)
class Kind:
    """``pattern`` proposes; ``cue`` is a cheap test that any text with a match passes; ``context`` are words
    that raise the score when one stands within ``CONTEXT_CHARS`` before or after a span (up to its neighbours
    of the same kind)."""

    name: str
    pattern: str
    cue: str
    score: float
    context: tuple[str, ...]
    #: Kinds that stand in the result whatever their score.
    base: bool = True


LOCAL = r"[A-Za-z0-9._%+-]"
#: Countries by the length of their account numbers.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Country, check digits and as many characters as the country has, each after a space or not: what follows is never taken in.
IBAN = r"(?<![A-Za-z0-9])(?:" + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?+[A-Z0-9]){{{n - 4}}}+" for n, c in IBAN_LENGTHS.items()) + r")(?![A-Za-z0-9])"
#: The patterns of the kinds, in the order of the result.
KINDS = (
    Kind("email", rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.95, ("mail", "email", "e-mail", "contact")),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, ("ip", "host", "server", "address")),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]", 0.9, ("card", "visa", "credit", "account")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.75, ("phone", "tel", "call", "mobile")),
    Kind("iban", IBAN, r"[A-Z]{2}[0-9]{2}", 0.9, ("iban", "bank", "konto", "account"), base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]", 0.4, ("ssn", "social", "security"), base=False),
)
CONTEXT_CHARS = 40
CHUNK = 4096
CONTEXT_BONUS = 0.3
MIN_SCORE = 0.6


SPAN = "array<struct<start:bigint,end:bigint,match:string,before:string,after:string>>"


def scan(values: Column, op) -> Column:
    """Running results of an associative ``op`` from the first value to each, in log2(n) passes (Hillis and Steele 1986)."""
    over = lambda acc, step: F.transform(acc, lambda x, i: F.when(i >= step, op(F.get(acc, i - step), x)).otherwise(x))

    def passes(v: Column) -> Column:
        top = F.ceil(F.log2(F.greatest(F.size(v), F.lit(2)))).cast("int")
        return F.aggregate(F.transform(F.sequence(F.lit(0), top - 1), lambda k: F.pow(F.lit(2.0), k).cast("int")), v, over)

    return once(values, passes)


def once(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans_of(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match, before, after>> of the leftmost non-overlapping matches, in code points, end exclusive.

    The k-th match ends after the first k + 1 pieces of the text between matches and the first k + 1 matches. Before and
    after are the ``CONTEXT_CHARS`` characters on its sides, cut at its neighbours.
    """

    def placed(x: Column) -> Column:
        gaps, hits = x["gaps"], x["hits"]
        ends = scan(F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: (F.length(g) + F.length(h)).cast("bigint")), lambda a, b: a + b)
        side = lambda i: F.get(gaps, i)
        span = lambda h, end, i: F.struct((end - F.length(h)).alias("start"), end.alias("end"), h.alias("match"), F.right(side(i), F.lit(CONTEXT_CHARS)).alias("before"), F.left(side(i + 1), F.lit(CONTEXT_CHARS)).alias("after"))
        return once(ends, lambda e: F.transform(hits, lambda h, i: span(h, F.get(e, i), i)))

    return once(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")), placed)


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum: every second digit from the right doubled, nines cast out."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, F.lit(9)).otherwise(F.lit(0))))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number (country, check digits, rest) leaves 1 modulo 97 with letters read as 10 to 35."""
    s = F.regexp_replace(account, " ", "")
    chars = F.split(F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4)), "")

    def fold(a: Column, c: Column) -> Column:
        v = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (a * F.when(v < 10, F.lit(10)).otherwise(F.lit(100)) + v) % 97

    return F.aggregate(chars, F.lit(0), fold) == 1


def confirmed(kind: str, match: Column) -> Column:
    """The validator of a kind: what its pattern cannot say."""
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(match, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        d = digits_of(match)
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits_of(match)).between(9, 15)
    if kind == "iban":
        return mod97(match)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> tuple[DataFrame, str]:
    """``docs`` plus an array<struct<kind, start, end, score, base>> of every span, by kind as listed, then start.

    Returns the frame and the name of the new column. The score is the kind's, plus ``CONTEXT_BONUS`` where a context
    word is near. Spans of base kinds are those of their pattern and validator alone, whatever their score; the other kinds need
    ``MIN_SCORE`` and must not overlap a base span. Null and empty texts have none; repeated rows have equal results; other
    columns, whatever their names, stay. No shuffle; a text without a kind's cue skips its pattern.
    """
    t, *cols, found, added, out = fresh(docs, "p_text", *[f"p_{k.name}" for k in kinds], "p_base", "p_added", "p_spans")
    df = docs.withColumn(t, F.coalesce(F.col("text"), F.lit("")))
    for k, c in zip(kinds, cols, strict=True):
        cue = F.contains(F.col(t), F.lit(k.cue)) if len(k.cue) == 1 else F.col(t).rlike(k.cue)
        df = df.withColumn(c, F.when(cue, _scored(_confirmed_spans(F.col(t), k), k)).otherwise(F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double,base:boolean>>")))
    df = df.withColumn(found, F.concat(*[F.col(c) for k, c in zip(kinds, cols, strict=True) if k.base]))
    scored = [F.filter(F.col(c), lambda s: s["score"] >= MIN_SCORE) for k, c in zip(kinds, cols, strict=True) if not k.base]
    df = df.withColumn(added, F.concat(*scored) if scored else F.slice(F.col(found), 1, 0))
    df = df.withColumn(out, F.when(F.size(added) > 0, F.concat(F.col(found), _apart(F.col(added), F.col(found)))).otherwise(F.col(found)))
    return df.drop(t, *cols, found, added), out


def _apart(spans: Column, base: Column) -> Column:
    """Those of ``spans`` that overlap none of ``base``.

    All go in one order by start. A span overlaps a base span iff the greatest end of base spans up to it passes its
    start, or the least start of those after it comes before its end: two running results over the order.
    """
    mark = lambda a, own: F.transform(a, lambda s, i: F.struct(s["start"].alias("a"), F.lit(own).alias("own"), s["end"].alias("z"), i.alias("i")))
    low, high = F.lit(-1).cast("bigint"), F.lit(2**62).cast("bigint")
    last = lambda o: scan(F.transform(o, lambda s: F.when(s["own"] == 0, s["z"]).otherwise(low)), lambda x, y: F.greatest(x, y))
    following = lambda o: F.reverse(scan(F.reverse(F.transform(o, lambda s: F.when(s["own"] == 0, s["a"]).otherwise(high))), lambda x, y: F.least(x, y)))

    def free(x: Column) -> Column:
        apart = F.filter(F.transform(x["o"], lambda s, i: F.struct(s["i"].alias("i"), ((s["own"] == 1) & (F.get(x["last"], i) <= s["a"]) & (F.get(x["next"], i) >= s["z"])).alias("ok"))), lambda s: s["ok"])
        return F.transform(F.sort_array(apart), lambda s: F.get(spans, s["i"]))

    ordered = F.sort_array(F.concat(mark(base, 0), mark(spans, 1)))
    return once(ordered, lambda o: once(F.struct(o.alias("o"), last(o).alias("last"), following(o).alias("next")), free))


def _confirmed_spans(text: Column, k: Kind) -> Column:
    return F.filter(spans_of(text, k.pattern), lambda s: confirmed(k.name, s["match"]))


def _scored(spans: Column, k: Kind) -> Column:
    near = "(?i)(?<![A-Za-z0-9])(?:" + "|".join(k.context) + ")(?![A-Za-z0-9])"

    def add(s: Column) -> Column:
        bonus = F.when(s["before"].rlike(near) | s["after"].rlike(near), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))
        score = F.round(F.least(F.lit(1.0), F.lit(k.score) + bonus), 4)
        return F.struct(F.lit(k.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"), F.lit(k.base).alias("base"))

    return F.transform(spans, add)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def score_text(spans: Column) -> Column:
    """The score of each span in the order of ``span_text``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: s["score"].cast("string")), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by ``<KIND>``; overlapping spans become one, named by the first."""
    order = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("z"), s["kind"].alias("k"))))
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}+"), F.lit(0))

    def cut_at(parts: Column, a: Column, b: Column) -> Column:
        """Characters a to b, from the chunks they stand in."""
        first, last = F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")
        head, tail = (a - first.cast("bigint") * CHUNK).cast("int"), (b - last.cast("bigint") * CHUNK).cast("int")
        one = F.substring(F.get(parts, first), head + 1, tail - head)
        many = F.concat(F.substring(F.get(parts, first), head + 1, F.lit(CHUNK)), F.array_join(F.slice(parts, first + 2, F.greatest(F.lit(0), last - first - 1)), ""), F.substring(F.get(parts, last), F.lit(1), tail))
        return F.when(b <= a, F.lit("")).when(first == last, one).otherwise(many)

    def build(x: Column) -> Column:
        """``upto``: where the spans up to each end at the latest. A span that starts at or after that of its forerunner is a new one."""
        upto = lambda i: F.when(i > 0, F.get(x["upto"], i - 1)).otherwise(F.lit(0).cast("bigint"))
        heads = F.filter(F.transform(x["o"], lambda s, i: F.struct(s["a"].alias("a"), s["k"].alias("k"), upto(i).alias("from"))), lambda s: s["a"] >= s["from"])
        parts = F.transform(heads, lambda s: F.concat(cut_at(x["c"], s["from"], s["a"]), F.lit("<"), F.upper(s["k"]), F.lit(">")))
        return F.concat(F.array_join(parts, ""), cut_at(x["c"], upto(F.size(x["o"])), F.length(text).cast("bigint")))

    ends = lambda o: scan(F.transform(o, lambda s: -s["z"]), lambda a, b: F.greatest(a, b))
    done = once(order, lambda o: once(F.struct(o.alias("o"), ends(o).alias("upto"), chunks.alias("c")), build))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by ``<KIND>``; ``n_chars``, where there is one, is counted again.

    Null texts stay null (and their n_chars null), every row stays, and no other column changes.
    """
    df, spans = find_pii(docs)
    df = df.withColumn("text", masked(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return df.select(*docs.columns)
