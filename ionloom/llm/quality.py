"""Quality rules: base word rules, then Jensen-Shannon divergence from language references. JVM only.

Two histograms describe a document: the share of its characters in each character class, and the
share of its words that are each of the commonest function words of its language. Both are compared
by Jensen-Shannon distance (base 2, so 0 to 1) with the reference of the language. References are sums
over every document that passes the base rules; there is at most one row per language of
``COMMON_WORDS`` and a pooled one, so their broadcast is bounded by that parameter and not by the data.

A document's language is the one it names, if that has a reference; else it is the one whose function words the text has most of. A
text with none of these words is compared by its characters alone, with the pooled reference of all languages.

Two guards keep short texts from being judged on too few events: characters are compared from
``min_letters`` non-blank characters on, words from ``min_hist_words`` words on.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, cut, fresh, without, words_of

#: The commonest function words of each reference language.
COMMON_WORDS = {
    "de": ("der", "die", "und", "das", "von", "mit", "den", "zu", "ist", "nicht", "ein", "eine", "sich", "auf"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "as", "was", "on"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui"),
}
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    #: Guards: below these the divergence of that histogram is not judged.
    min_letters: int = 150
    min_hist_words: int = 100
    max_char_distance: float = 0.28
    max_word_distance: float = 0.25


def _window_marks(hashes: Column, size: int) -> Column:
    """A 64-bit hash of every ``size``-word window of a text, from the hashes of its words."""
    n = F.size(hashes)
    starts = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(size)]))


def _covered(ordered: Column, flagged: Column, size: int) -> Column:
    m = F.size(flagged)
    gaps = F.transform(flagged, lambda p, k: F.when(k + 1 < m, F.least(F.get(flagged, k + 1) - p, F.lit(size))).otherwise(F.lit(size)))
    return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g)


def base_features(docs: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the histograms' counts.

    One pass over the text, no shuffle. Null and empty texts have all counts 0. The counts stand in one
    struct column, whose name is returned second, so that they clash with no column of ``docs``.
    """
    t, w, hs, low, mk, od, fl, rf, out = fresh(docs, "q_text", "q_words", "q_hashes", "q_low", "q_marks", "q_sorted", "q_flagged", "q_ref", "q")
    size = p.window
    df = docs.withColumn(t, F.coalesce(F.col("text"), F.lit("")))
    df = df.withColumn(w, words_of(F.col(t)))
    df = df.withColumn(hs, F.transform(F.col(w), lambda x: F.xxhash64(x)))
    df = df.withColumn(mk, _window_marks(F.col(hs), size))
    m = F.col(mk)
    pairs = F.when(F.size(F.array_distinct(m)) < F.size(m), F.sort_array(F.transform(m, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    df = df.withColumn(od, pairs)
    o = F.col(od)
    same = lambda x, k: (F.get(o, k)["h"] == x["h"])
    hits = F.filter(F.transform(o, lambda x, k: F.when((F.coalesce(same(x, k - 1), F.lit(False))) | F.coalesce(same(x, k + 1), F.lit(False)), x["i"])), lambda i: i.isNotNull())
    df = df.withColumn(fl, F.sort_array(hits))
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: without(x, WHITE) != "")
    # Function words are few and short: one pass picks them, whatever their language, and all counts are over what it picks.
    every = sorted({x for ws in COMMON_WORDS.values() for x in ws})
    picked = F.transform(F.filter(F.col(w), lambda x: (F.length(x) <= max(map(len, every))) & F.lower(x).isin(*every)), lambda x: F.lower(x))
    df = df.withColumn(low, picked)
    hits = lambda ws: F.size(F.filter(F.col(low), lambda x: x.isin(*ws)))
    lang = F.col("lang")
    # The language with most hits, of equal ones the first by name.
    guess = F.greatest(*[F.struct(hits(ws).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, ws) in enumerate(sorted(COMMON_WORDS.items()))])
    df = df.withColumn(rf, F.when(lang.isin(*COMMON_WORDS), lang).otherwise(F.when(guess["n"] > 0, guess["name"])))
    bins = F.lit(None).cast("array<string>")
    for name, ws in COMMON_WORDS.items():
        bins = F.when(F.col(rf) == name, F.array(*map(F.lit, ws))).otherwise(bins)
    counts = F.transform(bins, lambda b: F.size(F.filter(F.col(low), lambda x: x == b)).cast("bigint"))
    text = F.col(t)
    dense = without(text, WHITE)
    chars = F.length(dense)
    letters_gone = F.regexp_replace(text, r"[\p{L}\x20\x09-\x0D]+", "")
    q = F.struct(
        F.size(w).cast("bigint").alias("n_words"),
        chars.cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(without(text, SYMBOLS))).cast("bigint").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        _covered(o, F.col(fl), size).alias("n_repeat_words"),
        F.col(rf).alias("ref_lang"),
        counts.alias("common"),
        F.length(letters_gone).cast("bigint").alias("marks"),
        (F.length(letters_gone) - F.length(without(letters_gone, "0123456789"))).cast("bigint").alias("digits"),
        (F.length(letters_gone) - F.length(without(letters_gone, ".,"))).cast("bigint").alias("stops"),
        (F.length(letters_gone) - F.length(without(letters_gone, ";:!?'\"()-"))).cast("bigint").alias("points"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("bigint").alias("capitals"),
    )
    return df.withColumn(out, q).drop(t, w, hs, low, mk, od, fl, rf), out


def _histograms(q: Column) -> tuple[Column, Column]:
    rest = q["marks"] - q["digits"] - q["stops"] - q["points"]
    small = q["word_chars"] - q["marks"] - q["capitals"]
    by_char = F.array(small, q["capitals"], q["digits"], q["stops"], q["points"], rest)
    by_word = F.concat(q["common"], F.array(q["n_words"] - F.aggregate(q["common"], F.lit(0).cast("bigint"), lambda a, x: a + x)))
    return by_char, by_word


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two arrays of shares of equal length."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def references(features: DataFrame, q: str, base_failed: Column) -> DataFrame:
    """Shares of each language's summed histograms over all documents that pass the base rules, at most one row each, and of
    all characters together (the row without a language)."""
    by_char, by_word = _histograms(F.col(q))
    pos = features.where(~base_failed).select(F.col(f"{q}.ref_lang").alias("ref_key"), by_char.alias("c"), by_word.alias("w"))
    n_w = max(map(len, COMMON_WORDS.values())) + 1
    sums = [F.sum(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(6)] + [F.sum(F.coalesce(F.get("w", F.lit(i)), F.lit(0))).alias(f"w{i}") for i in range(n_w)]
    agg = pos.groupBy("ref_key").agg(*sums)
    pooled = agg.agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(6)])
    chars, words = (F.array(*[F.col(f"{x}{i}").cast("double") for i in range(n)]) for x, n in (("c", 6), ("w", n_w)))
    known = agg.where("ref_key IS NOT NULL").select("ref_key", _shares(chars).alias("ref_char"), _shares(words).alias("ref_word"))
    return known.unionByName(pooled.select(F.lit(None).cast("string").alias("ref_key"), _shares(chars).alias("ref_char"), F.lit(None).cast("array<double>").alias("ref_word")))


VERDICT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "ref_lang", "kept")


def judge(docs: DataFrame, p: QualityParams = QualityParams(), keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, str]:
    """Columns ``keep`` of every row of ``docs`` with a struct of ``VERDICT``, and the struct's name, which no column of ``keep`` has.

    Null or empty text: all counts 0 and base_failed. Null or unlisted languages are detected; see above. Repeated rows give
    repeated results, an empty table no rows. The text is read once: the small features are written to the checkpoint
    folder, the references summed from them.
    """
    feats, q = base_features(docs, p)
    feats = cut(feats.select(*keep, q))
    n, rep = F.col(f"{q}.n_words"), F.col(f"{q}.n_repeat_words")
    failed = (n < p.min_words) | (100 * rep > p.max_repeat_percent * n)
    key, char, word, v = fresh(feats, "ref_key", "ref_char", "ref_word", "verdict")
    refs = references(feats, q, failed).withColumnsRenamed({"ref_key": key, "ref_char": char, "ref_word": word})
    by_char, by_word = _histograms(F.col(q))
    out = feats.join(F.broadcast(refs), F.col(f"{q}.ref_lang").eqNullSafe(F.col(key)), "left")
    char_d = F.when(F.col(f"{q}.word_chars") >= p.min_letters, js_distance(_shares(by_char), F.col(char)))
    word_d = F.when((n >= p.min_hist_words) & F.col(word).isNotNull(), js_distance(_shares(by_word), F.col(word)))
    far = lambda d, most: F.coalesce(d, F.lit(0.0)) > most
    ok = ~failed & ~far(char_d, p.max_char_distance) & ~far(word_d, p.max_word_distance)
    base = [F.col(f"{q}.{c}").alias(c) for c in VERDICT[:5]]
    return out.select(*keep, F.struct(*base, failed.alias("base_failed"), char_d.alias("char_distance"), word_d.alias("word_distance"), F.col(f"{q}.ref_lang").alias("ref_lang"), ok.alias("kept")).alias(v)), v


def score_quality(docs: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """doc_id and the columns of ``VERDICT`` of every row of ``docs``, as ``judge`` gives them."""
    out, v = judge(docs, p)
    return out.select("doc_id", f"{v}.*")


def good_documents(docs: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns alone, whatever these are named."""
    out, v = judge(docs, p, tuple(docs.columns))
    return out.where(F.col(f"{v}.kept")).select(*docs.columns)
