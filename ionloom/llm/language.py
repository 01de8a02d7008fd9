"""Language ID by compression: zstandard with one raw-content dictionary per language, smallest result wins.

The dictionaries are the classifier. They are made from a bounded sample of labelled rows: of each language
one document for each of ``sample_rows`` hash classes of doc_id, the first by hash among those of at most
``sample_chars`` characters (longer ones, cut to that length, only where a class has no other), for the
``max_languages`` languages with most rows at most, so sample and dictionaries have a bound. Texts are encoded whole. A margin
under ``min_margin`` between the two smallest results is narrow: the row is marked rejected, and its score is
low, but the best language stands, as the result names one for every text with a letter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTER = regex.compile(r"\p{L}")
NOT_TEXT = regex.compile(r"[^\p{L}\p{M}']+")


@dataclass(frozen=True)
class LanguageParams:
    sample_rows: int = 96
    sample_chars: int = 8192
    dictionary_bytes: int = 110_000
    #: Learned are the languages with most labelled rows, so many at most: dictionaries are sent to every executor.
    max_languages: int = 200
    level: int = 3
    min_margin: float = 0.01


def plain(text: str) -> bytes:
    """What is encoded: the text's letters in lower case, each run of anything else as one space."""
    return NOT_TEXT.sub(" ", text.lower()).encode()


class Classifier:
    """One compressor per language; ties go to the first in ``order`` (the most frequent in training)."""

    def __init__(self, dictionaries: tuple[tuple[str, bytes], ...], level: int):
        import zstandard as z

        self.names, self.packers = [], []
        for name, content in dictionaries:
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.names.append(name)
            self.packers.append(z.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        data = plain(text)
        return [len(p.compress(data)) for p in self.packers]

    def predict(self, text: str | None, min_margin: float) -> tuple[str, float, bool]:
        """(language, score, rejected). The score is the share by which the second smallest is larger, doubled, at most 1."""
        if text is None or not self.names or not LETTER.search(text):
            return "und", 0.0, True
        sizes = self.sizes(text)
        first, *rest = sorted(range(len(sizes)), key=sizes.__getitem__)
        if not rest:
            return self.names[first], 1.0, False
        margin = 1 - sizes[first] / sizes[rest[0]]
        return self.names[first], min(1.0, 2 * margin), margin < min_margin


@lru_cache(maxsize=2)
def _classifier(dictionaries: tuple[tuple[str, bytes], ...], level: int) -> Classifier:
    return Classifier(dictionaries, level)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text leaves 2 modulo 4 (null ids: not)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, p: LanguageParams = LanguageParams()) -> tuple[tuple[str, bytes], ...]:
    """(language, dictionary) from rows not held out whose language is known and whose text has a letter.

    What reaches the driver is bounded by ``max_languages`` times ``sample_rows`` texts of ``sample_chars``: the sample is picked by
    a pre-aggregated minimum per (language, hash class), so no task sees all rows of a language. No labelled row: nothing.
    """
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    h = F.xxhash64("doc_id")
    order = F.struct((F.length("text") > p.sample_chars).alias("long"), h.alias("h"), F.col("doc_id").alias("id"))
    learned = [r["lang"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(p.max_languages).collect()]
    if not learned:
        return ()
    rows = rows.where(F.col("lang").isin(*learned))
    picked = rows.groupBy("lang", F.pmod(h, F.lit(p.sample_rows)).alias("part")).agg(F.min(order).alias("pick"), F.count("*").alias("n"))
    picked = [(r["lang"], r["pick"]["id"], r["n"]) for r in picked.collect()]
    ids = sorted({i for _, i, _ in picked})
    counts: dict[str, int] = {}
    for lang, _, n in picked:
        counts[lang] = counts.get(lang, 0) + n
    texts: dict[str, list[tuple[int, str]]] = {lang: [] for lang in counts}
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(i,) for i in ids], docs.select("doc_id").schema) if ids else None
    if wanted is not None:
        for r in rows.join(F.broadcast(wanted), "doc_id", "left_semi").groupBy("doc_id", "lang").agg(F.min(F.left("text", F.lit(p.sample_chars))).alias("text")).collect():
            texts[r["lang"]].append((r["doc_id"], r["text"]))
    out = []
    for lang in sorted(counts, key=lambda x: (-counts[x], x)):
        content = b"".join(plain(t) + b" " for _, t in sorted(texts[lang]))[-p.dictionary_bytes :]
        if len(content) >= 8:
            out.append((lang, content))
    return tuple(out)


def classify(docs: DataFrame, dictionaries: tuple[tuple[str, bytes], ...], p: LanguageParams = LanguageParams()) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, rejected. Null texts and texts without a letter: und, 0, rejected.

    Nothing learned: und everywhere. Repeated rows have equal results, null ids stay (and are not held out), other columns of
    ``docs`` play no part, an empty table gives no rows. Ids pass as strings, as integers with nulls would become floats.
    """
    size = sum(len(c) for _, c in dictionaries)
    if size > p.max_languages * p.dictionary_bytes:
        raise ValueError(f"dictionaries of {size} bytes are too large to be sent to every executor")
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = _classifier(shared.value, p.level)
        for b in batches:
            rows = [c.predict(t, p.min_margin) for t in b["t"]]
            yield pd.DataFrame({"i": b["i"], "held_out": b["o"], "lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows], "rejected": [r[2] for r in rows]})

    cols = docs.select(F.col("doc_id").cast("string").alias("i"), held_out(F.col("doc_id")).alias("o"), F.col("text").alias("t"))
    out = cols.mapInPandas(run, "i string, held_out boolean, lang_pred string, score double, rejected boolean")
    return out.select(F.col("i").cast(kind).alias("doc_id"), "held_out", "lang_pred", "score", "rejected")


def identify_languages(docs: DataFrame, p: LanguageParams = LanguageParams()) -> DataFrame:
    """``classify`` by what ``fit`` learns from the rows that are not held out; every row of ``docs``, as described there."""
    return classify(docs, fit(docs, p), p)
