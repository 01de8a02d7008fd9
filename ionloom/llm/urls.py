"""URL filters: host and path rules first, then pattern rules found through their rarest literal token. JVM only.

A pattern rule is a regular expression with the literal tokens that every match must contain. Each rule is
filed under the one of its tokens that is rarest among the tokens of all urls given (counted over the whole
table; the counts that reach the driver are at most one per token of the rules). A url is split into tokens,
its tokens fetch the rules filed under them from the index, and only those regular expressions run. The rule list is a
parameter, not data: up to ``MAX_INLINE_RULES`` rules the index is a map in the plan and no row is shuffled; a
longer list is a table, joined by token.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

MAX_INLINE_RULES = 256


@dataclass(frozen=True)
class SiteRule:
    """``verdict`` for ``host`` and all its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """``verdict`` where ``pattern`` is found in the lower-cased url; ``tokens`` are in every such url as whole tokens."""

    verdict: str
    pattern: str
    tokens: tuple[str, ...]


#: The site rules of the production list.
SITE_RULES = (
    SiteRule("allow", "com", "/"),
    SiteRule("block", "example.com", "/en/"),
    SiteRule("allow", "www.example.com", "/en/"),
    SiteRule("block", "net", "/es/"),
    SiteRule("block", "net", "/fr/"),
)
#: Words of unwanted sites and the words that stand beside them, from which the production list is made.
UNWANTED = {
    "casino poker roulette jackpot slots": "win bonus online free play",
    "bets bet sportsbet bookmaker": "free bonus online live odds",
    "pills meds viagra cialis pharmacy": "cheap buy online order discount",
    "porn xxx adult escort webcam": "x xxx video videos free live hd tube",
    "adserver doubleclick ads banner popunder": "track click serve redirect pixel",
    "warez crack keygen torrent": "download free full serial",
    "spam backlink linkfarm replica": "farm buy cheap seller",
}


#: Redirectors, as words of a host, of its path and keys of the query that stand in one url.
REDIRECTORS = ("ads adserver click track", "go jump out redirect", "affid affiliate clickid subid")


def production_rules(words: dict[str, str] = UNWANTED, redirectors: tuple[str, str, str] = REDIRECTORS) -> tuple[PatternRule, ...]:
    """Blocking rules: each word before one of its neighbours, or after one, with a separator between (one literal: the word); and each
    redirector, a word of the host, of the path and a query key (three literals: which is the rarest is for the table to say)."""
    left, right, out = r"(?:^|[^\p{L}\p{N}])", r"(?:[^\p{L}\p{N}]|$)", []
    for heads, beside in words.items():
        some = "(?:" + "|".join(beside.split()) + ")"
        for head in heads.split():
            out += [PatternRule("block", f"{left}{head}[-._/]{some}{right}", (head,)), PatternRule("block", f"{left}{some}[-._/]{head}{right}", (head,))]
    out += [PatternRule("block", rf"{left}spam[-.]farm{right}", ("spam", "farm")), PatternRule("block", rf"{left}{'porn'}{right}", ("porn",))]
    hosts, paths, keys = (x.split() for x in redirectors)
    for h, p, k in product(hosts, paths, keys):
        out.append(PatternRule("block", rf"://(?:[^/?#]*[^/?#\p{{L}}\p{{N}}])?{h}(?:[^/?#\p{{L}}\p{{N}}][^/?#]*)?/(?:[^?#]*[^?#\p{{L}}\p{{N}}])?{p}(?:[^?#\p{{L}}\p{{N}}][^?#]*)?[?](?:[^#]*&)?{k}=", (h, p, k)))
    return tuple(out)


PATTERN_RULES = production_rules()


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; no ``://`` or null: empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; no ``://`` or null: empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """The distinct runs of letters and digits of a url, lower-cased."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(url, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def site_rule(host: Column, path: Column, rules: tuple[SiteRule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest site rule that fits, both null if none does."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.host, r.path)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def index_rules(urls: DataFrame, rules: tuple[PatternRule, ...]) -> list[tuple[str, int]]:
    """(token, rule number): each rule under its rarest literal token over all ``urls`` (ties: the longer, then first)."""
    literals = sorted({t for r in rules for t in r.tokens})
    if not literals:
        return []
    hits = urls.select(F.explode(F.filter(tokens_of(F.col("url")), lambda t: t.isin(*literals))).alias("token"))
    seen = {r["token"]: r["n"] for r in hits.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return [(min(r.tokens, key=lambda t: (seen.get(t, 0), -len(t), t)), i) for i, r in enumerate(rules)]


def judge_urls(pages: DataFrame, sites: tuple[SiteRule, ...] = SITE_RULES, patterns: tuple[PatternRule, ...] = PATTERN_RULES, keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """Columns ``keep`` with host, path, rule, verdict and pattern_rules (the numbers of the pattern rules that match).

    The verdict is that of the longest site rule; without one it is ``block`` if a blocking pattern rule
    matches, else ``allow`` if an allowing one does, else ``default``. Null urls and urls without ``://`` have
    an empty host and path, so no site rule fits them; pattern rules still run over what tokens they have.
    Repeated rows have equal results, null ids stay, other columns play no part unless they are in ``keep``; an empty
    table gives no rows.
    """
    if clash := {c.lower() for c in keep} & {"host", "path", "rule", "verdict", "pattern_rules"}:
        raise ValueError(f"columns of the result cannot be kept under their names: {sorted(clash)}")
    h, p, t, m = fresh(pages, "u_host", "u_path", "u_rules", "u_matched")
    index = index_rules(pages, patterns)
    url = F.lower(F.coalesce(F.col("url"), F.lit("")))
    df = pages.withColumn(h, host_of(F.col("url"))).withColumn(p, path_of(F.col("url")))
    if not patterns:
        df = df.withColumn(m, F.array().cast("array<int>"))
    elif len(patterns) <= MAX_INLINE_RULES:
        filed: dict[str, list[int]] = {}
        for token, i in index:
            filed.setdefault(token, []).append(i)
        index_map = F.create_map(*[x for token, rules in filed.items() for x in (F.lit(token), F.array(*map(F.lit, rules)))])
        df = df.withColumn(t, F.flatten(F.filter(F.transform(tokens_of(F.col("url")), lambda token: F.try_element_at(index_map, token)), lambda rules: rules.isNotNull())))
        # Only fetched rules run: the pattern is looked up by the rule's number.
        pattern = lambda i: F.element_at(F.array(*[F.lit(r.pattern) for r in patterns]), i + 1)
        df = df.withColumn(m, F.sort_array(F.filter(F.col(t), lambda i: F.rlike(url, pattern(i)))))
    else:
        df = _matched_by_table(df, index, patterns, m)
    name, verdict = site_rule(F.col(h), F.col(p), sites)
    of = lambda v: F.arrays_overlap(F.col(m), F.array(*[F.lit(i) for i, r in enumerate(patterns) if r.verdict == v])) if any(r.verdict == v for r in patterns) else F.lit(False)
    by_pattern = F.when(of("block"), F.lit("block")).when(of("allow"), F.lit("allow")).otherwise(F.lit(default))
    return df.select(*keep, F.col(h).alias("host"), F.col(p).alias("path"), name.alias("rule"), F.coalesce(verdict, by_pattern).alias("verdict"), F.col(m).alias("pattern_rules"))


def _matched_by_table(df: DataFrame, index: list[tuple[str, int]], patterns: tuple[PatternRule, ...], out: str) -> DataFrame:
    """For long rule lists: distinct urls are exploded into tokens and joined with the rule table by token."""
    spark = df.sparkSession
    rules = spark.createDataFrame([(token, i, patterns[i].pattern) for token, i in index], "u_token string, u_number int, u_pattern string")
    urls = df.select("url").distinct().where(F.col("url").isNotNull())
    hit = urls.select("url", F.explode(tokens_of(F.col("url"))).alias("u_token")).join(rules, "u_token")
    hit = hit.where(F.rlike(F.lower("url"), F.col("u_pattern"))).groupBy("url").agg(F.sort_array(F.collect_set("u_number")).alias(out))
    return df.join(hit, "url", "left").withColumn(out, F.coalesce(F.col(out), F.array().cast("array<int>")))
