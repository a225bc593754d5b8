"""URL filters by association rules.

Fixed host and path rules judge what they fit.  All other urls are judged by rules that Spark's
FP-growth mines from the labelled urls: combinations of url tokens (labels of the host, path
segments with numbers folded, file ending, query names) that go with a verdict.  Rules below
``MIN_SUPPORT`` or ``MIN_CONFIDENCE`` are pruned.  The rest are kept in an inverted index under
their rarest token; a url looks up its tokens there and checks the whole combination.  The most
confident rule decides (then the better supported, then the shorter, then the later by its
text); without one the url is allowed.

Labels are the verdicts of the fixed rules, which a url's own host shares with others it does
not fit, and may be any table of (host, path, verdict) instead.

Everything on this path is DataFrame expressions and Spark's own FP-growth.  Scale: urls are
reduced to distinct token sets with their counts before mining results are matched; a set that
a third of all urls share is one row; matching joins on tokens, with each rule under one token.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule
and is judged by the method on no tokens; rows are independent, so repeated rows and ids get a
row each; without labelled urls, or without a rule, every other url is allowed.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.graph import stored
from eventloom.llm.text import folded

MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.6
ALLOW, BLOCK = "allow", "block"
DEFAULT = ALLOW
#: Tokens that stand for the verdicts in the mined baskets; no url token has this form.
VERDICTS = {ALLOW: "=allow", BLOCK: "=block"}


class HostRule(NamedTuple):
    verdict: str
    host: str
    path: str


#: The rules of the contract.
HOST_RULES = (
    HostRule("allow", "org", "/"),
    HostRule("block", "example.org", "/es/"),
    HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"),
    HostRule("block", "com", "/de/"),
)
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"


def host(url: Column) -> Column:
    return F.coalesce(folded(F.regexp_extract(url, PARTS, 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def host_rule(host: Column, path: Column, rules: tuple[HostRule, ...] = HOST_RULES) -> Column:
    """The longest rule that fits, as (verdict, rule), or null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.verdict).alias("verdict"),
                                    F.lit(r.host + r.path).alias("rule"))).otherwise(out)
    return out


def tokens(host: Column, path: Column, rest: Column) -> Column:
    """Sorted distinct tokens of a url."""
    shape = lambda s: F.regexp_replace(folded(s), "[0-9]+", "#")
    filled = lambda a: F.filter(a, lambda s: s != "")
    labels = F.transform(filled(F.split(host, r"\.")), lambda s: F.concat(F.lit("host:"), shape(s)))
    steps = F.transform(filled(F.split(path, "/")), lambda s: F.concat(F.lit("path:"), shape(s)))
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)
    endings = F.transform(filled(F.array(ending)), lambda s: F.concat(F.lit("file:"), folded(s)))
    query = F.regexp_extract(rest, r"(?s)^\?([^#]*)", 1)
    names = F.transform(filled(F.split(query, "&")),
                        lambda s: F.concat(F.lit("query:"), shape(F.element_at(F.split(s, "="), 1))))
    return F.array_sort(F.array_distinct(F.concat(labels, steps, endings, names)))


def parsed(pages: DataFrame) -> DataFrame:
    """page (all columns), host, path, tokens."""
    url = F.col("page.url")
    parts = pages.select(F.struct("*").alias("page")).select(
        "page", host(url).alias("host"), path(url).alias("path"),
        F.coalesce(F.regexp_extract(url, PARTS, 3), F.lit("")).alias("rest"))
    own = tokens(F.col("host"), F.col("path"), F.col("rest"))
    return parts.select("page", "host", "path", own.alias("tokens"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT,
         min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(items, verdict, confidence, support) of the rules mined from (tokens, verdict)."""
    mark = F.create_map(*(F.lit(x) for pair in VERDICTS.items() for x in pair))
    baskets = labelled.select(F.concat("tokens", F.array(mark[F.col("verdict")])).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    back = F.create_map(*(F.lit(x) for k, v in VERDICTS.items() for x in (v, k)))
    marks = F.array(*map(F.lit, VERDICTS.values()))
    return model.associationRules.select(
        F.array_sort("antecedent").alias("items"), back[F.col("consequent")[0]].alias("verdict"),
        "confidence", "support").where(
        F.col("verdict").isNotNull() & ~F.arrays_overlap("items", marks))


def indexed(rules: DataFrame) -> DataFrame:
    """The rules under their rarest token: token, items, verdict, confidence, support."""
    rules = stored(rules, "rules")
    often = rules.select(F.explode("items").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("often"))
    spread = rules.select("items", "verdict", F.explode("items").alias("token")).join(often, "token")
    rarest = spread.groupBy("items", "verdict").agg(
        F.min(F.struct("often", "token")).alias("rarest"))
    return stored(rules.join(rarest, ["items", "verdict"]).select(
        F.col("rarest.token").alias("token"), "items", "verdict", "confidence", "support"), "index")


def verdicts(sets: DataFrame, index: DataFrame) -> DataFrame:
    """(tokens, method, confidence): the verdict of the best rule for each token set of ``sets``."""
    found = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
    found = found.where(F.size(F.array_except("items", "tokens")) == 0)
    best = found.groupBy("tokens").agg(F.max(F.struct(
        "confidence", "support", (-F.size("items")).alias("short"),
        F.array_join("items", " ").alias("text"), "verdict")).alias("best"))
    return best.select("tokens", F.col("best.verdict").alias("method"), "best.confidence")


def judge(pages: DataFrame, rules: tuple[HostRule, ...] = HOST_RULES) -> DataFrame:
    """page (all columns), host, path, rule, verdict, and the confidence of a mined rule."""
    urls = parsed(pages).withColumn("fixed", host_rule(F.col("host"), F.col("path"), rules))
    sets = stored(urls.groupBy("tokens", F.col("fixed.verdict").alias("verdict")).agg(
        F.count(F.lit(1)).alias("n")), "token_sets")
    labelled = urls.where("fixed is not null").select("tokens", F.col("fixed.verdict").alias("verdict"))
    index = indexed(mine(labelled))
    open_ = sets.where("verdict is null").select("tokens")
    method = stored(verdicts(open_, index), "verdicts")
    told = urls.join(method, "tokens", "left")
    return told.select(
        "page", "host", "path", F.col("fixed.rule").alias("rule"),
        F.coalesce(F.col("fixed.verdict"), "method", F.lit(DEFAULT)).alias("verdict"),
        F.when(F.col("fixed").isNull(), F.col("confidence")).alias("confidence"))


def report(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url")).select(
        F.col("page.page_id").alias("page_id"), "host", "path", "rule", "verdict", "confidence")
