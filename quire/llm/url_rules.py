"""URL filtering by association rules.

FP-growth mines which combinations of URL tokens go with a bad label. A rule is kept if it covers enough labelled rows and
if the share of bad ones among them is above the share among all by more than chance explains: the lower end of its confidence
interval has to reach a multiple of the base rate. Rules that add tokens to another without adding confidence are pruned.
Rules are matched by an inverted index: each is filed under its rarest token, so a URL meets only rules that share that
token with it. Listed rules for hosts and paths come first: the longest that fits decides.
"""

from __future__ import annotations

import math
import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch

#: Least share of the labelled rows that a rule must cover, and least number of them where the share would be fewer.
SUPPORT, ROWS = 0.002, 8
#: The lower end of a rule's confidence interval must be this many times the base rate.
LIFT = 1.5
#: Width of that interval in standard errors: many combinations are looked at, and few should pass by chance.
SURE = 3.0
#: Rules are broadcast up to this many, and joined by shuffle beyond.
BROADCAST_RULES = 200_000
#: The listed rules: verdict, host, path.
LISTED = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, with A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*://[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL: the host's endings and the parts of its hyphenated labels, the path's words, the query's names."""
    labels = F.split(host(url), r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("end:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.transform(F.filter(F.split(F.lower(path(url)), r"[^\p{L}\p{N}]+"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, r"^\p{N}+$", "0")))
    names = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("arg:"), x))
    hosts = F.transform(F.filter(F.flatten(F.transform(F.filter(labels, lambda x: x.contains("-")), lambda x: F.split(x, "-"))), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x))
    return F.array_distinct(F.concat(ends, hosts, parts, names))


def listed(url_host: Column, url_path: Column, rules: tuple = LISTED) -> Column:
    """A struct (rule, verdict) of the longest listed rule that fits, or null."""
    out: Column | None = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:])):
        fits = ((url_host == h) | url_host.endswith("." + h)) & url_path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def surely(hits: Column, n: Column, width: float = SURE) -> Column:
    """The lower end of Wilson's interval for a share of hits in n."""
    share, z = hits / n, width * width
    return (share + z / (2 * n) - width * F.sqrt(share * (1 - share) / n + z / (4 * n * n))) / (1 + z / n)


def mine(labelled: DataFrame, support: float = SUPPORT, lift: float = LIFT, width: float = SURE) -> DataFrame:
    """Rules (id, tokens, anchor, n, n_bad, confidence, least) from labelled(url, bad): which tokens make a URL bad.

    All labelled rows count, with all of their tokens that are frequent. Tokens that stand in exactly the same rows are
    mined as one and stand in a rule together. What bounds the work is `support` alone. confidence is n_bad / n, least the
    lower end of its interval. Rows whose url or label is null are left out; repeated ones count each; without labelled
    rows, or without bad or good ones, there are no rules.
    """
    spark = labelled.sparkSession
    scratch = Scratch(spark, "rules")
    rows = scratch.cut(labelled.filter("url is not null and bad is not null").select(F.monotonically_increasing_id().alias("row"), tokens(F.col("url")).alias("tokens"), F.col("bad").cast("boolean").alias("bad")))
    total, bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    kind = "id long, tokens array<string>, anchor string, n long, n_bad long, confidence double, least double"
    if not total or bad in (0, total):
        return spark.createDataFrame([], kind)
    support = min(1.0, max(support, ROWS / total))
    each = rows.select("row", F.explode("tokens").alias("token"))
    mark = F.xxhash64("row", F.lit(7))
    often = each.groupBy("token").agg(F.count("*").alias("n"), F.sum(mark.cast("decimal(38,0)")).alias("mark"), F.bit_xor(mark).alias("mark2")).filter(F.col("n") >= support * total)
    often = scratch.cut(often.withColumn("item", F.min("token").over(Window.partitionBy("n", "mark", "mark2"))))
    known = rows.select("row", "bad", F.explode("tokens").alias("token")).join(often.filter("token = item").select("token"), "token")
    baskets = known.groupBy("row").agg(F.first("bad").alias("bad"), F.collect_list("token").alias("items"))
    baskets = scratch.cut(baskets.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit("=bad")))).otherwise(F.col("items")).alias("items")))
    if baskets.isEmpty():
        return spark.createDataFrame([], kind)
    # shares are counted in rows that have a frequent token; support is one of all labelled rows
    least = max(1, math.ceil(support * total - 1e-9)) / baskets.count()
    sets = scratch.cut(FPGrowth(itemsCol="items", minSupport=min(1.0, least * (1 - 1e-12))).fit(baskets).freqItemsets)
    # a rule needs no table of all rules: its confidence is that of two frequent sets
    with_bad = sets.filter(F.array_contains("items", "=bad") & (F.size("items") > 1)).select(F.array_sort(F.array_remove("items", "=bad")).alias("few"), F.col("freq").alias("n_bad"))
    found = with_bad.join(sets.select(F.array_sort("items").alias("few"), F.col("freq").alias("n")), "few")
    found = found.withColumns({"confidence": F.col("n_bad") / F.col("n"), "least": surely(F.col("n_bad"), F.col("n"), width)}).filter(F.col("least") >= lift * bad / total)
    found = scratch.cut(found.withColumn("id", F.xxhash64("few")))
    # a rule is redundant if one with fewer of its tokens is as sure
    inner = found.select("id", "few", "confidence", F.explode("few").alias("token"))
    short = found.select(F.col("few").alias("part"), F.col("confidence").alias("sure"), F.element_at("few", 1).alias("token"))
    redundant = inner.join(short, "token").filter((F.size("part") < F.size("few")) & (F.col("sure") >= F.col("confidence")) & (F.size(F.array_except("part", "few")) == 0)).select("id").distinct()
    kept = found.join(redundant, "id", "left_anti")
    # back to all the tokens that an item stands for
    whole = kept.select("id", F.explode("few").alias("item")).join(often.select("item", "token", F.col("n").alias("seen")), "item")
    whole = whole.groupBy("id").agg(F.array_sort(F.collect_list("token")).alias("tokens"), F.min(F.struct("seen", "token"))["token"].alias("anchor"))
    return scratch.cut(kept.join(whole, "id").select("id", "tokens", "anchor", "n", "n_bad", "confidence", "least"))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, confidence): the surest mined rule of each distinct url that one fits."""
    index = rules.select("anchor", F.col("tokens").alias("need"), "confidence")
    index = F.broadcast(index) if rules.count() <= BROADCAST_RULES else index
    each = urls.filter("url is not null").select("url").distinct().withColumn("has", tokens(F.col("url")))
    met = each.select("url", "has", F.explode("has").alias("anchor")).join(index, "anchor")
    return met.filter(F.size(F.array_except("need", "has")) == 0).groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labelled: DataFrame, rules: tuple = LISTED, support: float = SUPPORT, lift: float = LIFT, width: float = SURE, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence) for every row of pages.

    rule is the longest listed rule that fits, else null; verdict is its own, else block where a mined rule fits
    (confidence is the surest one's) and allow elsewhere. A url that is null or without :// has an empty host and
    path; a null id is kept; repeated rows are judged each; an empty table gives none; other columns are dropped.
    """
    scratch = Scratch(pages.sparkSession, "judge")
    rows = pages.select(pages[page_id].alias("page_id"), pages[url].cast("string").alias("url"))
    mined = mine(labelled, support, lift, width)
    found = match(rows.select("url"), mined)
    out = rows.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))}).withColumn("hit", listed(F.col("host"), F.col("path"), rules))
    # one url may be a third of all rows; the urls that a rule fits are broadcast while they are few
    fits = scratch.cut(found)
    out = out.join(F.broadcast(fits) if fits.count() <= BROADCAST_RULES else fits, "url", "left")
    verdict = F.coalesce("hit.verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "confidence")
