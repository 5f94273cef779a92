"""URL filters: a short list of host and path rules first, then rules mined from labels.

A listed rule fits its host and all subdomains, if the path starts with the rule's; the longest
one that fits decides. Every other url is judged by association rules: urls of labelled pages
are taken as sets of tokens (host labels and their words, path segments with digits collapsed,
query names), Spark's FP-growth mines combinations that go with the label `block`, and those
below MIN_CONFIDENCE or under the least number of rows are pruned, as are combinations that
contain a shorter one which is as certain. What is left matches by an inverted index: a rule
stands under its rarest token, urls meet it there, and its other tokens are checked.

Native: columns, joins and Spark's own FP-growth. Urls are reduced to distinct token sets before
they meet the index, so a host with a third of all pages is one row per form of its urls. Tokens
that occur in just the same labelled urls count as one item, so that long paths shared by many
urls do not multiply combinations. The number of items and rules is bounded by the least
support, which is a share of the labelled rows; they are broadcast only after a count.

Defined results. A null url, one without `://` and an empty one have empty host and path, no
listed rule and no tokens, and are allowed. Urls of any length are taken whole. A page is bad if
any of its labels says toxic = 1 or quality = 0; a page with null labels only is not labelled.
Repeated rows of a page and url are learned from once and each get their verdict. Rules of equal
length: the one that sorts first. An empty table gives no rows; without enough bad pages nothing
is mined and what the list does not decide is allowed. Other columns are left aside, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators.joins import small_or_not, spread_join

from .common import store

# (verdict, host, path)
LISTED = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
          ("block", "net", "/es/"), ("block", "net", "/fr/")]
MIN_SUPPORT = 0.001    # of the labelled rows
MIN_ROWS = 20          # bad rows a rule needs at least
MIN_CONFIDENCE = 0.6
BLOCK = "=block"       # no token starts so

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"://([^/?#]*+)([^?#]*+)"


def low(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    return low(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as its host and path, and its verdict; null without one."""
    def fits(name: str, start: str) -> Column:
        return ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    return tuple(F.coalesce(*[F.when(fits(h, p), F.lit(value)) for value, h, p in
                              [(h + p if as_text else v, h, p) for v, h, p in order]], F.lit(None).cast("string"))
                 for as_text in (True, False))


def tokens(url: Column) -> Column:
    """The distinct tokens of a url, sorted."""
    def named(kind: str, values: Column) -> Column:
        return F.transform(F.array_remove(values, ""), lambda v: F.concat(F.lit(kind), v))
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    hyphened = F.flatten(F.transform(F.filter(labels, lambda x: F.contains(x, F.lit("-"))), lambda x: F.split(x, "-")))
    segments = F.split(F.regexp_replace(low(path), "[0-9]+", "#"), "/")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^?#]*+\?([^#]*+)", 1)
    names = F.transform(F.split(low(query), "&"), lambda x: F.substring_index(x, "=", 1))
    return F.array_sort(F.array_distinct(F.concat(
        named("h:", labels), named("w:", hyphened), named("p:", segments), named("q:", names))))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, url, bad) of the pages that have a label, repeated rows once."""
    says = F.when(F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False)), 1
                  ).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)
    known = labels.select(F.col("doc_id").alias("page_id"), says.alias("bad")).where("bad IS NOT NULL")
    known = known.groupBy("page_id").agg((F.max("bad") == 1).alias("bad"))
    return pages.select("page_id", "url").where("url IS NOT NULL").distinct().join(known, "page_id")


def mined_rules(labelled: DataFrame, min_rows: int = MIN_ROWS, min_support: float = MIN_SUPPORT,
                min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(items, n_rows, confidence): token combinations that go with `block`, from (page_id, url, bad)."""
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    rows = store(labelled.select("page_id", "url", "bad", tokens(F.col("url")).alias("tokens")), "url-rows")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad")).first()
    least = max(min_rows, -(-int(size["n"] * min_support * 1_000_000) // 1_000_000))
    empty = spark.createDataFrame([], "items array<string>, n_rows bigint, confidence double")
    if size["bad"] < least:
        return empty
    spread = rows.select("page_id", "url", "bad", F.explode("tokens").alias("token"))
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "page_id", "url")).alias(f"m{k}") for k in (1, 2)]
    counted = spread.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"), *marks)
    # Tokens of one group stand in one url together, so a group is no longer than a url. At
    # most (tokens of a url) / min_support tokens are frequent.
    items = counted.where(F.col("n_bad") >= least).groupBy("n", "m1", "m2").agg(
        F.array_sort(F.collect_list("token")).alias("members"))
    items = store(items.select(F.get("members", 0).alias("item"), "members", "n"), "url-items")
    known = spread_join(spread, items.select(F.explode("members").alias("token"), "item"), ["token"],
                        F.xxhash64("page_id", "url"), "inner")
    baskets = known.groupBy("page_id", "url", "bad").agg(F.collect_set("item").alias("found"))
    mark = F.when(F.col("bad"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))
    # Urls without a frequent token count too: support is a share of all labelled rows.
    every = rows.select("page_id", "url", "bad").join(baskets, ["page_id", "url", "bad"], "left").select(
        F.concat(F.coalesce("found", F.array().cast("array<string>")), mark).alias("basket"))
    model = FPGrowth(itemsCol="basket", minSupport=(least - 0.5) / size["n"], minConfidence=min_confidence).fit(
        store(every, "url-baskets"))
    mined = model.associationRules.where(F.get("consequent", 0) == BLOCK).select(
        F.array_sort("antecedent").alias("given"), "confidence",
        F.round(F.col("support") * size["n"]).cast("bigint").alias("n_rows"))
    mined = store(mined, "url-mined")
    shorter = mined.where(F.size("given") > 1).select(
        "given", "confidence", F.explode(F.transform("given", lambda x: F.array_remove(F.col("given"), x))).alias("part"))
    needless = shorter.join(mined.select(F.col("given").alias("part"), F.col("confidence").alias("c")), "part").where(
        "c >= confidence").select("given").distinct()
    kept = mined.join(needless, "given", "left_anti").withColumn("item", F.explode("given"))
    whole = kept.join(small_or_not(items), "item").groupBy("given", "n_rows", "confidence").agg(
        F.array_sort(F.flatten(F.collect_list("members"))).alias("items"))
    return whole.select("items", "n_rows", "confidence")


def matched_sets(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, confidence): the token sets that some rule fits, with its greatest confidence."""
    spread = sets.select("tokens", F.explode("tokens").alias("token"))
    needed = small_or_not(rules.select(F.explode("items").alias("token")).distinct())
    # Under which token of a rule the fewest sets stand.
    found = spread.join(needed, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    terms = rules.select("items", "confidence", F.explode("items").alias("token")).join(small_or_not(found), "token")
    index = terms.groupBy("items", "confidence").agg(
        F.min_by("token", F.struct("n", "token")).alias("token"))
    near = spread_join(spread, index, ["token"], F.xxhash64("tokens"), "inner")
    fit = near.where(F.size(F.array_except("items", "tokens")) == 0)
    return fit.groupBy("tokens").agg(F.max("confidence").alias("confidence"))


def judge_urls(pages: DataFrame, labels: DataFrame, listed: list[tuple[str, str, str]] = LISTED,
               min_rows: int = MIN_ROWS, min_support: float = MIN_SUPPORT,
               min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence) of every row of `pages` (page_id, url)."""
    rules = store(mined_rules(labelled_urls(pages, labels), min_rows, min_support, min_confidence), "url-rules")
    rows = pages.select("page_id", "url", tokens(F.col("url")).alias("tokens"))
    matched = store(matched_sets(rows.select("tokens").distinct(), rules), "url-matched")
    judged = spread_join(rows, matched, ["tokens"], F.xxhash64("page_id", "url"), "left")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parted = judged.select("page_id", host.alias("host"), path.alias("path"), "confidence")
    rule, verdict = listed_rule(F.col("host"), F.col("path"), listed)
    mined = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return parted.select("page_id", "host", "path", rule.alias("rule"),
                         F.coalesce(verdict, mined).alias("verdict"), "confidence")
