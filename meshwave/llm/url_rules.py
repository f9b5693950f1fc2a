"""URL filters: stated host and path rules, and association rules between URL tokens and a block label, mined by FP-growth.

Frequent token sets of labelled URLs give rules `tokens -> block`; support among the blocked, confidence and a gain over every part of
the rule prune them. Rules are matched through an inverted index: each hangs on its rarest token, and the URLs that have that token are
tested for the rest.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwave.llm.common import stage_table

#: A token set counts if so many blocked URLs have it, and this share of them.
MIN_COUNT = 20
MIN_SHARE = 0.01
MIN_CONFIDENCE = 0.6
GAIN = 0.05
#: Tokens that more than this share of the labelled URLs have tell nothing, and are in no rule.
USUAL = 0.95
LABEL = "label=block"
#: Rules that may be broadcast; more are joined by a shuffle.
BROADCAST_RULES = 20_000
#: (host, path, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _behind(url: Column) -> Column:
    """What follows the first `://`; null where there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """Behind the first `://` up to `/`, `?`, `#` or the end; ASCII letters in lower case; empty for nulls and urls without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(_behind(url), r"(?s)^([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """Behind the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(_behind(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def stated_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits: its host or a subdomain of it, and a path that starts with the rule's; else nulls."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def url_tokens(url: Column) -> Column:
    """Distinct tokens: scheme, every suffix of the host (at whole labels) and every label but the last, path parts (digits as 9) and their
    words, extension, query names, fragment. None for nulls and urls without host."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    plain = F.regexp_replace(path, r"[0-9]+", "9")
    parts = F.filter(F.split(plain, "/"), lambda x: x != "")
    words = F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda x: x != "")
    extension = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    tag = lambda name, c: F.concat(F.lit(name + "="), c)
    each = lambda name, xs: F.transform(xs, lambda x: tag(name, x))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: tag("host", F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    return F.when(
        host != "",
        F.array_distinct(
            F.concat(
                F.array(tag("scheme", F.lower(F.substring_index(url, "://", 1))), tag("fragment", F.instr(url, "#").cast("boolean").cast("string"))),
                suffixes, each("label", F.slice(labels, F.lit(1), F.size(labels) - 1)), each("part", parts), F.filter(each("word", words), lambda x: ~F.array_contains(each("part", parts), F.concat(F.lit("part="), F.substring(x, 6, 1 << 20)))),
                F.when(extension != "", F.array(tag("extension", extension))).otherwise(F.array().cast("array<string>")),
                F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: tag("query", F.substring_index(x, "=", 1))),
            )
        ),
    ).otherwise(F.array().cast("array<string>"))


def _indexed(sets: DataFrame, tokens: DataFrame) -> DataFrame:
    """sets (items, ...) with anchor: of its tokens the one of the fewest URLs (tokens: token, n); ties: the first by name."""
    each = sets.select("items", F.explode("items").alias("token")).join(tokens, "token")
    return sets.join(each.groupBy("items").agg(F.min_by("token", F.struct("n", "token")).alias("anchor")), "items")


def _fitting(urls: DataFrame, sets: DataFrame) -> DataFrame:
    """A row for each of urls (tokens, ...) and set (items, anchor, ...) that it has all tokens of."""
    if sets.count() <= BROADCAST_RULES:
        sets = F.broadcast(sets)
    return urls.withColumn("anchor", F.explode("tokens")).join(sets, "anchor").where(F.size(F.array_except("items", "tokens")) == 0).drop("anchor")


def mine_rules(labelled: DataFrame, min_share: float = MIN_SHARE, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT, gain: float = GAIN) -> DataFrame:
    """labelled (url, blocked) to rules: items (array of tokens, sorted), confidence, support (number of blocked URLs), anchor (its rarest token).

    All labelled rows count, repeats too; null labels and urls without host do not. Candidates are the token sets that min_count blocked
    URLs and min_share of them have; of tokens that the very same URLs have the first by name stands for all, and tokens of over USUAL
    of the URLs are left out. A rule stays if its confidence is at least min_confidence, above the share of blocked URLs by `gain`,
    and no rule of a part of its tokens comes within `gain` of it. No rules without blocked URLs, or of an empty table.
    """
    spark = labelled.sparkSession
    baskets = labelled.where(F.col("blocked").isNotNull()).select(url_tokens(F.col("url")).alias("tokens"), "blocked").where(F.size("tokens") > 0)
    baskets = stage_table(baskets.withColumn("id", F.monotonically_increasing_id()), "baskets")
    total, blocked = baskets.agg(F.count(F.lit(1)), F.sum(F.col("blocked").cast("long"))).first()
    empty = spark.createDataFrame([], "items array<string>, confidence double, support long, anchor string")
    if not blocked or min_count > blocked:
        return empty
    least = max(min_count, math.ceil(min_share * blocked - 1e-9))
    each = baskets.select("id", "blocked", F.explode("tokens").alias("token"))
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("blocked").cast("long")).alias("_b"), F.bit_xor(F.xxhash64("id")).alias("_who"))
    counts = counts.where((F.col("_b") >= least) & (F.col("n") <= USUAL * total)).groupBy("n", "_who").agg(F.min("token").alias("token")).select("token", "n")
    # a token has min_share of the blocked URLs at least, so there are at most (tokens of a URL) / min_share of them
    tokens = stage_table(counts, "tokens")
    items = stage_table(each.join(F.broadcast(tokens), "token").groupBy("id").agg(F.collect_list("token").alias("tokens"), F.max("blocked").alias("blocked")), "items")
    rows = items.count()
    if not rows:
        return empty
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / rows, minConfidence=1.0).fit(items.select(F.when(F.col("blocked"), F.concat("tokens", F.array(F.lit(LABEL)))).otherwise(F.col("tokens")).alias("items")))
    sets = stage_table(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "sets")
    hit = sets.where(F.array_contains("items", LABEL) & (F.size("items") > 1)).select(F.array_remove("items", LABEL).alias("items"), F.col("freq").alias("support"))
    rules = hit.join(sets.where(~F.array_contains("items", LABEL)), "items").withColumn("confidence", F.col("support") / F.col("freq")).drop("freq")
    rules = rules.where((F.col("confidence") >= min_confidence) & (F.col("confidence") >= blocked / total + gain))
    rules = stage_table(_indexed(rules, tokens), "rules")
    parts = rules.select(F.col("items").alias("_part"), F.col("confidence").alias("_c"), F.col("anchor").alias("_first"))
    # a part's anchor is among the rule's tokens
    smaller = rules.select("items", "confidence", F.explode("items").alias("_first")).join(parts, "_first")
    smaller = smaller.where((F.size("_part") < F.size("items")) & (F.size(F.array_except("_part", "items")) == 0) & (F.col("_c") + gain > F.col("confidence"))).select("items").distinct()
    return stage_table(rules.join(smaller, "items", "left_anti").select("items", "confidence", "support", "anchor"), "mined")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """key of urls (key, tokens) that one rule at least fits, and the tokens of the surest one (then the shortest, then the first by name)."""
    hits = _fitting(urls.select("key", "tokens"), rules.select("items", "anchor", "confidence"))
    best = F.max_by("items", F.struct("confidence", -F.size("items"), F.array_join("items", " ")))
    return hits.groupBy("key").agg(F.array_join(best, " & ").alias("mined"))


def judge_urls(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, mined for each row of pages (page_id, url), repeats and nulls too.

    A stated rule decides; else `block` where a mined rule fits, and `allow`. mined: the tokens of the surest mined rule that fits, whoever
    decides. Ties of stated rules: the longest, then the first by name. Urls of any length are taken whole; an empty table gives none. Other
    columns are not read. Mined rules are matched once for each distinct url.
    """
    own = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rule, verdict = stated_rule(F.col("host"), F.col("path"), rules)
    marked = own.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("rule", rule).withColumn("_verdict", verdict)
    mined = mine_rules(labelled)
    hit = match_rules(own.where("url is not null").select(F.col("url").alias("key")).distinct().withColumn("tokens", url_tokens(F.col("key"))), mined)
    joined = marked.join(hit.withColumnRenamed("key", "url"), "url", "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("_verdict", F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined")


def labels_of(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """url, blocked of the pages (page_id, url) that a stated rule decides, as it does, and of the others whose document has labels: a page
    shows the document of the number that ends its path, and one of low quality or toxic is blocked."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    _, verdict = stated_rule(F.col("_host"), F.col("_path"), rules)
    number = F.regexp_extract(F.col("_path"), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    marked = pages.select("url", host.alias("_host"), path.alias("_path")).withColumn("_verdict", verdict).withColumn("_doc", F.when(number != "", number.cast("long")))
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")
    judged = labels.groupBy(F.col("doc_id").alias("_doc")).agg(F.max(bad).alias("_b"))
    stated = marked.where("_verdict is not null").select("url", (F.col("_verdict") == "block").alias("blocked"))
    return stated.union(marked.where("_verdict is null").join(judged, "_doc").select("url", (F.col("_b") == 1).alias("blocked")))


def op8_url_rules(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, labels_of(pages, spark.read.parquet(f"{sf_dir}/labels.parquet")))


#: What SQL can say of the query: all but the mined rules.
HOST_PATH_RULE_SQL = r"""
with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
h as (select page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u),
r(rule_host, rule_path) as (values ('com', '/'), ('example.com', '/en/'), ('www.example.com', '/en/'), ('net', '/es/'), ('net', '/fr/'))
select page_id, host, path,
       (select arg_max(rule_host || rule_path, length(rule_host || rule_path)) from r
        where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)) as rule
from h
"""
