"""URL filtering by given rules and by association rules mined with FP-growth.

Given rules name a host (with all its subdomains) and a path prefix; the longest that fits a url decides. Urls that
none fits go by mined rules: the url's tokens (labels of the host, segments of the path, names in the query) of
labelled pages are transactions, together with the label itself. FP-growth finds the frequent combinations; of its
association rules those that conclude the label stay if support and confidence suffice, if the confidence exceeds the
label's share of all pages by a factor (`MIN_LIFT`) and by more than chance (`MIN_SURPRISE` standard deviations), and
if no rule with a part of their tokens is as sure. A mined rule is found by an inverted index of its rarest token,
then checked in full; the matching rule of the highest lift decides, then the surest, the better supported, the first
in the alphabet. With none, a url is allowed.

Everything is DataFrame work: no Python runs on executors. Verdicts are found once for each distinct url. A null url,
or one without `://`, has an empty host and path. Labels with nulls, and pages without a label, teach nothing; of
several labels of one page the worst counts. Without labelled pages there are no mined rules. Extra columns are not
looked at; repeated pages are judged alike.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

MIN_SUPPORT = 0.002
MIN_PAGES = 5
MIN_CONFIDENCE = 0.5
MIN_LIFT = 1.1
MIN_SURPRISE = 4.0
BLOCK, ALLOW = "=block", "=allow"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, query of a url; empty strings where there is none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    return tuple(F.coalesce(c, F.lit("")) for c in (lower_ascii(host), path, query))


def distinct_urls(pages: DataFrame) -> DataFrame:
    """url, host, path and sorted tokens of each distinct url."""
    host, path, query = url_parts(F.col("url"))
    urls = pages.select(F.col("url").cast("string")).distinct().withColumns({"host": host, "path": path, "query": query})
    names = F.transform(F.split("query", "&"), lambda x: F.concat(F.lit("?"), F.substring_index(x, "=", 1)))
    parts = F.concat(
        F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("."), x)),
        F.transform(F.split("path", "/"), lambda x: F.concat(F.lit("/"), x)),
        F.when(F.col("query") != "", names).otherwise(F.array()),
    )
    tokens = F.array_sort(F.array_distinct(F.filter(parts, lambda x: F.length(x) > 1)))
    return urls.withColumn("tokens", tokens).drop("query")


def given_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, action) for urls that a rule (action, rule as host/path) fits: the longest, then the first."""
    split = rules.select("action", "rule", F.substring_index("rule", "/", 1).alias("rule_host"), F.expr("substring(rule, instr(rule, '/'))").alias("rule_path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = urls.where(F.col("host") != "").select("url", "path", F.explode(suffixes).alias("rule_host")).join(split, "rule_host")
    found = found.where(F.col("path").startswith(F.col("rule_path")))
    best = F.min(F.struct((-F.length("rule")).alias("size"), "rule", "action")).alias("best")
    return found.groupBy("url").agg(best).select("url", "best.rule", "best.action")


def mined_rules(labelled: DataFrame, min_support: float, min_confidence: float, min_lift: float = MIN_LIFT) -> DataFrame:
    """(tokens, action, confidence, support, lift) from (tokens, bad)."""
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "tokens array<string>, action string, confidence double, support double, lift double")
    n, n_bad = labelled.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    if not n:
        return empty
    items = labelled.select(F.array_append("tokens", F.when(F.col("bad"), BLOCK).otherwise(ALLOW)).alias("items"))
    sets = FPGrowth(minSupport=min(1.0, max(min_support, MIN_PAGES / n))).fit(items).freqItemsets
    label = F.when(F.array_contains("items", BLOCK), BLOCK).when(F.array_contains("items", ALLOW), ALLOW)
    sets = written(sets.select(label.alias("label"), F.array_sort(F.array_except("items", F.array(F.lit(BLOCK), F.lit(ALLOW)))).alias("tokens"), "freq"), "frequent-sets")
    whole = sets.where("label IS NULL").select("tokens", F.col("freq").alias("held"))
    rules = sets.where(F.col("label").isNotNull() & (F.size("tokens") > 0)).join(whole, "tokens")
    base = F.when(F.col("label") == BLOCK, F.lit(n_bad / n)).otherwise(F.lit(1 - n_bad / n))
    rules = rules.withColumns({"confidence": F.col("freq") / F.col("held"), "base": base})
    chance = F.sqrt(F.col("base") * (1 - F.col("base")) / F.col("held"))  # of the share among as many pages that the rule says nothing about
    telling = (F.col("confidence") >= min_lift * F.col("base")) & (F.col("confidence") - F.col("base") >= MIN_SURPRISE * chance)
    rules = rules.where((F.col("confidence") >= min_confidence) & telling)
    rules = written(rules.select("tokens", F.substring("label", 2, 9).alias("action"), "confidence", (F.col("freq") / n).alias("support"), (F.col("confidence") / F.col("base")).alias("lift")), "mined-rules")
    # a rule with one token more must be surer than without it
    shorter = rules.select(F.col("tokens").alias("general"), F.col("confidence").alias("as_sure"), "action")
    less = rules.where(F.size("tokens") > 1).select("*", F.explode("tokens").alias("left_out"))
    less = less.withColumn("general", F.array_remove("tokens", F.col("left_out"))).join(shorter, ["general", "action"])
    return rules.join(less.where("as_sure >= confidence").select("tokens", "action").distinct(), ["tokens", "action"], "left_anti")


def mined_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, action) for urls that hold all tokens of a mined rule; rules without a lift go by their confidence."""
    rules = rules if "lift" in rules.columns else rules.withColumn("lift", F.lit(0.0))
    often = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    posted = rules.withColumn("rule_id", F.array_join("tokens", " ")).withColumn("token", F.explode("tokens")).join(often, "token")
    index = posted.groupBy("rule_id", "action").agg(
        F.min_by("token", F.struct("n", "token")).alias("token"), F.first("tokens").alias("needed"), F.first("confidence").alias("confidence"), F.first("support").alias("support"), F.first("lift").alias("lift")
    )
    hits = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("needed", "tokens")) == 0)
    best = F.min(F.struct((-F.col("lift")).alias("a"), (-F.col("confidence")).alias("b"), (-F.col("support")).alias("c"), "rule_id", "action")).alias("best")
    return hits.groupBy("url").agg(best).select("url", F.col("best.action").alias("mined"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of `pages` (page_id, url); labels: doc_id, quality, toxic."""
    urls = written(distinct_urls(pages), "urls")
    known = labels.where(F.col("quality").isNotNull() | F.col("toxic").isNotNull())
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    known = known.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))
    tagged = pages.select("page_id", F.col("url").cast("string")).join(known, "page_id").join(urls.select("url", "tokens"), "url")
    mined = mined_rules(written(tagged.select("tokens", "bad"), "labelled-urls"), min_support, min_confidence)
    verdicts = urls.select("url", "host", "path").join(given_verdicts(urls, rules), "url", "left").join(mined_verdicts(urls, mined), "url", "left")
    verdicts = verdicts.select(F.col("url").alias("judged"), "host", "path", "rule", F.coalesce("action", "mined", F.lit("allow")).alias("verdict"))
    out = pages.select("page_id", F.col("url").cast("string")).join(verdicts, F.col("url").eqNullSafe(F.col("judged")), "left")
    return out.select("page_id", "host", "path", "rule", "verdict")
