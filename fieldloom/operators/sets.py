"""Set algebra over rows: differences of versions, reconciling, tags, splits, seals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def commit_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, change) with added, removed or kept."""
    both = a.select(key).distinct().withColumn("_a", F.lit(True)).join(b.select(key).distinct().withColumn("_b", F.lit(True)), key, "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("kept")
    return both.select(key, change.alias("change"))


def histogram_delta(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    counts = [df.groupBy(column).agg(F.count(F.lit(1)).alias(n)) for df, n in ((a, "n_a"), (b, "n_b"))]
    both = counts[0].join(counts[1], column, "full").fillna(0, ["n_a", "n_b"])
    return both.withColumn("delta", F.col("n_b") - F.col("n_a"))


def reconcile(old: DataFrame, new: DataFrame, keys: list[str], evidence: str, ruled: str) -> DataFrame:
    """(keys, action): what to do with each identity. Rows a person ruled on never change (skip, or evidence where it
    differs); others are inserted, updated, left unchanged, or pruned when the new side lacks them."""
    both = old.select(*keys, F.col(evidence).alias("_was"), F.col(ruled).alias("_ruled"), F.lit(True).alias("_old")).join(
        new.select(*keys, F.col(evidence).alias("_now"), F.lit(True).alias("_new")), keys, "full"
    )
    same = F.col("_was").eqNullSafe(F.col("_now"))
    action = (
        F.when(F.col("_old").isNull(), "insert")
        .when(F.col("_new").isNull(), F.when(F.col("_ruled"), "skip").otherwise("prune"))
        .when(F.col("_ruled"), F.when(same, "skip").otherwise("evidence"))
        .when(same, "unchanged")
        .otherwise("update")
    )
    return both.select(*keys, action.alias("action"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row of each key; of equal versions the new side's."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_side")))
    return both.withColumn("_n", last).where("_n = 1").drop("_n", "_side")


def retag(tags: str, add: list[str], remove: list[str]) -> Column:
    return F.array_sort(F.array_except(F.array_union(tags, F.array(*map(F.lit, add)).cast("array<string>")), F.array(*map(F.lit, remove)).cast("array<string>")))


def hash_share(seed: str, group: str) -> Column:
    """A stable number in [0, 1) for each group: the first 64 bits of SHA-256 of seed:group."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")), 256), 1, 16)
    return F.conv(head, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def assign_splits(df: DataFrame, group: str, val: float, test: float, seed: str = "0", slack: float = 1.25, parts: int = 4096) -> DataFrame:
    """(group, n, split): whole groups, in the order of their hashes, fill val, then test; the rest is train.

    A group enters the first split whose room is left and, with some slack, holds it. A wanted split that got none is
    given the smallest group of train (the first of equal ones), if train has another.

    Groups are summed up in `parts` ranges of their hashes. A range goes whole where its sums show what each of its groups
    would get; the few in which a budget ends are walked group by group, on the driver, one range at a time."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("share", hash_share(seed, group))
    sizes = cut(sizes.withColumn("part", F.floor(F.col("share") * parts).cast("int")))
    sums = sizes.groupBy("part").agg(F.sum("n").alias("sum"), F.min("n").alias("min"), F.max("n").alias("max")).orderBy("part").collect()
    total = sum(r["sum"] for r in sums)
    room = {name: share * total for name, share in (("val", val), ("test", test)) if share > 0}
    whole, single, got = {}, {}, set()
    for r in sums:
        told = None
        for name, left in room.items():
            if left > 0 and r["min"] <= left * slack:  # some may enter
                if left - r["sum"] > 0 and r["max"] <= (left - r["sum"] + r["max"]) * slack:  # all do
                    told = name
                else:
                    told = "mixed"
                break
        if told == "mixed":
            for g in sizes.where(F.col("part") == r["part"]).orderBy("share", group).collect():
                name = next((x for x, left in room.items() if left > 0 and g["n"] <= left * slack), "train")
                single[g[group]] = name
                if name in room:
                    room[name] -= g["n"]
                    got.add(name)
        elif told:
            whole[r["part"]] = told
            room[told] -= r["sum"]
            got.add(told)
    spark = df.sparkSession
    ranges = spark.createDataFrame(list(whole.items()), "part int, whole string")
    kind = df.schema[group].dataType.simpleString()
    named = lambda rows: spark.createDataFrame(list(rows.items()), f"`{group}` {kind}, single string")
    out = cut(sizes.join(F.broadcast(ranges), "part", "left").join(named(single), group, "left").select(group, "n", "share", F.coalesce("single", "whole", F.lit("train")).alias("split")))
    given = {}
    for name in (x for x in room if x not in got):
        free = out.where((F.col("split") == "train") & ~F.col(group).isin(list(given))) if given else out.where("split = 'train'")
        few = free.orderBy("n", "share", group).limit(2).collect()
        if len(few) > 1:
            given[few[0][group]] = name
    if given:
        out = out.join(named(given), group, "left").withColumn("split", F.coalesce("single", "split"))
    return out.select(group, "n", "split")


def leaking(df: DataFrame, group: str, split: str) -> DataFrame:
    return df.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def unambiguous(columns: list[str]) -> Column:
    """The values of a row as one text that no other row has: each with its length before it, nulls as a mark."""
    text = [F.col(f"`{c}`").cast("string") for c in columns]
    return F.concat(*(F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text))


def fingerprint(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """A seal of a set of rows that does not depend on their order: SHA-256 over their sorted SHA-256 hashes.

    Different sets have different seals: values carry their lengths, and null is not the empty text. Equal rows count as
    often as they are there. Hashes are counted first, then sorted and folded within 4096 buckets of their first digits,
    then the buckets' hashes are, so no group holds more than its share of the different rows.
    """
    hashes = df.select(*by, F.sha2(unambiguous(columns), 256).alias("h")).groupBy(*by, "h").agg(F.count(F.lit(1)).alias("n"))
    hashes = hashes.withColumns({"bucket": F.substring("h", 1, 3), "h": F.concat("h", F.lit("x"), F.col("n").cast("string"))})
    fold = F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256)
    buckets = hashes.groupBy(*by, "bucket").agg(fold.alias("h"), F.sum("n").alias("n"))
    total = F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256), 1, 16)
    return buckets.groupBy(*by).agg(total.alias("seal"), F.sum("n").alias("n"))


def hash_sample(df: DataFrame, stratum: str, unique: str, k: int, seed: str = "s") -> DataFrame:
    """The k rows of each stratum whose hashes come first."""
    order = F.sha2(F.concat(F.lit(seed), F.col(unique).cast("string")), 256)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(order))).where(F.col("_r") <= k).drop("_r")


def largest_remainder(df: DataFrame, weight: str, total: int, unique: str) -> DataFrame:
    """Whole shares of a total in proportion to weights; what is left goes to the largest fractions."""
    exact = total * F.col(weight) / F.sum(weight).over(Window.partitionBy())
    df = df.withColumn("_exact", exact).withColumn("share", F.floor("_exact"))
    left = total - F.sum("share").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("_exact") - F.col("share")), unique))
    return df.withColumn("_left", left).withColumn("_rank", rank).withColumn("share", F.col("share") + (F.col("_rank") <= F.col("_left")).cast("long")).drop("_exact", "_left", "_rank")


def psi(a: DataFrame, b: DataFrame, column: str, eps: float = 1e-6) -> DataFrame:
    """One row: the population stability index of two histograms, each smoothed and scaled to 1."""
    both = histogram_delta(a, b, column)
    everything = Window.partitionBy()
    share = {c: (F.col(n) / F.sum(n).over(everything) + eps) for c, n in (("r", "n_a"), ("c", "n_b"))}
    both = both.withColumns(share)
    both = both.withColumns({c: F.col(c) / F.sum(c).over(everything) for c in ("r", "c")})
    return both.agg(F.sum((F.col("c") - F.col("r")) * F.log(F.col("c") / F.col("r"))).alias("psi"))
