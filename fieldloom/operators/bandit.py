"""Budgets over slices by Thompson sampling: what was learned so far is a table, a cycle's draws come from a seed.

A slice's state is (slice, alpha, beta, pulls): a Beta posterior of how likely its batch is to help. Slices are few; the
candidates may be many.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sets
from .graph import cut

STATE = "slice string, alpha double, beta double, pulls bigint"


def folded(state: DataFrame, rewards: DataFrame) -> DataFrame:
    """The state after rewards (slice, before, after): one up in alpha where the measure rose, else one in beta. Rewards
    measured on one side only teach nothing; slices not seen before start from Beta(1, 1)."""
    known = rewards.where(F.col("slice").isNotNull() & F.col("before").isNotNull() & F.col("after").isNotNull())
    rose = F.col("after") > F.col("before")
    sums = known.groupBy("slice").agg(F.count(F.when(rose, 1)).alias("up"), F.count(F.lit(1)).alias("n"))
    both = state.join(sums, "slice", "full")
    up, n = F.coalesce("up", F.lit(0)), F.coalesce("n", F.lit(0))
    return both.select("slice", (F.coalesce("alpha", F.lit(1.0)) + up).alias("alpha"), (F.coalesce("beta", F.lit(1.0)) + n - up).alias("beta"), (F.coalesce("pulls", F.lit(0)) + n).alias("pulls"))


def allocated(state: DataFrame, budget: int, seed: int) -> DataFrame:
    """(slice, alpha, beta, pulls, draw, share): one draw for each slice, from the seed and its name alone, and whole
    shares of the budget in proportion (largest remainders first, then by name)."""

    def draw(batches):
        for rows in batches:
            seeds = [int.from_bytes(hashlib.sha256(f"{seed}:{s}".encode()).digest()[:8], "big") for s in rows["slice"]]
            draws = [np.random.default_rng(k).beta(max(a, 1e-9), max(b, 1e-9)) for k, a, b in zip(seeds, rows["alpha"], rows["beta"], strict=True)]
            yield rows.assign(draw=pd.Series(draws, index=rows.index, dtype=float))

    rows = state.select("slice", "alpha", "beta", "pulls").mapInPandas(draw, f"{STATE}, draw double")
    return sets.largest_remainder(rows, "draw", budget, "slice")


def selected(candidates: DataFrame, shares: DataFrame, budget: int) -> DataFrame:
    """(id, slice, score, redistributed): each slice's best candidates (id, slice, score) up to its share, in the order of
    the slices' names, none twice; what is left of the budget goes to the best of the rest, whatever their slice.

    An id counts in a slice with its highest score; rows without a score or of no slice are left out; ties go to the
    smaller id. A step for each slice: shares and names are on the driver."""
    best = candidates.where(F.col("score").isNotNull() & F.col("slice").isNotNull() & F.col("id").isNotNull()).groupBy("slice", "id").agg(F.max("score").alias("score"))
    pool, taken = cut(best), None
    order = [F.desc("score"), "id"]
    for r in sorted(shares.select("slice", "share").collect()):
        free = pool.where(F.col("slice") == r["slice"])
        free = free if taken is None else free.join(taken.select("id"), "id", "left_anti")
        now = cut(free.orderBy(*order).limit(int(r["share"])).select("id", "slice", "score", F.lit(False).alias("redistributed")))
        taken = now if taken is None else taken.unionByName(now)
    if taken is None:
        return pool.select("id", "slice", "score", F.lit(False).alias("redistributed")).limit(0)
    rest = budget - taken.count()
    if rest > 0:
        names = shares.select("slice")
        free = pool.join(names, "slice", "left_semi").join(taken.select("id"), "id", "left_anti")
        one = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "slice"))
        free = free.withColumn("_n", one).where("_n = 1").orderBy(*order).limit(rest)
        taken = taken.unionByName(free.select("id", "slice", "score", F.lit(True).alias("redistributed")))
    return taken
