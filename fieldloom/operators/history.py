"""Versions of a table of labels: changes with their before-images, three-way merges, reverting, and a graph of commits.

A state is rows with a key, unique and not null; a change is a row (key, op, before, after) whose images are structs of all
other columns, null where the row was not there. Two rows are the same when all columns are, nulls included. Both sides of
every call have the same columns, in any order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph


def image(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.select(key, F.struct(*sorted(c for c in df.columns if c != key)).alias(name))


def restored(df: DataFrame, key: str, name: str, columns: list[str]) -> DataFrame:
    """Rows again from an image; where that is null there is none."""
    return df.where(F.col(name).isNotNull()).select(*(F.col(key) if c == key else F.col(f"{name}.`{c}`").alias(c) for c in columns))


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, op, before, after): insert, update or delete of each key that differs."""
    both = image(old, key, "before").join(image(new, key, "after"), key, "full").where(~F.col("before").eqNullSafe(F.col("after")))
    op = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    return both.select(key, op.alias("op"), "before", "after")


def applied(state: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """The state after a log's changes, whatever it was before them."""
    both = image(state, key, "now").join(log.select(key, "after", F.lit(True).alias("_hit")), key, "full")
    return restored(both.withColumn("now", F.when(F.col("_hit"), F.col("after")).otherwise(F.col("now"))), key, "now", state.columns)


def reverted(state: DataFrame, log: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(state, outcomes): each change of the log is taken back (reverted) unless its row was changed since (skipped): a
    later edit wins. Outcomes are (key, op, outcome)."""
    both = image(state, key, "now").join(log.select(key, "op", "before", "after", F.lit(True).alias("_hit")), key, "full")
    own = F.col("_hit") & F.col("now").eqNullSafe(F.col("after"))
    back = restored(both.withColumn("now", F.when(own, F.col("before")).otherwise(F.col("now"))), key, "now", state.columns)
    return back, both.where("_hit").select(key, "op", F.when(own, "reverted").otherwise("skipped").alias("outcome"))


def merged(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """(key, outcome, base, ours, theirs, result): a row for each key that is in any of the three.

    What only one side changed is taken (ours, theirs), what both changed alike is `both`, what neither did is kept.
    Changed differently, or changed here and deleted there, is a conflict, whose result is ours until it is settled."""
    rows = reduce(lambda a, b: a.join(b, key, "full"), (image(df, key, n) for df, n in ((base, "base"), (ours, "ours"), (theirs, "theirs"))))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    outcome = F.when(same("ours", "base") & same("theirs", "base"), "kept").when(same("theirs", "base"), "ours").when(same("ours", "base"), "theirs").when(same("ours", "theirs"), "both").otherwise("conflict")
    result = F.when(outcome == "theirs", F.col("theirs")).otherwise(F.col("ours"))
    return rows.select(key, outcome.alias("outcome"), "base", "ours", "theirs", result.alias("result"))


def settled(merge: DataFrame, key: str, choose: Column) -> DataFrame:
    """The merge with its conflicts settled: `choose` is true where theirs is taken."""
    theirs = (F.col("outcome") == "conflict") & choose
    return merge.withColumn("result", F.when(theirs, F.col("theirs")).otherwise(F.col("result"))).withColumn("outcome", F.when(F.col("outcome") == "conflict", "settled").otherwise(F.col("outcome")))


def recoded(state: DataFrame, key: str, column: str, names: dict) -> tuple[DataFrame, DataFrame]:
    """(state, log) with values of a vocabulary merged or renamed (old: new) or retired (old: None)."""
    pairs = F.create_map(*(F.lit(x) for k, v in names.items() for x in (k, "" if v is None else v)))
    found = pairs[F.col(column)]
    now = state.withColumn(column, F.when(found.isNull(), F.col(column)).when(F.col(column).isin([k for k, v in names.items() if v is None]), F.lit(None)).otherwise(found))
    return now, changes(state, now, key)


# Commits: (id, parent, other) with `other` the second parent of a merge; logs: (commit, key, op, before, after) against the first


def parents(commits: DataFrame) -> DataFrame:
    ends = commits.select(F.col("id").alias("child"), "parent").union(commits.select("id", "other"))
    return ends.where(F.col("parent").isNotNull())


def merge_base(commits: DataFrame, a: str, b: str) -> str | None:
    """The nearest commit that both come from: of those in common the one with the least steps to both, then by id."""
    edges = parents(commits)
    sides = []
    for name, start in (("da", a), ("db", b)):
        up = graph.ancestors(edges, [start]).groupBy("id").agg(F.min("depth").alias(name))
        own = commits.where(F.col("id") == start).select("id", F.lit(0).alias(name))
        sides.append(own.unionByName(up.where(F.col("id") != start)))
    found = sides[0].join(sides[1], "id").orderBy(F.col("da") + F.col("db"), "id").first()
    return found["id"] if found else None


def state_at(first: DataFrame, commits: DataFrame, logs: DataFrame, commit: str, key: str) -> DataFrame:
    """The state at a commit: of each key the last change on the way along first parents, else the first state's row."""
    line = commits.where(F.col("parent").isNotNull()).select(F.col("id").alias("child"), "parent")
    way = graph.ancestors(line, [commit], most=100_000).select(F.col("id").alias("commit"), "depth")
    way = way.unionByName(commits.where(F.col("id") == commit).select(F.col("id").alias("commit"), F.lit(0).alias("depth")))
    last = logs.join(way, "commit").groupBy(key).agg(F.min_by(F.struct("after"), "depth").alias("x")).select(key, F.col("x.after").alias("after"))
    return applied(first, last, key)
