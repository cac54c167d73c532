"""Label errors by confident learning: what a model that never saw a row thinks of its label.

Rows are dealt into folds by a hash of their id; for each fold a logistic regression is fitted on the others, so every
probability is out of fold. A class's threshold is the mean probability of itself over the rows labelled with it. A row
counts as the most probable class among those that reach their threshold; where that is another than its label, the
label is suspect. Classes with fewer than `least` rows, and rows with a null id, label or vector or an odd component,
are left out; with fewer than two classes nothing is suspect.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut


def usable(df: DataFrame, unique: str, label: str, vector: str, least: int) -> tuple[DataFrame, list]:
    """(id, label, y, features): y numbers the classes, which are on the driver, as a model's coefficients are."""
    rows = df.where(F.col(unique).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(unique).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    classes = sorted(r["label"] for r in rows.groupBy("label").count().where(F.col("count") >= least).collect())
    number = F.create_map(*(F.lit(x) for pair in enumerate(classes) for x in reversed(pair))) if classes else F.create_map(F.lit(0), F.lit(0))
    rows = rows.where(F.col("label").isin(classes)).withColumn("y", number[F.col("label")].cast("double")).withColumn("features", array_to_vector("v"))
    return rows.select("id", "label", "y", "features"), classes


def out_of_fold(rows: DataFrame, folds: int = 5, strength: float = 1.0) -> DataFrame:
    """(id, label, y, p): the classes' probabilities by the model that was fitted without the row's fold.

    The penalty is that of the summed loss with inverse strength `strength`. A row of a class that is in one fold only has
    probability 0 of it."""
    rows = cut(rows.withColumn("fold", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(folds)).cast("int")))
    sizes = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}
    out = None
    for fold in sorted(sizes):
        rest = rows.where(F.col("fold") != fold)
        n = sum(sizes.values()) - sizes[fold]
        if not n:
            continue
        model = LogisticRegression(featuresCol="features", labelCol="y", family="multinomial", regParam=1.0 / (strength * n), standardization=False, maxIter=100, tol=1e-5).fit(rest)
        found = model.transform(rows.where(F.col("fold") == fold)).select("id", "label", "y", vector_to_array("probability").alias("p"))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else rows.select("id", "label", "y", F.array().cast("array<double>").alias("p")).limit(0)


def confident_joint(judged: DataFrame, n_classes: int) -> DataFrame:
    """`judged` with `at`, the class a row counts as: the most probable of those that reach their threshold (the first of
    equal ones), null where none does. Thresholds are one row."""
    own = F.get("p", F.col("y").cast("int"))
    mean = [F.coalesce(F.avg(F.when(F.col("y") == k, own)), F.lit(2.0)).alias(f"t{k}") for k in range(n_classes)]
    limits = judged.agg(*mean).select(F.array(*(f"t{k}" for k in range(n_classes))).alias("limits"))
    rows = judged.crossJoin(F.broadcast(limits))
    reach = F.filter(F.transform("p", lambda x, k: F.struct(x.alias("x"), (-k).alias("k"), (x >= F.get("limits", k)).alias("ok"))), lambda s: s["ok"])
    return rows.withColumn("at", -F.array_max(reach)["k"]).drop("limits")


def label_errors(df: DataFrame, unique: str = "vec_id", label: str = "label", vector: str = "embedding", least: int = 4, folds: int = 5) -> DataFrame:
    """(id, given, proposed, score, given_p, proposed_p): suspect labels; the score is 1 - the label's probability."""
    rows, classes = usable(df, unique, label, vector, least)
    kind = df.schema[label].dataType.simpleString()
    if len(classes) < 2:
        return rows.select("id", F.col("label").alias("given"), F.lit(None).cast(kind).alias("proposed"), *(F.lit(None).cast("double").alias(c) for c in ("score", "given_p", "proposed_p"))).limit(0)
    judged = confident_joint(out_of_fold(rows, folds), len(classes))
    names = F.array(*map(F.lit, classes))
    given = F.get("p", F.col("y").cast("int"))
    found = judged.where(F.col("at").isNotNull() & (F.col("at") != F.col("y")))
    return found.select("id", F.col("label").alias("given"), F.get(names, F.col("at")).cast(kind).alias("proposed"), (1 - given).alias("score"), given.alias("given_p"), F.get("p", F.col("at")).alias("proposed_p"))
