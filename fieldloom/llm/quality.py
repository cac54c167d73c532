"""Quality by perplexity under an interpolated modified Kneser-Ney model of character 4-grams.

The model learns from trusted text: all documents labelled good and not toxic but those kept apart. Counts, the three
discounts of each order, continuation counts and probabilities are joins and groupings of n-gram tables in
Spark, each dealt by its n-gram. A document's perplexity is over its characters and its end; it is kept unless that
exceeds the language's limit, the `QUANTILE` of the perplexities of trusted documents in the language; a quarter of
the trusted documents, by id, is kept from the model for that. Languages (or a null lang) with fewer than `ENOUGH` of
those have the limit of all of them.

While the finished tables hold at most `BROADCAST` n-grams they are broadcast; beyond that, blocks of texts send
their distinct n-grams to the shards, and the shards' answers meet the texts again.

Characters are code points, digits count as 0, those beyond 0xFFFE as one. A null or empty text has no perplexity and
is not kept. Without trusted documents all others are kept. Rows are judged one by one, repeated ids included.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, text_chunks, written

ORDER = 4
HELD = 1 << 20  # n-grams whose counts a task holds before it hands them on
QUANTILE = 0.99
ENOUGH = 20
BROADCAST = 4_000_000
START, END = 0, 1


def grams_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-grams of texts that lie one after another, each framed by three starts and an end, and their bounds."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    first = np.append(0, np.cumsum((data & 0xC0) != 0x80))[starts]
    points = np.minimum(points, 0xFFFF)
    points = np.where((points >= 48) & (points <= 57), 48, points)
    n = len(first) - 1
    bounds = first + 4 * np.arange(n + 1)
    ends, size = bounds[1:] - 1, len(points) + 4 * n
    framed = np.empty(size, np.uint64)
    inside = np.ones(size, bool)
    inside[ends] = False
    for k in range(3):
        inside[bounds[:-1] + k] = False
    framed[~inside] = START
    framed[ends] = END
    framed[inside] = points
    grams = (framed[:-3] << np.uint64(48)) | (framed[1:-2] << np.uint64(32)) | (framed[2:-1] << np.uint64(16)) | framed[3:]
    valid = np.ones(size, bool)
    for k in range(3):
        valid[bounds[:-1] + k] = False
    return grams[valid[3:]], bounds - 3 * np.arange(n + 1)


def count_grams(docs: DataFrame) -> DataFrame:
    """(gram, c) of all texts. A task hands its counts on whenever it holds `HELD` different n-grams."""
    held = HELD

    def table(keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["gram", "c"])

    def run(batches):
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            for _, _, data, starts in text_chunks(batch.column("text")):
                more, n = np.unique(grams_of(data, starts)[0], return_counts=True)
                keys, at = np.unique(np.append(keys, more), return_inverse=True)
                counts = np.bincount(at, np.append(counts, n), len(keys)).astype(np.int64)
                if len(keys) >= held:
                    yield table(keys, counts)
                    keys, counts = keys[:0], counts[:0]
        yield table(keys, counts)

    return docs.select("text").mapInArrow(run, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> list[float]:
    """D1, D2, D3+ from how many n-grams have each small count; 0.5 where those can't tell."""
    n1, n2, n3, n4 = counts.agg(*(F.count(F.when(F.col("c") == k, 1)) for k in (1, 2, 3, 4))).first()
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.5, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return [min(max(d, 0.1), k - 0.05) for k, d in enumerate(raw, 1)]


def fit(trusted: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (gram, p) of the n-grams seen, and (context, gamma), what their contexts leave over."""
    counts = [written(count_grams(trusted), "grams-4")]
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << (16 * k)) - 1)).alias("gram")
        counts.insert(0, written(counts[0].groupBy(suffix).agg(F.count(F.lit(1)).alias("c")), f"grams-{k}"))
    v, model = counts[0].count(), []
    for seen in counts:
        d1, d2, d3 = discounts(seen)
        c = F.col("c")
        off = F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        context = F.shiftrightunsigned("gram", 16).alias("context")
        left = seen.groupBy(context).agg(F.sum("c").alias("total"), (F.sum(off) / F.sum("c")).alias("gamma"))
        joined = seen.withColumn("context", F.shiftrightunsigned("gram", 16)).join(left, "context")
        own = (c - off) / F.col("total")
        if not model:
            found = joined.select("gram", (own + F.col("gamma") / (v + 1)).alias("p"))
        else:
            width = 16 * len(model)
            lower = model[-1][0].select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            joined = joined.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << width) - 1)))
            found = joined.join(lower, "suffix").select("gram", (own + F.col("gamma") * F.col("lower")).alias("p"))
        model.append((written(found, "probabilities"), written(left.select("context", "gamma"), "left-over")))
    return model


def log_probabilities(grams: np.ndarray, tables: list, unseen: float) -> np.ndarray:
    """log10 P of each gram's last character, from sorted (keys, values) of n-grams and contexts for each order."""
    p = np.full(len(grams), unseen)
    for k, ((keys, values), (contexts, gammas)) in enumerate(tables, 1):
        g = grams & np.uint64((1 << (16 * k)) - 1) if k < 4 else grams
        if not len(keys):
            continue
        at = np.minimum(np.searchsorted(contexts, g >> np.uint64(16)), len(contexts) - 1)
        p = np.where(contexts[at] == g >> np.uint64(16), gammas[at] * p, p)
        at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        p = np.where(keys[at] == g, values[at], p)
    return np.log10(p)


def text_perplexity(logs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """10 to the mean of -log10 P for each text; not a number for a text that is an end alone."""
    upto, n = np.append(0, np.cumsum(logs)), np.diff(bounds)
    return np.where(n > 1, 10 ** -(np.diff(upto[bounds]) / np.maximum(n, 1)), np.nan)


def perplexities(docs: DataFrame, model: list[tuple[DataFrame, DataFrame]], most: int = BROADCAST) -> DataFrame:
    """doc_id, lang, perplexity (null for an empty text) of each row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    size = sum(df.count() for pair in model for df in pair)
    unseen = 1.0 / (model[0][0].count() + 1)
    schema = "doc_id long, lang string, perplexity double"
    if size <= most:
        shared = spark.sparkContext.broadcast(([tuple(map(in_order, pair)) for pair in model], unseen))

        def run(batches):
            tables, unseen = shared.value
            for batch in batches:
                out = [np.empty(0)]
                for _, _, data, starts in text_chunks(batch.column("text")):
                    grams, bounds = grams_of(data, starts)
                    out.append(text_perplexity(log_probabilities(grams, tables, unseen), bounds))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(np.concatenate(out), from_pandas=True)], names=["doc_id", "lang", "perplexity"])

        return docs.mapInArrow(run, schema)
    n_blocks = max(1, -(-int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 16_000_000))
    blocks = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(n_blocks)).cast("int"))

    def arrow_grams(texts: pd.Series):
        parts = [grams_of(data, starts) for _, _, data, starts in text_chunks(pa.array(texts, pa.large_string()))]
        upto = np.cumsum([0, *(b[-1] for _, b in parts)])
        bounds = np.append(0, np.concatenate([b[1:] + u for (_, b), u in zip(parts, upto, strict=False)]))
        return np.concatenate([g for g, _ in parts]), bounds

    def ask(key, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": key[0], "gram": np.unique(arrow_grams(group["text"])[0]).view(np.int64)})

    asked = written(blocks.groupBy("block").applyInPandas(ask, "block int, gram long"), "asked")
    p = F.lit(unseen)
    wanted = asked.select("gram").distinct()
    for k, (seen, left) in enumerate(model, 1):
        g = F.col("gram").bitwiseAND(F.lit((1 << (16 * k)) - 1)) if k < ORDER else F.col("gram")
        wanted = wanted.withColumns({"g": g, "context": F.shiftrightunsigned(g, 16)})
        wanted = wanted.join(left, "context", "left").join(seen.select(F.col("gram").alias("g"), F.col("p").alias(f"p{k}")), "g", "left")
        p = F.coalesce(f"p{k}", F.coalesce("gamma", F.lit(1.0)) * p)
        wanted = wanted.withColumn(f"q{k}", p).drop("gamma", "g", "context", f"p{k}")
        p = F.col(f"q{k}")
    answers = asked.join(wanted.select("gram", F.log10(p).alias("log")), "gram")

    def meet(key, texts: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        given = given.assign(key=given["gram"].to_numpy().view(np.uint64)).sort_values("key")
        grams, bounds = arrow_grams(texts["text"])
        logs = given["log"].to_numpy()[np.searchsorted(given["key"].to_numpy(), grams)]
        return pd.DataFrame({"doc_id": texts["doc_id"], "lang": texts["lang"], "perplexity": text_perplexity(logs, bounds)})

    met = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(meet, schema)
    return met.withColumn("perplexity", F.nanvl("perplexity", F.lit(None).cast("double")))


def in_order(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    found = df.toArrow()
    keys, values = (c.to_numpy() for c in found.columns)
    keys = keys.view(np.uint64) if len(keys) else keys.astype(np.uint64)
    by = np.argsort(keys)
    return keys[by], values[by]


def trusted_ids(labels: DataFrame) -> DataFrame:
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return good.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull()).select("doc_id")


def judge_quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, lang, perplexity, limit, kept of each row of `docs`."""
    trusted = trusted_ids(labels)
    apart = crc_mod("doc_id", 4) == 0
    chosen = written(trusted.where(~apart), "trusted")
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(chosen, "doc_id", "left_semi")
    found = written(perplexities(docs, fit(text.where(F.length("text") > 0)), broadcast), "perplexities")
    of_trusted = found.join(trusted.where(apart), "doc_id", "left_semi").where(F.col("perplexity").isNotNull())
    at = F.percentile_approx("perplexity", quantile, 10_000)
    limits = of_trusted.groupBy("lang").agg(at.alias("own"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= ENOUGH) & F.col("lang").isNotNull())
    overall = of_trusted.agg(at.alias("overall")).first()["overall"]
    limit = F.coalesce("own", F.lit(float("inf") if overall is None else overall))
    judged = found.join(limits, "lang", "left").withColumn("limit", limit)
    return judged.select("doc_id", "lang", "perplexity", "limit", F.coalesce(F.col("perplexity") <= F.col("limit"), F.lit(False)).alias("kept"))
