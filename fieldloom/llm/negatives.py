"""Hard negatives by one-dimensional distance keys.

Vectors are whole numbers, floor(scale * component); the score is the inner product. With a component more, the root of
what its square lacks to the longest vector's, every row lies on one sphere, so that a higher score from an anchor is a
shorter distance. Rows are stored sorted by (pivot, distance to it), the nearest of `PIVOTS` pivots, in a table whose
statistics let a scan skip what lies outside an interval of keys.

A search starts at an inner radius (0, or where the highest score that is allowed lies) and goes outwards in annuli: by
the triangle inequality the rows between two radii of an anchor have keys in one interval for each pivot. Only rows new
to the annulus are scored. A search ends when it has its k best and its outer radius reaches the kth: nothing outside can
be better. Radii: first the best of a sample of at most `SAMPLE_ROWS` rows, then the kth score found so far, or half as
far again where there are fewer than k. All rows are indexed, the sample only places pivots and first radii; results are
exact. In high dimensions distances are much alike, and the intervals hold most rows.

Anchors go in slices of at most `slice_bytes` of vectors, each a few scans of the table; their states (a row for each
anchor and positive) are on the driver, the rows found are not. Rows with a null vec_id or label, a null vector, or any
null or non-finite component take no part. Shorter vectors count as if followed by zeros. Rows whose squared length is
2**52 or more have no key: each scan reads them, with exact scores, held within 64 bits. Repeated rows are rows of
their own, but never partners of an anchor of their id; an anchor id that repeats asks once, with its largest label and
vector. Ties go to the smaller vec_id. Anchors without a positive are not in the result. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .topk_search import integer_vectors, padded

PIVOTS = 64
SAMPLE_ROWS = 4096
SAMPLE_BYTES = 1 << 25
#: Scores of shorter vectors are exact in doubles.
HUGE = 2.0**52
NO_KEY = -1
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def usable(df: DataFrame) -> DataFrame:
    df = df.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    df = df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    return df.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def squares(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.einsum("ij,ij->i", x, x)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, held within 64 bits; in Python's whole numbers where doubles are too short."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if max(squares(a).max(), squares(b).max()) < HUGE:
        return (a @ b.T).astype(np.int64)
    whole = [[[int(v) for v in row] for row in m.tolist()] for m in (a, b)]
    return np.array([[min(max(sum(u * v for u, v in zip(x, y, strict=True)), LEAST), MOST) for y in whole[1]] for x in whole[0]], np.int64)


class Space:
    """The sphere on which all rows with a key lie: its dimensions, its squared radius, its pivots."""

    def __init__(self, width: int, most: float):
        self.width, self.most = width, most
        self.pivots = np.zeros((1, width + 1))

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.most - squares(x), 0))[:, None]])

    def place_pivots(self, sample: np.ndarray) -> None:
        """A few rounds of k-means over the sample."""
        points = self.lifted(sample)
        if not len(points):
            return
        self.pivots = np.unique(points, axis=0)[:: max(1, len(np.unique(points, axis=0)) // PIVOTS)][:PIVOTS]
        for _ in range(5):
            near = self.distances(points).argmin(axis=1)
            for p in np.unique(near):
                self.pivots[p] = points[near == p].mean(axis=0)

    def distances(self, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(squares(points)[:, None] + squares(self.pivots) - 2 * points @ self.pivots.T, 0))


def measured(rows: DataFrame, scale: int) -> tuple[int, float, int]:
    """The greatest length of a vector, the greatest square of one with a key, the number of rows."""

    def run(batches):
        width, most, n = 0, 0.0, 0
        for batch in batches:
            _, x = integer_vectors(batch.column("embedding"), scale)
            square = squares(x)
            width, most, n = max(width, x.shape[1]), max(most, square[square < HUGE].max(initial=0.0)), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([most], pa.float64()), pa.array([n], pa.int64())], names=["width", "most", "n"])

    found = rows.select("embedding").mapInArrow(run, "width int, most double, n long").agg(F.max("width"), F.max("most"), F.sum("n")).first()
    return int(found[0] or 0), float(found[1] or 0), int(found[2] or 0)


def key_table(rows: DataFrame, space: Space, scale: int) -> DataFrame:
    """(pivot, distance, vec_id, label, vector) sorted by pivot and distance; vectors are bytes of doubles."""
    shared = rows.sparkSession.sparkContext.broadcast((space.width, space.most, space.pivots))

    def run(batches):
        space = Space(*shared.value[:2])
        space.pivots = shared.value[2]
        for batch in batches:
            _, x = integer_vectors(batch.column("embedding"), scale)
            keyed = np.flatnonzero(squares(x) < HUGE)
            pivot, distance = np.full(len(x), NO_KEY, np.int32), np.zeros(len(x))
            away = space.distances(space.lifted(padded(x[keyed], space.width)))
            pivot[keyed] = away.argmin(axis=1)
            distance[keyed] = away.min(axis=1)
            vectors = pa.array([v.tobytes() for v in x], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(pivot), pa.array(distance), batch.column("vec_id"), batch.column("label"), vectors], names=["pivot", "distance", "vec_id", "label", "vector"])

    keys = rows.mapInArrow(run, "pivot int, distance double, vec_id long, label long, vector binary")
    # vec_id lets a crowd of equal vectors be dealt to several tasks
    return written(keys.repartitionByRange("pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance"), "distance-keys")


class Searches:
    """Searches of one slice of anchors: each for the `k` best scores from `low` to `high` among the rows of the
    anchor's label (`same`) or of others."""

    def __init__(self, space: Space, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.vectors, self.ids, self.labels, self.of, self.low, self.high, self.same, self.k = vectors, ids, labels, of, low, high, same, k
        square = squares(vectors)
        self.keyed = square < HUGE
        self.square, self.most = np.where(self.keyed, square, 0.0), space.most
        self.slack = 1e-6 * (np.sqrt(self.square) + np.sqrt(space.most) + 1)
        self.away = space.distances(np.hstack([np.where(self.keyed[:, None], vectors, 0.0), np.zeros((len(vectors), 1))]))
        farthest = (np.sqrt(self.square) + np.sqrt(space.most) + self.slack)[of]
        self.inner = np.where(high < MOST, self.radius(high) - 2 * self.slack[of], 0.0)
        self.end = np.where(low > LEAST, np.minimum(self.radius(low) + self.slack[of], farthest), farthest)
        self.bound, self.n = low.copy(), np.zeros(len(of), np.int64)
        self.done, self.outer = np.full(len(of), -1.0), self.end.copy()
        self.closed = ~(low <= high)

    def radius(self, score: np.ndarray) -> np.ndarray:
        """How far rows of a score are from the searches' anchors."""
        return np.sqrt(np.maximum(self.square[self.of] + self.most - 2 * score.astype(float), 0)) + self.slack[self.of]

    def start(self, ids: np.ndarray, labels: np.ndarray, sample: np.ndarray) -> None:
        """First radii and bounds from the sample: the best there is the first outer radius, the kth a lower bound."""
        for a in range(0, len(self.of), 256):
            part = np.arange(a, min(a + 256, len(self.of)))
            of = self.of[part]
            scores = exact_products(self.vectors[of], sample)
            scores[~self.fits(part, scores, ids, labels)] = LEAST
            best = -np.sort(-scores, axis=1)[:, : self.k] if scores.shape[1] else np.full((len(part), 1), LEAST)
            if best.shape[1] == self.k:
                self.bound[part] = np.maximum(self.bound[part], best[:, -1])
            first = np.where(best[:, 0] > LEAST, best[:, 0], self.low[part])
            self.outer[part] = np.where(best[:, 0] > LEAST, self.radius_of(part, first), self.inner[part] + (self.end[part] - self.inner[part]) / 4)
        self.outer = np.where(self.keyed[self.of], np.minimum(self.outer, self.end), np.inf)
        self.end = np.where(self.keyed[self.of], self.end, np.inf)

    def radius_of(self, part: np.ndarray, score: np.ndarray) -> np.ndarray:
        whole = np.zeros(len(self.of), np.int64)
        whole[part] = score
        return self.radius(whole)[part]

    def fits(self, part: np.ndarray, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
        of = self.of[part]
        fit = (self.labels[of][:, None] == labels) == self.same
        fit &= self.ids[of][:, None] != ids
        fit &= scores >= self.bound[part][:, None]
        fit &= scores <= self.high[part][:, None]
        return fit

    def intervals(self, pivot: int, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys of rows within the inner and an outer radius of the open searches."""
        away = self.away[self.of, pivot]
        return np.maximum(away - outer, self.inner - away) - self.slack[self.of], away + outer + self.slack[self.of]

    def settle(self, found: list) -> None:
        """Takes (search, n, kth score) of all rows so far: closes searches that are certain, widens the others."""
        for w, n, kth in found:
            self.n[w] = n
            if n >= self.k:
                self.bound[w] = max(self.bound[w], kth)
        self.closed |= self.outer >= self.end
        self.closed |= (self.n >= self.k) & (self.radius(self.bound) <= self.outer)
        self.done = self.outer.copy()
        wider = np.where(self.n >= self.k, self.radius(self.bound), self.inner + 1.5 * (self.outer - self.inner) + 0.1 * (self.end - self.inner))
        self.outer = np.minimum(wider, self.end)

    def scan(self, keys: DataFrame) -> DataFrame:
        """(search, vec_id, score): the best of each task among the rows that this round's annuli add."""
        shared = keys.sparkSession.sparkContext.broadcast(vars(self))
        pieces = F.col("pivot") == NO_KEY
        for p in range(self.away.shape[1]):
            low, high = (x[~self.closed] for x in self.intervals(p, self.outer))
            pieces = pieces | ((F.col("pivot") == p) & F.col("distance").between(float(low.min()), float(high.max())))

        def run(batches):
            asked = object.__new__(Searches)
            vars(asked).update(shared.value | {"bound": shared.value["bound"].copy()})
            found = Found(asked)
            for batch in batches:
                pivots = batch.column("pivot").to_numpy()
                cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(pivots)) + 1, np.arange(0, len(pivots), 1024), [len(pivots)]]))
                for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    part = batch.slice(i, j - i)
                    vectors = [np.frombuffer(v, float) for v in part.column("vector").to_pylist()]
                    x = np.stack([np.pad(v, (0, asked.vectors.shape[1] - len(v))) for v in vectors])
                    found.add(int(pivots[i]), part.column("distance").to_numpy(), part.column("vec_id").to_numpy(), part.column("label").to_numpy(), x)
            yield found.rows()

        return keys.where(pieces).mapInArrow(run, "search int, vec_id long, score long")


class Found:
    """What one task has found: at most k rows for each search, and some not yet sorted out."""

    def __init__(self, asked: Searches):
        self.asked, self.parts, self.size = asked, [], 0
        self.open = np.flatnonzero(~asked.closed)

    def add(self, pivot: int, distance: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        asked, open_ = self.asked, self.open
        if pivot == NO_KEY:
            open_ = open_[asked.done[open_] < 0]
        else:
            low, high = asked.intervals(pivot, asked.outer)
            had_low, had_high = asked.intervals(pivot, asked.done)
            open_ = open_[(high[open_] >= distance.min()) & (low[open_] <= distance.max())]
        for a in range(0, len(open_), 256):
            part = open_[a : a + 256]
            anchors, at = np.unique(asked.of[part], return_inverse=True)
            scores = exact_products(asked.vectors[anchors], x)[at]
            fit = asked.fits(part, scores, ids, labels)
            if pivot != NO_KEY:
                fit &= (distance >= low[part][:, None]) & (distance <= high[part][:, None])
                fit &= ~((asked.done[part] >= 0)[:, None] & (distance >= had_low[part][:, None]) & (distance <= had_high[part][:, None]))
            r, c = np.nonzero(fit)
            if len(r):
                self.parts.append((part[r], ids[c], scores[r, c]))
                self.size += len(r)
                if self.size > 1 << 18:
                    self.sort_out()

    def sort_out(self) -> None:
        search, ids, scores = (np.concatenate([p[c] for p in self.parts]) for c in range(3))
        order = np.lexsort((ids, -scores, search))
        search, ids, scores = search[order], ids[order], scores[order]
        place = np.arange(len(search)) - np.searchsorted(search, search)
        last = place == self.asked.k - 1
        self.asked.bound[search[last]] = np.maximum(self.asked.bound[search[last]], scores[last])
        keep = place < self.asked.k
        self.parts, self.size = [(search[keep], ids[keep], scores[keep])], 0

    def rows(self) -> pa.RecordBatch:
        if self.parts:
            self.sort_out()
        search, ids, scores = self.parts[0] if self.parts else (np.empty(0, np.int64),) * 3
        return pa.RecordBatch.from_arrays([pa.array(search.astype(np.int32)), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], names=["search", "vec_id", "score"])


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("search").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def searched(keys: DataFrame, searches: Searches, sample: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """(search, vec_id, score, rank) of all searches."""
    searches.start(*sample)
    found = keys.sparkSession.createDataFrame([], "search int, vec_id long, score long")
    while not searches.closed.all():
        found = found.unionByName(written(searches.scan(keys), "annulus"))
        searches.settle(best(found, searches.k).groupBy("search").agg(F.count(F.lit(1)), F.min("score")).collect())  # of one slice
    return best(found, searches.k)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, scale: int = 256, slice_bytes: int = 1 << 23) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each of the `positives` best rows
    of an anchor's label the k best of other labels that score from `low` to `high` percent of the positive.

    `rows` and `anchors`: vec_id, label, embedding."""
    spark = rows.sparkSession
    rows, asked = usable(rows), usable(anchors)
    width, most, n = measured(rows, scale)
    space = Space(width, most)
    n_sample = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(1, width))))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "embedding").limit(n_sample).toArrow()
    _, vectors = integer_vectors(sample.column("embedding"), scale)
    vectors, some = padded(vectors, width), (sample.column("vec_id").to_numpy(), sample.column("label").to_numpy())
    ordinary = squares(vectors) < HUGE
    space.place_pivots(vectors[ordinary])
    sample = some[0][ordinary], some[1][ordinary], vectors[ordinary]
    keys = key_table(rows, space, scale)
    asked = asked.groupBy("vec_id").agg(F.max(F.struct("label", "embedding")).alias("own")).select("vec_id", "own.*")
    size = asked.agg(F.sum(F.size("embedding") * 8 + 16)).first()[0] or 0
    n_slices, out = max(1, -(-int(size) // slice_bytes)), None
    for s in range(n_slices):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_slices)) == s).toArrow()
        _, x = integer_vectors(part.column("embedding"), scale)
        of = padded(x, max(width, x.shape[1])), part.column("vec_id").to_numpy(), part.column("label").to_numpy()
        of = of[0][:, :width], *of[1:]  # what is beyond the rows' width scores nothing
        every = np.arange(len(of[1]))
        near = searched(keys, Searches(space, *of, every, np.full(len(every), LEAST), np.full(len(every), MOST), True, positives), sample)
        near = near.orderBy("search", "rank").collect()  # `positives` for each anchor of the slice
        scores = [r["score"] for r in near]
        limits = np.array([(-(-low * p // 100), high * p // 100) for p in scores], np.int64).reshape(-1, 2)
        found = searched(keys, Searches(space, *of, np.array([r["search"] for r in near], np.int64), limits[:, 0], limits[:, 1], False, k), sample)
        pairs = [(w, int(of[1][r["search"]]), r["vec_id"], r["score"]) for w, r in enumerate(near)]
        pairs = spark.createDataFrame(pairs, "search int, anchor_id long, positive_id long, positive_score long")
        some = found.join(pairs, "search").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = some if out is None else out.unionByName(some)
    return out
