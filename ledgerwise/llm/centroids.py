"""Nearest centroids by equal-average equal-variance search, and Lloyd rounds in whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwise.llm.common import in_batches
from ledgerwise.shared import staged

#: Largest component in size: squared distances of up to 512 such components fit a long.
LARGEST = 1 << 26
_FAR = np.iinfo(np.int64).max
#: The bounds are floating point; what is this little above the best distance is still measured exactly.
_RELATIVE, _ABSOLUTE = 1e-9, 1e-3


class Centroids:
    """Finds the nearest of some whole-number centroids (squared Euclidean distance; ties: the smaller number).

    Centroids lie sorted by the mean of their components.  A vector looks at them outward from its own mean, the closer
    side first.  With n components, a squared distance is at least n times the squared difference of the means, so the
    scan of a vector ends once that is above its best; with the squared difference of the deviations added, a single
    centroid is passed over.  The rest is measured in whole numbers.
    """

    def __init__(self, points: list[list[int]]):
        made = np.array(points, np.int64)
        self.number = np.argsort(made.sum(1), kind="stable")
        self.points = made[self.number]
        self.mean, self.deviation = _moments(self.points)
        self.measured = 0

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each row, and the squared distance to it."""
        (rows, width), count = vectors.shape, len(self.points)
        mean, deviation = _moments(vectors)
        right = np.searchsorted(self.mean, mean)
        left = right - 1
        best, which = np.full(rows, _FAR), np.full(rows, count)
        live = np.arange(rows)
        while len(live):
            below, above = left[live], right[live]
            down = np.where(below >= 0, mean[live] - self.mean[np.maximum(below, 0)], np.inf)
            up = np.where(above < count, self.mean[np.minimum(above, count - 1)] - mean[live], np.inf)
            downward = down <= up
            average = width * np.minimum(down, up) ** 2
            limit = best[live] * (1 + _RELATIVE) + _ABSOLUTE
            on = average <= limit
            live, downward, average, limit = live[on], downward[on], average[on], limit[on]
            at = np.where(downward, below[on], above[on])
            left[live[downward]] -= 1
            right[live[~downward]] += 1
            close = average + (deviation[live] - self.deviation[at]) ** 2 <= limit
            seen, at = live[close], at[close]
            self.measured += len(seen)
            distance, number = ((vectors[seen] - self.points[at]) ** 2).sum(1), self.number[at]
            better = (distance < best[seen]) | ((distance == best[seen]) & (number < which[seen]))
            best[seen[better]], which[seen[better]] = distance[better], number[better]
        return which, best


def _moments(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean of each row, and the root of its summed squared differences from it."""
    mean = points.mean(1)
    return mean, np.sqrt(((points - mean[:, None]) ** 2).sum(1))


def whole_vectors(df: DataFrame, size: int, scale: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, point`` of the vectors with exactly ``size`` components, none null or non-finite; components become
    ``floor(scale * x)``.  Written once."""
    values = F.col(embedding).cast("array<double>")
    finite = F.forall(values, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kept = df.where(F.size(embedding) == size).where(finite)
    return staged(kept.select(F.col(vec_id).alias("vec_id"), F.transform(values, lambda x: F.floor(x * scale)).alias("point")), "points")


def first_centroids(points: DataFrame, count: int, salt: str) -> list[list[int]]:
    """Vectors whose ids have the smallest hexadecimal sha256 of ``<salt>:<vec_id>``, ascending; equal ids by their
    components.  Vectors without id come last."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    chosen = points.select("point", key.alias("key")).orderBy(F.asc_nulls_last("key"), "point").limit(count)
    return [r["point"] for r in chosen.collect()]


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    found = batch.column("point").flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64, copy=False)
    if found.size and max(-int(found.min()), int(found.max())) > LARGEST:
        raise ValueError(f"components beyond {LARGEST} in size: squared distances would not fit a long")
    return found


def means(points: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: every vector goes to its nearest centroid, which becomes the floor of their mean; empty ones stay.

    Each task adds up its vectors by centroid; the driver sees a row a centroid.
    """
    width = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Centroids(centroids)
        vectors, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), width), np.int64)
        for batch in batches:
            x = _matrix(batch, width)
            which, _ = search.nearest(x)
            vectors += np.bincount(which, minlength=len(centroids))
            np.add.at(sums, which, x)
        used = np.flatnonzero(vectors)
        columns = [pa.array(used.astype(np.int32)), pa.array(vectors[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "vectors", "sums"])

    of_task = in_batches(points.select("point"), run, "cluster int, vectors long, sums array<long>")
    one = of_task.select("cluster", "vectors", F.posexplode("sums").alias("place", "part"))
    one = one.groupBy("cluster", "place").agg(F.sum("vectors").alias("vectors"), F.sum("part").alias("sum"))
    now = [list(c) for c in centroids]
    for r in one.collect():
        now[r["cluster"]][r["place"]] = r["sum"] // r["vectors"]
    return now


def assigned(points: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""
    width, vec_id = len(centroids[0]), points.schema["vec_id"]
    schema = T.StructType([vec_id, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Centroids(centroids)
        for batch in batches:
            which, distance = search.nearest(_matrix(batch, width))
            arrays = [batch.column("vec_id"), pa.array(which.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "cluster", "distance"])

    return in_batches(points, run, schema)


def clustered(
    df: DataFrame,
    size: int = 64,
    scale: int = 256,
    count: int = 40,
    rounds: int = 5,
    salt: str = "2",
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector of ``size`` finite components.

    All arithmetic is in whole numbers, so the result does not depend on how the rows are dealt.  Vectors of another
    length, null ones and those with a null, NaN or infinite component are left out; repeated rows count as often as they
    occur; fewer vectors than ``count`` give as many centroids.  Components beyond ``LARGEST`` after scaling are an error.  No
    vector: no rows.  Other columns, whatever their names, are not read.
    """
    points = whole_vectors(df, size, scale, vec_id, embedding)
    centroids = first_centroids(points, count, salt)
    if not centroids:  # no rows
        types = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
        return points.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in types.items()))
    for _ in range(rounds):
        centroids = means(points, centroids)
    made = staged(assigned(points, centroids), "assigned")
    spread = dict(made.groupBy("cluster").agg(F.sum("distance")).collect())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of_cluster = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    return made.select(
        "vec_id", "cluster", "distance",
        of_cluster([spread.get(k, 0) for k in range(len(centroids))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(spread.values())).cast("long").alias("inertia"),
        of_cluster(digests).alias("centroid_sha256"),
    )
