"""Centroid clustering of vectors that repeat: Lloyd's rounds over distinct quantised vectors with multiplicities.

Components become whole numbers first, so that equal vectors are equal exactly, sums have no rounding and the result doesn't depend on
the order of rows. A round reads only the distinct vectors: each task gives its sums for each cluster, at most clusters x components
numbers, and Spark adds them. Assignments go back to the vectors by a join on a 128-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastra.llm.common import stored

CLUSTERS, ROUNDS, COMPONENTS, SCALE = 8, 10, 64, 1024
_LONG = (1 << 63) - 1
_EXACT = 1 << 62
#: Rows whose distances are worked out together.
_BLOCK = 2048


class Clustering(NamedTuple):
    """assigned: (id, cluster, distance). centroids: (cluster, centroid, vectors, cluster_inertia, inertia), a row for each cluster."""

    assigned: DataFrame
    centroids: DataFrame


def usable(vector: Column, components: int = COMPONENTS) -> Column:
    """Whether a vector has that many components, none of them null, NaN or infinite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == components) & whole, F.lit(False))


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as a double; what is beyond a long is taken as the nearest long."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def _matrix(column: pa.ListArray, components: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, components)


def nearest(vectors: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row; of equally near ones the smaller number. Exact for all longs."""
    most = max((int(np.abs(vectors.astype(object)).max()) if np.abs(vectors.astype(np.float64)).max() > 1e9 else int(np.abs(vectors).max())), max(abs(x) for c in centroids for x in c)) if len(vectors) else 0
    kind = np.int64 if 4 * most * most * vectors.shape[1] < _EXACT else object
    points, best, least = vectors.astype(kind), np.zeros(len(vectors), np.int32), None
    for number, centroid in enumerate(centroids):
        apart = points - np.array(centroid, kind)
        distance = (apart * apart).sum(axis=1)
        if least is None:
            least = distance
        else:
            closer = (distance < least).astype(bool)
            best[closer], least[closer] = number, distance[closer]
    return best, least


def _sums(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], components: int) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, part, total) of one task: the weighted sum of every component, and the weight as part -1."""
    totals: dict[tuple[int, int], int] = {}
    for batch in batches:
        vectors, weights = _matrix(batch.column("q"), components), batch.column("weight").to_numpy()
        for at in range(0, len(vectors), _BLOCK):
            v, w = vectors[at : at + _BLOCK], weights[at : at + _BLOCK]
            cluster, _ = nearest(v, centroids)
            kind = np.int64 if float(np.abs(v.astype(np.float64)).max()) * float(w.sum()) < _EXACT else object
            for c in np.unique(cluster):
                mine = cluster == c
                w_mine = w[mine].astype(kind)
                for part, total in enumerate([w_mine.sum(), *(v[mine].astype(kind) * w_mine[:, None]).sum(axis=0)]):
                    key = (int(c), part - 1)
                    totals[key] = totals.get(key, 0) + int(total)
    keys = list(totals)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([Decimal(totals[k]) for k in keys], pa.decimal128(38, 0))], names=["cluster", "part", "total"])


def _assign(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], components: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = _matrix(batch.column("q"), components)
        found = [nearest(vectors[at : at + _BLOCK], centroids) for at in range(0, len(vectors), _BLOCK)]
        cluster = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int32)
        distance = [min(int(d), _LONG) for f in found for d in f[1]]
        yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), batch.column("weight"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["h1", "h2", "weight", "cluster", "distance"])


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = 3) -> Clustering:
    """Lloyd's rounds from the vectors with the least sha256 of ``seed:id`` (of equal ones the least vector; null ids come last).

    Every usable row is a vector, repeated ids and repeated rows too; rows that are not usable have no result. Fewer vectors than
    ``clusters`` make fewer clusters, no vectors an empty result. Ties go to the smaller number, empty centroids stay where they are,
    means are floored. Distances and sums beyond a long are given as the greatest long, but compared exactly. Other columns are not read.

    The driver holds clusters x components numbers a round. The vectors are shuffled once, map-side combined, so that a vector with a
    third of all rows is one row of each task; in the join back its rows are split as Spark splits skewed joins.
    """
    spark = vectors.sparkSession
    kept = vectors.where(usable(F.col(vector_col), components)).select(F.col(id_col).alias("id"), quantised(F.col(vector_col), scale).alias("q"))
    first = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("order"), "q").orderBy(F.col("order").asc_nulls_last(), "q").limit(clusters)
    centroids = [list(r["q"]) for r in sorted(first.collect(), key=lambda r: (r["order"] is None, r["order"] or "", r["q"]))]
    kind = vectors.schema[id_col].dataType.simpleString()
    if not centroids:
        return Clustering(spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long"), spark.createDataFrame([], "cluster int, centroid array<long>, vectors long, cluster_inertia long, inertia long"))
    hashes = [F.xxhash64(F.lit(n), "q").alias(f"h{n}") for n in (1, 2)]
    distinct = stored(kept.groupBy("q").agg(F.count("*").alias("weight")).select(*hashes, "q", "weight"), "vectors")

    for _ in range(rounds):
        parts = distinct.select("q", "weight").mapInArrow(lambda batches, c=centroids: _sums(batches, c, components), "cluster int, part int, total decimal(38,0)")
        sums = {(r["cluster"], r["part"]): int(r["total"]) for r in parts.groupBy("cluster", "part").agg(F.sum("total").alias("total")).collect()}
        centroids = [[sums[c, i] // sums[c, -1] for i in range(components)] if (c, -1) in sums else old for c, old in enumerate(centroids)]

    found = stored(distinct.mapInArrow(lambda batches: _assign(batches, centroids, components), "h1 long, h2 long, weight long, cluster int, distance long"), "clusters")
    weighted = F.sum(F.col("weight").cast("decimal(19,0)") * F.col("distance").cast("decimal(19,0)")).alias("inertia")
    totals = {r["cluster"]: (int(r["vectors"]), int(r["inertia"])) for r in found.groupBy("cluster").agg(F.sum("weight").alias("vectors"), weighted).collect()}
    whole = min(_LONG, sum(t[1] for t in totals.values()))
    rows = [(c, x, totals.get(c, (0, 0))[0], min(_LONG, totals.get(c, (0, 0))[1]), whole) for c, x in enumerate(centroids)]
    assigned = kept.select("id", *hashes).join(found.select("h1", "h2", "cluster", "distance"), ["h1", "h2"]).select(F.col("id").alias(id_col), "cluster", "distance")
    return Clustering(assigned, spark.createDataFrame(rows, "cluster int, centroid array<long>, vectors long, cluster_inertia long, inertia long"))
