r"""k-means on integer vectors with Drake's adaptive bounds.

Components are floor(256 * x), so that distances, sums and new centroids are exact integers and no result depends on how
rows are dealt. Every vector carries lower bounds on its distances to several nearest other centroids and one bound on
the distance to all the rest. A round first lowers the bounds by how far centroids have moved:

- the exact distance to the own centroid is under all bounds: nothing else is computed;
- it is under the bound of the rest: only the stored centroids are measured, and put in order again;
- otherwise the order cannot be certified, and all centroids are measured.

Bounds are rounded outwards and have to be met strictly, so ties always come to exact distances and go to the smaller
number. Vectors begin with k / 4 bounds; after each round as many are kept as any vector needed in it, k / 8 at least, and
what is cut off goes into the bound of the rest.

A round is one map over the vectors, written with their bounds to the shared folder, where it outlives executors. The
same map writes, for each task, counts, sums and distances by cluster, so that hot clusters are pre-aggregated and only
k rows a task are shuffled. The driver holds the k centroids, which k bounds.

Cases: null vectors, vectors of another length than `width` and those with null or non-finite components take no part;
vectors that repeat are rows of their own; a centroid without vectors stays; with fewer vectors than k each is a centroid;
a null vec_id is hashed as an empty one; equal hashes go by components; an empty table gives an empty result; further
columns are dropped, whatever their names; components beyond 2**26 after scaling raise an error, as distances would not fit in a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_kind, written
from .vector_ints import exact_type, matrix, sound, whole

CENTROIDS, ROUNDS, WIDTH = 40, 5, 64
#: Relative slack of floating-point roots; float32 bounds are rounded down besides.
SLACK = 1e-9


def integer_vectors(embeddings: DataFrame, width: int = WIDTH) -> DataFrame:
    """(vec_id, x array<int>) of the vectors that take part."""
    kept = embeddings.select("vec_id", "embedding").filter((F.size("embedding") == width) & sound(F.col("embedding")))
    return kept.select("vec_id", whole(F.col("embedding")).alias("x"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The k vectors with the smallest sha256 of `2:<vec_id>`, in order of the hash."""
    hashed = vectors.select(F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h"), "x")
    rows = hashed.orderBy("h", "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64)


def cluster(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): one row a vector that takes part."""
    vectors = integer_vectors(embeddings, width)
    centroids = first_centroids(vectors, k)
    spark = embeddings.sparkSession
    if not len(centroids):
        return vectors.limit(0).select(
            "vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string")))
        )
    stored = -(-len(centroids) // 4)
    state, before = vectors, None
    for step in range(rounds + 1):
        last = step == rounds
        state = written(_assigned(state, before, centroids, stored, last, width), "clusters")
        totals = state.filter("n is not null").groupBy("cluster").agg(
            F.sum("n").alias("n"), F.sum("distance").alias("distance"), F.max("deep").alias("deep"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(0 if last else width))
        ).collect()
        if last:
            break
        before, centroids = centroids, centroids.copy()
        for t in totals:
            centroids[t.cluster] = [t[f"s{i}"] // t.n for i in range(width)]
        # as many bounds as any vector went through, and one that held
        stored = min(stored, max(-(-len(centroids) // 8), 1 + max(t.deep for t in totals)))
    names = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    inertia = {t.cluster: t.distance for t in totals}
    told = [(c, inertia.get(c, 0), sum(inertia.values()), name) for c, name in names]
    of_each = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = state.filter("n is null").select("vec_id", "cluster", "distance")
    return found.join(F.broadcast(of_each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _assigned(state: DataFrame, before: np.ndarray | None, centroids: np.ndarray, stored: int, last: bool, width: int) -> DataFrame:
    """Vectors with their nearest centroid and bounds, and for each task a row (n not null) of each cluster's totals."""
    kind = arrow_kind(state, "vec_id")
    fields = [
        ("vec_id", kind), ("x", pa.list_(pa.int32())), ("cluster", pa.int32()), ("distance", pa.int64()), ("near", pa.list_(pa.int32())), ("low", pa.list_(pa.float32())),
        ("rest", pa.float32()), ("measured", pa.int32()), ("n", pa.int64()), ("deep", pa.int32()), ("sums", pa.list_(pa.int64())),
    ]
    schema = pa.schema(fields)
    fresh = before is None

    def run(batches):
        totals: dict[int, list] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                column = dict(zip(part.schema.names, part.columns))
                x = matrix(column["x"], width)
                bounds = None if fresh else _bounds(column)
                found = nearest(x, centroids, before, bounds, stored)
                count_in(totals, x, found)
                a, d2, near, low, rest, measured, _ = found
                if last:  # nothing reads bounds or components after the last round
                    bare = [pa.nulls(len(a), t) for t in (schema.field("x").type, schema.field("near").type, schema.field("low").type, pa.float32())]
                    x_out, near_out, low_out, rest_out = bare
                else:
                    x_out, near_out, low_out, rest_out = column["x"], _lists(near, pa.int32()), _lists(low, pa.float32()), pa.array(rest)
                yield pa.RecordBatch.from_arrays(
                    [column["vec_id"], x_out, pa.array(a, pa.int32()), pa.array(d2, pa.int64()), near_out, low_out, rest_out, pa.array(measured, pa.int32())]
                    + [pa.nulls(len(a), schema.field(c).type) for c in ("n", "deep", "sums")],
                    schema=schema,
                )
        if totals:
            rows = [{"cluster": c, "n": n, "distance": d, "deep": deep, "sums": None if last else s.tolist()} for c, (n, d, deep, s) in totals.items()]
            yield pa.RecordBatch.from_pylist([dict.fromkeys(schema.names) | r for r in rows], schema=schema)

    id_kind = state.schema["vec_id"].dataType.simpleString()
    source = state.select("vec_id", "x") if fresh else state.filter("n is null").select("vec_id", "x", "cluster", "near", "low", "rest")
    told = "x array<int>, cluster int, distance long, near array<int>, low array<float>, rest float, measured int, n long, deep int, sums array<long>"
    return source.mapInArrow(run, f"vec_id {id_kind}, {told}")


def nearest(x: np.ndarray, centroids: np.ndarray, before: np.ndarray | None, bounds: tuple | None, stored: int) -> tuple:
    """(cluster, squared distance, near, low, rest, measured, deep) of each row of x; all exact but the bounds, which never exceed the distance they stand for."""
    n, k = len(x), len(centroids)
    most = int(max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)))
    kind = exact_type(x.shape[1], 2 * most, 2 * most)
    kind = np.float64 if kind is np.float32 else kind
    x, c = x.astype(kind), centroids.astype(kind)
    if bounds is None:
        a, d2, near, low, rest = _all_measured(x, c, stored)
        return a, d2, near, low, rest, np.full(n, k, np.int32), np.full(n, near.shape[1], np.int32)
    a, near, low, rest = bounds
    moved = np.sqrt(((centroids - before).astype(np.float64) ** 2).sum(1)) * (1 + SLACK)
    low = _down(low.astype(np.float64) - moved[near]) if near.shape[1] else low
    rest = _down(rest.astype(np.float64) - moved.max())
    if near.shape[1] > stored:  # what is cut off goes into the bound of the rest
        order = np.argsort(low, axis=1, kind="stable")
        near, low = np.take_along_axis(near, order, 1), np.take_along_axis(low, order, 1)
        rest = np.minimum(rest, low[:, stored:].min(axis=1))
        near, low = near[:, :stored].copy(), low[:, :stored].copy()
    own = ((x - c[a]) ** 2).sum(axis=1)
    up = np.sqrt(own.astype(np.float64)) * (1 + SLACK)
    a, d2, near, low, rest = a.copy(), own.astype(np.int64), near.copy(), low.copy(), rest.copy()
    measured = np.ones(n, np.int32)
    # bounds that this vector's distance went through; the rest counts as one more
    through = (low <= up[:, None]).sum(axis=1).astype(np.int32)
    some = np.flatnonzero((through > 0) & (up < rest))
    if len(some):
        ids = np.concatenate([a[some, None], near[some]], axis=1)
        each = ((x[some, None, :] - c[ids]) ** 2).sum(axis=2)
        order = np.lexsort((ids, each), axis=1)
        ids, each = np.take_along_axis(ids, order, 1), np.take_along_axis(each, order, 1)
        # the own centroid is among them, so that the nearest of them is under the bound of the rest as well
        a[some], d2[some], near[some], low[some] = ids[:, 0], each[:, 0].astype(np.int64), ids[:, 1:], _root_down(each[:, 1:])
        measured[some] += near.shape[1]
    all_of = np.flatnonzero(up >= rest)
    if len(all_of):
        width = near.shape[1]
        a[all_of], d2[all_of], near[all_of], low[all_of], rest[all_of] = _all_measured(x[all_of], c, width)
        measured[all_of] = k
        through[all_of] = width
    return a, d2, near, low, rest, measured, through


def count_in(totals: dict[int, list], x: np.ndarray, found: tuple) -> None:
    """Adds rows, distances, the deepest bound and component sums of each cluster."""
    a, d2, deep = found[0], found[1], found[6]
    for c in np.unique(a).tolist():
        at = a == c
        n, d, most, sums = totals.get(c, (0, 0, 0, 0))
        totals[c] = [n + int(at.sum()), d + int(d2[at].sum()), max(most, int(deep[at].max())), sums + x[at].sum(axis=0).astype(np.int64)]


def _all_measured(x: np.ndarray, c: np.ndarray, stored: int) -> tuple:
    d2 = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    order = np.argsort(d2, axis=1, kind="stable")  # ties by number
    d2 = np.take_along_axis(d2, order, 1)
    stored = min(stored, len(c) - 1)
    rest = _root_down(d2[:, stored + 1]) if stored + 1 < len(c) else np.full(len(x), np.inf, np.float32)
    return order[:, 0].astype(np.int32), d2[:, 0].astype(np.int64), order[:, 1 : stored + 1].astype(np.int32), _root_down(d2[:, 1 : stored + 1]), rest


def _root_down(d2: np.ndarray) -> np.ndarray:
    return _down(np.sqrt(d2.astype(np.float64)) * (1 - SLACK))


def _down(bound: np.ndarray) -> np.ndarray:
    return np.nextafter(bound.astype(np.float32), np.float32(-np.inf))


def _bounds(column: dict) -> tuple:
    n = len(column["cluster"])

    def rows(name):
        return column[name].flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))

    return column["cluster"].to_numpy(), rows("near"), rows("low"), column["rest"].to_numpy()


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel(), kind))
