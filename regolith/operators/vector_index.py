"""A stored index of vectors in cells: built, opened, appended to, and searched by any number of queries in one pass.

The cells are those of centroids that k-means finds on a bounded sample (SAMPLE rows, the smallest hashes of the ids); every row is
put in the cell of its nearest centroid. An index is a folder: `cells`, a Parquet table partitioned by cell, and `centroids`, one row
a cell with the names of the encoder and of the index's version. Whoever opens it names the encoder that made the queries, and another
one than the index was built with is refused, as their vectors have nothing to do with each other.

A search reads the cells whose centroids are nearest to a query, `probes` of them; with all cells it is exact. A unit of work is a part
of a cell, of at most about PART rows: a task holds the part as a matrix and streams the queries of the cell along it. So neither a
cell that many rows share nor a large set of queries has to fit anywhere, and nothing but centroids is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of the sample, cells at most, rows of a part, rounds of k-means.
SAMPLE, CELLS, PART, ROUNDS = 1 << 16, 1024, 1 << 15, 8
VERSION = 1
#: Scores count to so many places, so that the order of a sum decides nothing.
PLACES = 12


def nearest(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(query, item, score, rank): the k nearest items of each query by cosine, ties by item; exact, over all items.

    queries: (query, vector); items: (item, vector). Null vectors take no part; one without length, or of another length, has cosine 0.
    """
    parts = max(1, -(-items.count() // PART))
    parts = max(parts, min(8, -(-parts * PART // 4096)))  # a small set is still worth several tasks
    held = items.select(F.lit(0).alias("cell"), F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int").alias("part"), "item", "vector")
    asked = queries.select(F.lit(0).alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "query", "vector")
    return _best(asked, held, k)


class VectorIndex:
    """An index that lies at `path`."""

    def __init__(self, spark: SparkSession, path: str, encoder: str, centroids: np.ndarray):
        self.spark, self.path, self.encoder, self.centroids = spark, path, encoder, centroids

    @classmethod
    def build(cls, rows: DataFrame, path: str, encoder: str, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Writes rows (item, vector) as an index of vectors that `encoder` made; a folder that is there already is an error."""
        rows = rows.filter(F.col("vector").isNotNull()).select("item", F.col("vector").cast("array<double>").alias("vector"))
        some = rows.select(F.xxhash64("item").alias("h"), "vector").orderBy("h", "vector").limit(sample).collect()
        if not some:
            raise ValueError("an index takes at least one vector, to know its cells")
        if cells is None:
            cells = max(1, min(CELLS, int(np.sqrt(rows.count())), len(some)))
        widths = [len(r.vector) for r in some]
        width = max(set(widths), key=widths.count)  # vectors of another length go to the first cell
        centroids = fit(np.array([r.vector for r in some if len(r.vector) == width], np.float64), cells)
        spark = rows.sparkSession
        told = [(i, c.tolist(), encoder, VERSION) for i, c in enumerate(centroids)]
        spark.createDataFrame(told, "cell int, centroid array<double>, encoder string, version int").coalesce(1).write.parquet(f"{path}/centroids")
        index = cls(spark, path, encoder, centroids)
        index._add(rows, "errorifexists")
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str, encoder: str) -> VectorIndex:
        """The index at path; ValueError if another encoder or version made it."""
        found = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
        made, version = found[0].encoder, found[0].version
        if made != encoder:
            raise ValueError(f"the index holds vectors of {made!r}, not of {encoder!r}")
        if version != VERSION:
            raise ValueError(f"the index is of version {version}, not {VERSION}")
        return cls(spark, path, encoder, np.array([r.centroid for r in found], np.float64))

    def append(self, rows: DataFrame) -> None:
        """Puts further rows (item, vector) into the cells; centroids stay."""
        rows = rows.filter(F.col("vector").isNotNull()).select("item", F.col("vector").cast("array<double>").alias("vector"))
        self._add(rows, "append")

    def rows(self) -> DataFrame:
        """(item, vector, cell) of all rows."""
        return self.spark.read.parquet(f"{self.path}/cells").select("item", "vector", "cell")

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query, item, score, rank): the k nearest items in the `probes` nearest cells of each query (all cells: None), ties by item."""
        cells = len(self.centroids)
        probes = cells if probes is None else min(probes, cells)
        kind = queries.schema["query"].dataType
        if probes == cells:
            return nearest(queries, self.rows(), k)  # all rows are met, and queries go to parts of them instead of to every cell
        told = queries.filter(F.col("vector").isNotNull()).select("query", F.col("vector").cast("array<double>").alias("vector"))
        asked = _near_cells(told, "query", self.centroids, probes, kind)
        rows = self.rows()
        wanted = [r.cell for r in asked.select("cell").distinct().collect()]  # at most all cells, which are bounded; scans skip the others
        rows = rows.filter(F.col("cell").isin(wanted))
        parts = {r.cell: -(-r.n // PART) for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        if not parts:
            return _best(asked.limit(0).withColumn("part", F.lit(0)), rows.limit(0).withColumn("part", F.lit(0)), k)
        of_cell = F.try_element_at(F.create_map(*(F.lit(x) for kv in parts.items() for x in kv)), F.col("cell"))
        held = rows.select("cell", F.pmod(F.xxhash64("item"), of_cell).cast("int").alias("part"), "item", "vector")
        dealt = asked.filter(F.col("cell").isin(list(parts))).select("cell", F.explode(F.sequence(F.lit(0), of_cell - 1)).alias("part"), "query", "vector")
        return _best(dealt, held, k)

    def _add(self, rows: DataFrame, mode: str) -> None:
        placed = _near_cells(rows, "item", self.centroids, 1, rows.schema["item"].dataType)
        # files of a cell are few and of bounded size, however rows lay before
        dealt = placed.withColumn("_salt", F.pmod(F.xxhash64("item"), F.lit(4))).repartition("cell", "_salt").drop("_salt")
        dealt.write.mode(mode).option("maxRecordsPerFile", 1 << 20).partitionBy("cell").parquet(f"{self.path}/cells")


def encoded(rows: DataFrame, text: str, encoder: Callable[[Column], Column]) -> DataFrame:
    """rows with `vector`: an encoder's vectors of a text column; null for null and empty texts, which have none."""
    return rows.withColumn("vector", F.when(F.coalesce(F.col(text), F.lit("")) != "", encoder(F.col(text))))


def fit(vectors: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids of spherical k-means, begun with vectors spread through the sample; cells that run empty keep their place."""
    units = _units(vectors)
    units = units[np.abs(units).sum(axis=1) > 0] if len(units) else units
    if not len(units):
        return np.zeros((1, vectors.shape[1] if vectors.ndim == 2 else 0))
    cells = min(cells, len(units))
    centroids = units[np.linspace(0, len(units) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        home = np.concatenate([(units[i : i + 4096] @ centroids.T).argmax(axis=1) for i in range(0, len(units), 4096)])
        for c in np.unique(home):
            total = units[home == c].sum(axis=0)
            length = np.linalg.norm(total)
            if length > 0:
                centroids[c] = total / length
    return centroids


def _units(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True) if len(vectors) else np.ones((0, 1))
    return np.nan_to_num(vectors / np.where(length > 0, length, 1))


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Unit rows; a vector of another length, or one that has null components, is a row of zeros."""
    out = np.zeros((len(vectors), width))
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == width)
    if len(at) and width:
        out[at] = np.asarray(vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(at), width)
    out[~np.isfinite(out).all(axis=1)] = 0.0
    return _units(out)


def _near_cells(rows: DataFrame, name: str, centroids: np.ndarray, probes: int, kind) -> DataFrame:
    """(cell, name, vector): each row with the cells of its nearest centroids, ties by number."""
    arrow = to_arrow_type(kind)
    vector = pa.list_(pa.float64())

    def run(batches):
        for batch in batches:
            near = np.argsort(-np.round(_matrix(batch.column("vector"), centroids.shape[1]) @ centroids.T, PLACES), axis=1, kind="stable")[:, :probes]
            cell, row = near.ravel().astype(np.int32), np.repeat(np.arange(batch.num_rows), near.shape[1])
            for i in range(0, len(row), 4096):
                some = pa.array(row[i : i + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(cell[i : i + 4096]), batch.column(name).take(some), batch.column("vector").take(some).cast(vector)], schema=pa.schema([("cell", pa.int32()), (name, arrow), ("vector", vector)]))

    return rows.select(name, "vector").mapInArrow(run, f"cell int, {name} {kind.simpleString()}, vector array<double>")


def _best(asked: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """asked: (cell, part, query, vector); held: (cell, part, item, vector), at most about PART rows of a cell and part."""
    query_kind, item_kind = asked.schema["query"].dataType, held.schema["item"].dataType
    none_q, none_i = F.lit(None).cast(query_kind), F.lit(None).cast(item_kind)
    vector = F.col("vector").cast("array<double>").alias("vector")
    both = held.filter("vector is not null").select("cell", "part", F.lit(False).alias("asks"), none_q.alias("query"), "item", vector).unionByName(
        asked.filter("vector is not null").select("cell", "part", F.lit(True).alias("asks"), "query", none_i.alias("item"), vector)
    )
    ordered = both.repartition("cell", "part").sortWithinPartitions("cell", "part", "asks")
    schema = pa.schema([("query", to_arrow_type(query_kind)), ("item", to_arrow_type(item_kind)), ("score", pa.float64())])
    found = ordered.mapInArrow(lambda batches: _searched(batches, k, schema), f"query {query_kind.simpleString()}, item {item_kind.simpleString()}, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _searched(batches, k: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, parts, block = None, [], None
    for batch in batches:
        marks = list(zip(batch.column("cell").to_pylist(), batch.column("part").to_pylist(), batch.column("asks").to_pylist()))
        starts = [i for i in range(len(marks)) if i == 0 or marks[i] != marks[i - 1]]
        for a, b in zip(starts, [*starts[1:], len(marks)]):
            some = batch.slice(a, b - a)
            if marks[a][:2] != held:
                held, parts, block = marks[a][:2], [], None
            if not marks[a][2]:
                parts.append((some.column("item"), some.column("vector")))
                continue
            if not parts:
                continue
            if block is None:
                block = _block(parts)
            for i in range(0, some.num_rows, 256):
                yield from _ranked(some.slice(i, 256), *block, k, schema)


def _block(parts: list) -> tuple[pa.Array, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Items, their order, and for each length of vectors the rows and their matrix."""
    items = pa.concat_arrays([p[0] for p in parts])
    vectors = pa.concat_arrays([p[1] for p in parts])
    lengths = vectors.value_lengths().to_numpy()
    order = np.empty(len(items), np.int64)
    order[pc.sort_indices(items).to_numpy()] = np.arange(len(items))
    return items, order, {w: (at := np.flatnonzero(lengths == w), _matrix(vectors.take(pa.array(at)), w)) for w in np.unique(lengths).tolist()}


def _ranked(some: pa.RecordBatch, items: pa.Array, order: np.ndarray, matrices: dict, k: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    lengths = some.column("vector").value_lengths().to_numpy()
    rows, found, told = [], [], []
    for width in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == width)
        score = np.zeros((len(at), len(items)))
        if width in matrices:
            where, matrix = matrices[width]
            score[:, where] = np.round(_matrix(some.column("vector").take(pa.array(at)), width) @ matrix.T, PLACES)
        keep = min(k, len(items))
        least = np.partition(score, -keep, axis=1)[:, -keep] if keep else np.zeros(len(at))
        for i, row in enumerate(at.tolist()):
            best = np.flatnonzero(score[i] >= least[i])
            if len(best) > keep:
                best = best[np.lexsort((order[best], -score[i][best]))[:keep]]
            rows.append(np.full(len(best), row))
            found.append(best)
            told.append(score[i][best])
    if rows:
        yield pa.RecordBatch.from_arrays([some.column("query").take(pa.array(np.concatenate(rows))), items.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(told))], schema=schema)
