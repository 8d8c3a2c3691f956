"""Vector search: exact, batched, and approximate over an inverted file."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config
from ..errors import ValidationError
from ..functions.scores import cosine
from ..model import GraphView
from ..sources.files import Files

#: Vectors of a cell, on average, that one task writes.
CELL_ROWS = 1_000_000


def space(view: GraphView, vector_name: str | None = None, node_type: str | None = None) -> DataFrame:
    """id, vector of the nodes with the named vector; an unknown label has none."""
    name = vector_name or config.DEFAULT_VECTOR
    rows = view.nodes if node_type is None else view.nodes.where(F.col("node_type") == node_type)
    return rows.select("id", F.col("vectors")[name].alias("vector")).where("vector is not null")


def scored(vectors: DataFrame, query: Sequence[float]) -> DataFrame:
    """id, score; a vector without a cosine (other length, norm zero) stays with 0."""
    return vectors.select("id", F.coalesce(cosine(F.col("vector"), query), F.lit(0.0)).alias("score"))


def search(view: GraphView, query: Sequence[float], limit: int, node_type: str | None = None, vector_name: str | None = None, top_k: int | None = None, settings: config.VectorConfig = config.VectorConfig()) -> DataFrame:
    """All columns of the limit best nodes and their score, by score and then id. Only ids and vectors are scored; records
    are joined to the winners."""
    if not query:
        raise ValidationError("query_vector cannot be empty")
    limit = config.result_limit(limit)
    top_k = settings.semantic_top_k if top_k is None else config.result_limit(top_k)
    found = candidates(view, query, max(limit, top_k), node_type, vector_name, settings)
    best = scored(found, query).orderBy(F.desc("score"), "id").limit(limit)
    return view.nodes.join(F.broadcast(best), "id").orderBy(F.desc("score"), "id")


def uses_index(view: GraphView, query: Sequence[float], vector_name: str, settings: config.VectorConfig) -> bool:
    """Whether there is an index for a large space of the query's length."""
    index = view.vector_index
    return settings.backend != "exact" and index is not None and index.name == vector_name and index.dimension == len(query) and index.size > settings.exact_threshold


def candidates(view: GraphView, query: Sequence[float], k: int, node_type: str | None, vector_name: str | None, settings: config.VectorConfig) -> DataFrame:
    """id, vector: the k best by the index, if there is one for a large space of the query's length, else all.

    The settings.probes nearest cells give k scores; then every cell that can hold one as good as the last of them is read too, so
    that no true neighbour is lost. If those cells have fewer than k rows (a rare label), or the last score is 0, the search is exact."""
    index = view.vector_index
    if not uses_index(view, query, vector_name or config.DEFAULT_VECTOR, settings):
        return space(view, vector_name, node_type)
    labelled = None if node_type is None else view.nodes.where(F.col("node_type") == node_type).select("id")
    read = lambda cells: index.read(cells) if labelled is None else index.read(cells).join(labelled, "id", "left_semi")
    ordered = lambda rows: scored(rows, query).orderBy(F.desc("score"), "id").limit(k)
    cells, bound = index.nearest(query)
    found = read(cells[: settings.probes])
    scores = [r["score"] for r in ordered(found).collect()]  # k at most
    last = scores[-1] if len(scores) == k else 0.0
    if last <= 0:
        found = space(view, vector_name, node_type)
    elif more := [c for c in cells[settings.probes :] if bound[c] >= last]:
        found = read([*cells[: settings.probes], *more])
    return found.join(F.broadcast(ordered(found).select("id")), "id")


def search_batch(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """queries (query_id, vector), vectors (id, vector) -> query_id, id, score, rank: the k best of each query by score and then id.

    Queries are a stated set that meets all vectors in blocks: block queries go to the executors at a time, so what is
    shipped is bounded however many there are. Each Arrow batch is one matrix product and keeps its own k best a query; only these are
    shuffled. Vectors of another length than a query, or of norm zero, score 0."""
    out = None
    own = vectors.select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    for rows in _query_blocks(queries, block):
        found = own.mapInArrow(_best([r["query_id"] for r in rows], [r["vector"] or [] for r in rows], k), "query_id string, id string, score double")
        out = found if out is None else out.unionByName(found)
    return _top(out, k, vectors.sparkSession)


def _query_blocks(queries: DataFrame, block: int) -> Iterator[list]:
    numbered = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    parts = max(1, -(-queries.count() // block))
    for part in range(parts):
        if rows := (numbered if parts == 1 else numbered.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)).collect():
            yield rows


def _top(found: DataFrame | None, k: int, spark: SparkSession) -> DataFrame:
    if found is None:
        return spark.createDataFrame([], "query_id string, id string, score double, rank int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _best(query_ids: list, queries: list[list[float]], k: int, cells: list[list[int]] | None = None):
    """Batches (id, vector) or, with the cells that each query reads, (id, vector, cell)."""
    by_size: dict[int, list[int]] = {}
    for i, q in enumerate(queries):
        by_size.setdefault(len(q), []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices = {n: np.array([queries[i] for i in own], np.float64).reshape(len(own), n) for n, own in by_size.items()}
        unit = {n: m / np.where((norm := np.linalg.norm(m, axis=1, keepdims=True)) > 0, norm, np.inf) for n, m in matrices.items()}
        read = None
        if cells is not None:
            read = np.zeros((len(queries), 1 + max((c for x in cells for c in x), default=0)), bool)
            for i, x in enumerate(cells):
                read[i, x] = True
        for batch in batches:
            ids, lists = np.array(batch.column(0).to_pylist(), object), batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            order = np.argsort(ids.astype(str), kind="stable")
            allowed = None
            if read is not None:
                cell = batch.column(2).to_numpy(zero_copy_only=False)
                allowed = np.where(cell < read.shape[1], read[:, np.minimum(cell, read.shape[1] - 1)], False)[:, order]
            columns: list[list] = [[], [], []]
            for n, own in by_size.items():
                scores = np.zeros((len(own), len(ids)))
                at = np.flatnonzero(sizes == n)
                if n and len(at):
                    v = flat[starts[at][:, None] + np.arange(n)]
                    norm = np.linalg.norm(v, axis=1)
                    product = unit[n] @ (v / np.where(norm > 0, norm, np.inf)[:, None]).T
                    defined = (np.linalg.norm(unit[n], axis=1) > 0)[:, None] & (norm > 0)[None, :]
                    scores[:, at] = np.where(defined, (product + 1) / 2, 0.0)
                scores = scores[:, order]
                for row, i in enumerate(own):
                    some = np.arange(len(order)) if allowed is None else np.flatnonzero(allowed[i])
                    top = some[np.argsort(-scores[row, some], kind="stable")[:k]]
                    columns[0] += [str(query_ids[i])] * len(top)
                    columns[1] += ids[order[top]].tolist()
                    columns[2] += scores[row, top].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64())], names=["query_id", "id", "score"])

    return run


@dataclass
class InvertedFile:
    """Vectors by their nearest of some centroids, which are fitted on a bounded sample; every vector is indexed. It lies in a folder:
    the lists by cell and salt, and a small file with the centroids and the cells' radii, written last."""

    name: str
    dimension: int
    size: int
    centroids: np.ndarray
    lists: DataFrame  # id, vector, cell, salt
    radius: np.ndarray  # the largest angle between a centroid and a vector of its cell

    def nearest(self, query: Sequence[float]) -> tuple[list[int], np.ndarray]:
        """The cells by their centroid's cosine, and for each cell a score that none of its vectors exceeds."""
        q = np.array(query) / (np.linalg.norm(query) or 1)
        near = self.centroids @ q
        angle = np.arccos(np.clip(near, -1, 1))
        bound = (1 + np.cos(np.maximum(0, angle - self.radius))) / 2 + 1e-6  # for rounding
        return [int(c) for c in np.argsort(-near, kind="stable")], bound

    def read(self, cells: Sequence[int]) -> DataFrame:
        return self.lists.where(F.col("cell").isin(*cells)).select("id", "vector")

    def search_batch(self, queries: DataFrame, k: int, probes: int = config.VectorConfig.probes, block: int = 4096) -> DataFrame:
        """As search_batch() over all indexed vectors, reading cells: the probes nearest cells give each query k scores, and then those cells
        are read too whose bound reaches the last of them, so that no neighbour is lost. Two passes a block of queries, each over the cells that
        one of its queries wants."""
        out = None
        for rows in _query_blocks(queries, block):
            ids, asked = [r["query_id"] for r in rows], [r["vector"] or [] for r in rows]
            if any(len(q) != self.dimension for q in asked):
                raise ValidationError(f"the index has vectors of {self.dimension} numbers")
            near = [self.nearest(q) for q in asked]

            def found(cells: list[list[int]]) -> DataFrame:
                wanted = sorted({c for x in cells for c in x})
                own = self.lists.where(F.col("cell").isin(*wanted)).select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<double>").alias("vector"), "cell")
                return _top(own.mapInArrow(_best(ids, asked, k, cells), "query_id string, id string, score double"), k, queries.sparkSession)

            first = [cells[:probes] for cells, _ in near]
            last = {r["query_id"]: r["score"] for r in found(first).where(F.col("rank") == k).select("query_id", "score").collect()}  # a row a query
            more = [own + [c for c in cells[probes:] if bound[c] >= last.get(str(i), 0.0)] for i, own, (cells, bound) in zip(ids, first, near)]
            out = found(more) if out is None else out.unionByName(found(more))
        return out if out is not None else _top(None, k, queries.sparkSession)

    @staticmethod
    def open(spark: SparkSession, path: str) -> InvertedFile:
        """An index that was built before, without reading its vectors."""
        about = json.loads(Files(spark).read(f"{path}/index.json"))
        schema = "id string, vector array<float>, away double, cell int, salt int"
        return InvertedFile(about["name"], about["dimension"], about["size"], np.array(about["centroids"]).reshape(-1, about["dimension"]), spark.read.schema(schema).parquet(f"{path}/lists"), np.array(about["radius"]))


def build_index(view: GraphView, path: str, vector_name: str | None = None, settings: config.VectorConfig = config.VectorConfig(), seed: int = 3) -> InvertedFile:
    """Writes the lists to path, partitioned by cell, so that a search reads its cells only, and opens what it wrote. settings.sample vectors at
    most are fitted on the driver, to settings.lists cells, or to the square root of the vectors' number, if that is more (a third of the
    sample at most). A cell with more than CELL_ROWS vectors on average is written by several tasks. The dimension is that of most vectors;
    others are left to exact search."""
    vectors = space(view, vector_name).withColumn("n", F.size("vector"))
    sizes = vectors.groupBy("n").count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        raise ValidationError("there are no vectors to index")
    dimension, size = sizes["n"], sizes["count"]
    own = vectors.where(F.col("n") == dimension).select("id", "vector")
    share = min(1.0, settings.sample / size)
    rows = own.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < share * 1_000_003).orderBy("id").limit(settings.sample).collect()
    x = np.array([r["vector"] for r in rows], np.float64).reshape(-1, dimension)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    random = np.random.default_rng(seed)
    count = max(1, min(max(settings.lists, isqrt(size)), max(settings.lists, settings.sample // 3), len(x)))
    centers = x[random.permutation(len(x))[:count]]
    for _ in range(15):
        cell = np.argmax(x @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, cell, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centers)
    salts = -(-size // (len(centers) * CELL_ROWS))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, dimension)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            near = v @ centers.T
            away = np.arccos(np.clip(near.max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(away), pa.array(np.argmax(near, axis=1).astype(np.int32))], names=["id", "vector", "away", "cell"])

    placed = own.mapInArrow(assign, "id string, vector array<float>, away double, cell int")
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    placed.repartition("cell", "salt").write.mode("overwrite").partitionBy("cell", "salt").parquet(f"{path}/lists")
    radius = np.zeros(len(centers))
    for r in view.spark.read.parquet(f"{path}/lists").groupBy("cell").agg(F.max("away").alias("away")).collect():  # a row a cell
        radius[r["cell"]] = r["away"]
    about = {"name": vector_name or config.DEFAULT_VECTOR, "dimension": dimension, "size": size, "version": view.version, "centroids": centers.ravel().tolist(), "radius": radius.tolist()}
    files = Files(view.spark)
    if files.exists(f"{path}/index.json"):
        files.delete(f"{path}/index.json")
    files.write(f"{path}/index.json", json.dumps(about).encode())
    return InvertedFile.open(view.spark, path)


def recall(exact: DataFrame, approximate: DataFrame, k: int) -> DataFrame:
    """Two results of search_batch() -> queries, recall: the mean share of each query's k best that are found among its approximate k best."""
    at_k = lambda rows: rows.where(F.col("rank") <= k).select("query_id", "id")
    both = at_k(exact).join(at_k(approximate).withColumn("found", F.lit(1)), ["query_id", "id"], "left")
    each = both.groupBy("query_id").agg((F.coalesce(F.sum("found"), F.lit(0)) / F.count("*")).alias("share"))
    return each.agg(F.count("*").alias("queries"), F.avg("share").alias("recall"))


def quality(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Two results (id, score) -> overlap, jaccard, top1_match, only_exact, only_approximate."""
    tagged = exact.select("id", "score", F.lit(True).alias("exact")).unionByName(approximate.select("id", "score", F.lit(False).alias("exact")))
    own = lambda side: F.transform(F.sort_array(F.collect_list(F.when(side, F.struct((-F.col("score")).alias("s"), "id")))), lambda x: x["id"])
    both = tagged.agg(own(F.col("exact")).alias("a"), own(~F.col("exact")).alias("b"))  # two results of at most 1,000 rows
    shared = F.size(F.array_intersect("a", "b"))
    return both.select(
        (shared / F.greatest(F.size("a"), F.lit(1))).alias("overlap"), (shared / F.greatest(F.size(F.array_union("a", "b")), F.lit(1))).alias("jaccard"),
        (F.get("a", F.lit(0)) == F.get("b", F.lit(0))).alias("top1_match"), F.array_except("a", "b").alias("only_exact"), F.array_except("b", "a").alias("only_approximate"),
    )
