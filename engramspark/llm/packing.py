"""Best-fit packing planned on the histogram of lengths; pieces take planned slots by their rank within a length."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from . import words as W
from .scratch import Scratch

SIZE, END = 2048, 0


def _cut(path: str, size: int, with_ids: bool):
    @W.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _, ids, offs in bpe.encode_column(batch.column(1), path):
                rows: list[list] = [[], [], [], [], [], []]
                for i in range(hi - lo):
                    own = np.append(ids[offs[i] : offs[i + 1]], np.uint32(END)).astype("<u4")
                    first = len(own) if len(own) <= size else len(own) % size or size
                    start, number = 0, 0
                    while start < len(own):
                        part = own[start : first if not start else start + size]
                        for column, value in zip(rows, (lo + i, number, start, len(part), zlib.crc32(part.tobytes()), part.view(np.int32) if with_ids else None)):
                            column.append(value)
                        start, number = start + len(part), number + 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:5])] + ([pa.array(rows[5], pa.list_(pa.int32()))] if with_ids else []),
                    names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids,
                )

    return run


def plan(counts: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over {length: how many}. Returns runs (length, first rank, ranks, first sequence, offset),
    rank + k of a run going to its first sequence + k, and the number of sequences. Bins that are alike are one entry, so the work and the
    runs are bounded by size, whatever the counts."""
    runs: list[tuple[int, int, int, int, int]] = []
    open_bins: dict[int, list[tuple[int, int]]] = {}
    left: list[int] = []  # the residuals that some bins have, ascending
    bins = 0

    def put(residual: int, first: int, n: int) -> None:
        if n and residual:
            if residual not in open_bins:
                open_bins[residual] = []
                insort(left, residual)
            open_bins[residual].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            k = bisect_left(left, length)
            if k < len(left):
                residual = left[k]
                first, n = open_bins[residual].pop()
                if not open_bins[residual]:
                    del open_bins[residual]
                    left.pop(k)
            else:
                residual, first = size, bins
                n = -(-todo // (size // length))
                bins += n
            each = residual // length
            full = min(n, todo // each)
            for j in range(each if full else 0):
                runs.append((length, rank, full, first, size - residual + j * length))
                rank += full
            todo -= full * each
            put(residual - each * length, first, full)
            if full < n:  # the rest fits into one more bin
                for j in range(todo):
                    runs.append((length, rank, 1, first + full, size - residual + j * length))
                    rank += 1
                put(residual - todo * length, first + full, 1 if todo else 0)
                put(residual, first + full + (1 if todo else 0), n - full - (1 if todo else 0))
                todo = 0
    return runs, bins


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): a row a piece.

    A text is its token ids and then id 0; null text is empty and has the one id 0. Texts of more than size ids are cut into
    pieces of size ids, the first of which may be shorter. The driver gets one number for each length (size at most, whatever the
    corpus) and plans best-fit decreasing on lengths, in runs whose number depends on the lengths and not on how many documents have them (a few
    thousand for any counts tried, up to 1e8 a length). A piece's slot comes from its rank among its length, which is its rank
    within its salt and the counts of the salts before. A length that n pieces have is divided by about sqrt(n) salts, so that neither the largest task nor the table of salts
    grows with n itself. Repeated rows each get their own slot; null doc_id is carried. Empty table: no rows. Other columns are ignored."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    path = path or bpe.default_vocabulary()
    columns = "doc_id long, piece int, start long, length long, ids_crc32 long"
    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    pieces = scratch.cut(two.mapInArrow(_cut(path, size, False), columns), "pieces")
    # ids are made again where they are wanted, which costs less than a second copy of them on disk
    placing = two.mapInArrow(_cut(path, size, True), columns + ", ids array<int>") if with_ids else pieces

    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs, _ = plan(counts, size)
    # both tables are bounded by size, not by the corpus
    spread = spark.createDataFrame([(length, isqrt(n - 1) + 1) for length, n in counts.items()], "length long, salts long")
    slots = spark.createDataFrame(runs, "length long, rank_from long, n long, sequence_from long, offset long")
    salt = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), "salts")
    salted = lambda rows: rows.join(F.broadcast(spread), "length").withColumn("salt", salt).drop("salts")
    before = salted(pieces).groupBy("length", "salt").agg(F.count("*").alias("own"))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = scratch.cut(before.select("length", "salt", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("before")), "before")

    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted(placing).withColumn("own", F.row_number().over(order) - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own"))
    placed = ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_from") + F.col("n")))
    return placed.select("doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("sequence_from") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset", *["ids"] * with_ids)
