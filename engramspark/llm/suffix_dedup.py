"""Exact repeats of LEAST bytes and more, over all texts: maximal repeat groups from a sharded enhanced suffix array.

Every window of LEAST bytes is owned by one anchor, its leftmost smallest hash of K bytes. Windows in a row with one owner are
a chunk. Equal windows have owners with equal hashes at equal places, so all occurrences of a window lie in chunks of one
anchor hash: the shards of the suffix array are divided by it. Equal chunks are one from the start; only anchors with
different chunks need the suffix array.

An anchor with more than GROUP different chunks is divided by longer strings: its windows, by where the anchor stands in them,
into stretches of 20, 5 and at last 1, each with the string that all windows of the stretch hold. Equal windows still meet,
equal stretches are one again, and a stretch whose string is in no other chunk is done."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import Scratch

LEAST, K = 100, 24
#: Different chunks in one group of the suffix array; larger groups are divided by longer strings, never cut short.
GROUP = 512
#: Places of the anchor that a divided group's windows share a string for; with 1, the string is the window.
WIDTHS = (20, 5, 1)
#: Bytes of text in which anchors are looked for at once; longer texts are taken in pieces that overlap by a window.
BLOCK = 1 << 18
#: Chunks in one suffix array, unless a group has more.
SHARD = 2000


def stretches(raw: np.ndarray, offs: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, byte of its text that the piece begins at, bytes, offsets) of groups of whole texts, or of pieces of one longer text;
    each window of LEAST bytes is in one of them. Which anchor owns a window depends on its own bytes alone."""
    limit = limit or BLOCK
    for lo, hi, part, own in W.blocks(raw, offs, limit):
        if hi - lo > 1 or len(part) <= limit + LEAST:
            yield lo, 0, part, own
        else:
            for begin in range(0, len(part) - LEAST + 1, limit):
                piece = part[begin : begin + limit + LEAST - 1]
                yield lo, begin, piece, np.array([0, len(piece)])


def anchors(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, anchor, its place) of all chunks; starts, ends and places in raw."""
    none = np.zeros(0, np.int64)
    if len(raw) < LEAST:
        return none, none, none, none.view(W.U64), none
    h = W.BYTE[raw]
    by_size = {1: h}
    for size in (1, 2, 4, 8):
        h = h[: len(h) - size] * W.GRAM[size] + h[size:]
        by_size[2 * size] = h
    h = by_size[16][: len(raw) - K + 1] * W.GRAM[40] + by_size[8][16 : 16 + len(raw) - K + 1]
    h = W.mix(h)
    high = W.U64(0xFFFFFFFF00000000)
    low = (h & high) | np.arange(len(h), dtype=W.U64)
    span, width = LEAST - K + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (span - width)], low[span - width :]) if span > width else low
    ends = np.repeat(offs[1:], np.diff(offs))[: len(low)]
    valid = np.flatnonzero(np.arange(len(low)) + LEAST <= ends)
    if not len(valid):
        return none, none, none, none.view(W.U64), none
    owner = (low[valid] & W.U64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    starts, lasts = valid[first], valid[np.append(first[1:], len(valid)) - 1]
    return np.searchsorted(offs, starts, side="right") - 1, starts, lasts + LEAST, h[owner[first]], owner[first]


@W.frugal
def _anchors_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's distinct anchors and how many chunks have them."""
    for batch in batches:
        raw, offs = W.utf8(batch.column(1))
        for _, _, part, own in stretches(raw, offs):
            found, n = np.unique(anchors(part, own)[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["anchor", "n"])


def merged(group: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of spans within each group, as (group, start, end); spans come by group and start."""
    if not len(starts):
        return group, starts, ends
    wide = int(ends.max()) + 1
    number = np.cumsum(np.concatenate([[False], group[1:] != group[:-1]]))
    reach = np.maximum.accumulate(ends + number * wide) - number * wide
    first = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (starts[1:] > reach[:-1])]))
    return group[first], starts[first], reach[np.append(first[1:], len(starts)) - 1]


@W.frugal
def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each different chunk of a text (of a piece, where it is taken in pieces); later holds the union of its further
    occurrences there, as start, end, start, end: a periodic text has few rows."""
    for batch in batches:
        raw, offs = W.utf8(batch.column(1))
        for lo, begin, part, own in stretches(raw, offs):
            text, starts, ends, anchor, _ = anchors(part, own)
            if not len(text):
                continue
            chunk = W.span_hashes(part, starts, ends)
            _, at, which = np.unique(W.mix(chunk + text.astype(W.U64) * W.GRAM[50]), return_index=True, return_inverse=True)
            starts, ends = starts - own[text] + begin, ends - own[text] + begin
            repeats = np.flatnonzero(np.arange(len(text)) != at[which])
            repeats = repeats[np.argsort(which[repeats], kind="stable")]
            group, later_from, later_to = merged(which[repeats], starts[repeats], ends[repeats])
            sizes = 2 * np.bincount(group, minlength=len(at))
            pairs = np.stack([later_from, later_to], axis=1).ravel().astype(np.int32)
            later = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(pairs))
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[at].view(np.int64)), pa.array(chunk[at].view(np.int64)), batch.column(0).take(pa.array(lo + text[at])), pa.array(starts[at].astype(np.int32)), pa.array(ends[at].astype(np.int32)), later],
                names=["anchor", "chunk", "doc_id", "start", "end", "later"],
            )


@W.frugal
def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts are compressed before they are shuffled."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        raw, offs = W.utf8(batch.column(1))
        packed = [squeeze.compress(raw[offs[i] : offs[i + 1]].tobytes()) for i in range(len(batch))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc_id", "packed"])


@W.frugal
def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the chunks that a text was asked for."""
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        rows: list[list] = [[], [], [], [], []]
        for doc, packed, wanted in zip(*(batch.column(i).to_pylist() for i in range(3))):
            text = expand.decompress(packed)
            for w in wanted:
                for column, value in zip(rows, (w["anchor"], w["hot"], doc, w["start"], text[w["start"] : w["end"]])):
                    column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.bool_()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int32()), pa.array(rows[4], pa.binary())],
            names=["anchor", "hot", "doc_id", "start", "bytes"],
        )


def divided(raw: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(chunk, start, end, key) of the stretches of all chunks: windows that hold the anchor at places of one block of width
    places. key is a hash of that block's number and of the string that all such windows hold."""
    chunk, _, ends, _, place = anchors(raw, offs)
    begins = offs[chunk]
    low, high = np.maximum(0, place - (ends - LEAST)) // width, (place - begins) // width
    n = high - low + 1
    row = np.repeat(np.arange(len(chunk)), n)
    block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[row]
    at = place[row] - block * width
    starts = np.maximum(begins[row], at - width + 1)
    stops = np.minimum(ends[row] - LEAST, at) + LEAST
    key = W.mix(W.span_hashes(raw, at, at + LEAST + 1 - width) + (block + 1).astype(W.U64) * W.GRAM[51])
    return chunk[row], starts, stops, key


def _divide(width: int):
    """Rows (doc_id, start, bytes) -> one for each stretch: anchor (the key), chunk (a hash of its bytes), doc_id, start, bytes."""

    @W.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = W.utf8(batch.column(2))
            chunk, starts, ends, key = divided(raw, offs, width)
            sizes = ends - starts
            at = np.concatenate([[0], np.cumsum(sizes)])
            data = raw[np.arange(at[-1]) + np.repeat(starts - at[:-1], sizes)]
            own = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
            first = batch.column(1).to_numpy(zero_copy_only=False)[chunk] + starts - offs[chunk]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(W.span_hashes(raw, starts, ends).view(np.int64)), batch.column(0).take(pa.array(chunk)), pa.array(first.astype(np.int32)), own],
                names=["anchor", "chunk", "doc_id", "start", "bytes"],
            )

    return run


def suffix_array(chunks: list[bytes], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Enhanced suffix array of the suffixes of at least least bytes of all chunks: (chunk, place in it, left, lcp), in
    the order of the suffixes. left is the byte before a suffix, negative and different for each chunk's first; lcp is the common prefix with the suffix before."""
    raw = np.frombuffer(b"".join(chunks), np.uint8)
    sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
    begins = np.cumsum(sizes) - sizes
    count = np.maximum(0, sizes - least + 1)
    chunk = np.repeat(np.arange(len(chunks)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    width = int(sizes.max())
    padded = np.concatenate([raw, np.zeros(width, np.uint8)])
    at = begins[chunk] + place
    table = np.lib.stride_tricks.sliding_window_view(padded, width)[at]
    left_over = sizes[chunk] - place
    table[np.arange(width)[None, :] >= left_over[:, None]] = 0
    order = np.argsort(table.view(f"S{width}").ravel(), kind="stable")
    table, left_over = table[order], left_over[order]
    lcp = np.zeros(len(order), np.int64)
    if len(order) > 1:
        differs = table[1:] != table[:-1]
        common = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        lcp[1:] = np.minimum(common, np.minimum(left_over[1:], left_over[:-1]))
    left = np.where(place > 0, padded[np.maximum(at - 1, 0)].astype(np.int64), -1 - chunk)
    return chunk[order], place[order], left[order], lcp


def maximal_repeats(left: np.ndarray, lcp: np.ndarray, least: int = LEAST) -> Iterator[tuple[int, int, int]]:
    """(first rank, rank after the last, length) of the groups of suffixes that have a prefix of length >= least in common,
    which none of their neighbours shares and no equal byte on the left extends: a scan of the array with a stack, whose
    entries are the common-prefix intervals that are still open."""
    ends = np.flatnonzero(lcp < least)
    for lo, hi in zip(ends, np.append(ends[1:], len(lcp))):
        if hi - lo < 2:
            continue
        if hi - lo == 2:
            if left[lo] != left[lo + 1] or left[lo] < 0:
                yield lo, hi, int(lcp[lo + 1])
            continue
        stack: list[tuple[int, int]] = []  # (length, first rank)
        for i in range(lo + 1, hi + 1):
            now, first = int(lcp[i]) if i < hi else 0, i - 1
            while stack and stack[-1][0] > now:
                length, first = stack.pop()
                own = left[first:i]
                if own[0] < 0 or (own != own[0]).any():
                    yield first, i, length
            if now >= least and (not stack or stack[-1][0] < now):
                stack.append((now, first))


def covered(docs: np.ndarray, starts: np.ndarray, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunk, start, end) of what each chunk's own repeat groups remove from it: all occurrences but the first (least text, least start) of each
    group. Of the groups that a suffix is in the longest counts; what overlaps in a chunk is one span."""
    chunk, place, left, lcp = suffix_array(chunks)
    doc, start = docs[chunk], starts[chunk] + place
    rank = np.empty(len(chunk), np.int64)
    rank[np.lexsort((start, doc))] = np.arange(len(chunk))
    reach = np.zeros(len(chunk), np.int64)
    for lo, hi, length in maximal_repeats(left, lcp):
        own = reach[lo:hi]
        first = int(rank[lo:hi].argmin())
        before = own[first]
        np.maximum(own, length, out=own)
        own[first] = before
    some = np.flatnonzero(reach)
    some = some[np.lexsort((place[some], chunk[some]))]
    return merged(chunk[some], place[some], place[some] + reach[some])


@W.frugal
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, doc_id, start, bytes), sorted by anchor -> spans to remove."""
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        docs, starts = np.array([x[1] for x in held], np.int64), np.array([x[2] for x in held], np.int64)
        chunk, lo, hi = covered(docs, starts, [x[3] for x in held])
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(docs[chunk]), pa.array((starts[chunk] + lo).astype(np.int32)), pa.array((starts[chunk] + hi).astype(np.int32))], names=["doc_id", "start", "end"])

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if len(held) >= SHARD and row[0] != held[-1][0]:
                yield flush()
            held.append(row)
    if held:
        yield flush()


@W.frugal
def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        rows: list[list] = [[], [], [], [], []]
        for doc, packed, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
            text, merged = expand.decompress(packed), []
            for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([start, end])
            kept, done = [], 0
            for start, end in merged:
                kept.append(text[done:start])
                done = end
            kept = b"".join([*kept, text[done:]])
            for column, value in zip(rows, (doc, len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest())):
                column.append(value)
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in rows[:4]), pa.array(rows[4], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs (doc_id, text), ids distinct and not null -> doc_id, start, end: byte spans that cover exactly the bytes in a
    window of LEAST bytes which also starts earlier (smaller doc_id, or same text and earlier start). Spans may overlap."""
    seen = docs.mapInArrow(_anchors_only, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")
    seen = scratch.cut(seen, "repeated-anchors")
    chunks = docs.mapInArrow(_chunks, "anchor long, chunk long, doc_id long, start int, end int, later array<int>")
    chunks = scratch.cut(chunks.join(seen, "anchor"), "chunks")
    scratch.drop("repeated-anchors")
    first = chunks.groupBy("anchor", "chunk").agg(F.min(F.struct("doc_id", "start", "end")).alias("first"), F.count("*").alias("copies"))
    first = scratch.cut(first, "first")
    spans = [chunks.join(first.filter("copies > 1"), ["anchor", "chunk"]).filter("doc_id <> first.doc_id or start <> first.start").select("doc_id", "start", "end")]
    pairs = F.explode(F.expr("sequence(0, size(later) - 2, 2)")).alias("i")
    spans.append(chunks.filter("size(later) > 0").select("doc_id", "later", pairs).selectExpr("doc_id", "later[i] start", "later[i + 1] end"))
    several = scratch.cut(first.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").selectExpr("anchor", f"n > {GROUP} hot"), "several")
    wanted = first.join(several, "anchor").select("anchor", "hot", "first.doc_id", "first.start", "first.end")
    wanted = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "hot", "start", "end")).alias("wanted"))  # no more than a text has bytes
    wanted = scratch.cut(wanted, "wanted")
    texts = docs.mapInArrow(_compress, "doc_id long, packed binary").join(wanted, "doc_id").select("doc_id", "packed", "wanted")
    fetched = scratch.cut(texts.mapInArrow(_fetch, "anchor long, hot boolean, doc_id long, start int, bytes binary"), "fetched")
    scratch.drop("wanted")

    small, hot = fetched.filter("not hot"), fetched.filter("hot")
    for width in WIDTHS if not hot.isEmpty() else ():
        parts = hot.select("doc_id", "start", "bytes").mapInArrow(_divide(width), "anchor long, chunk long, doc_id long, start int, bytes binary")
        parts = scratch.cut(parts, f"parts-{width}")
        first = parts.groupBy("anchor", "chunk").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("copies"))
        first = scratch.cut(first, f"first-{width}")
        later = parts.join(first.filter("copies > 1"), ["anchor", "chunk"]).filter("doc_id <> first.doc_id or start <> first.start")
        spans.append(later.selectExpr("doc_id", "start", "cast(start + length(bytes) as int) end"))
        several = first.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").selectExpr("anchor", f"n > {GROUP} hot")
        several = first.join(several, "anchor").selectExpr("anchor", "chunk", "hot", "first.doc_id", "first.start")
        still = scratch.cut(parts.join(several, ["anchor", "chunk", "doc_id", "start"], "inner").select("anchor", "hot", "doc_id", "start", "bytes"), f"still-{width}")
        small, hot = small.unionByName(still.filter("not hot")), still.filter("hot")
        if hot.isEmpty():  # with a width of 1 a string is a window, so there is one chunk a string
            break
    found = small.repartition("anchor").sortWithinPartitions("anchor").select("anchor", "doc_id", "start", "bytes")
    found = scratch.cut(found.mapInArrow(_scan, "doc_id long, start int, end int"), "found")
    for more in spans:
        found = found.unionByName(more)
    return found


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row for each row of docs.

    Texts are UTF-8 bytes; null is empty. Each byte goes that a string of LEAST bytes covers which also starts earlier, in a smaller doc_id or
    earlier in the same text; overlaps count and the input alone is judged. n_spans counts the maximal runs that go;
    kept_sha256 is the digest of the rest. Shorter texts stay whole. Null doc_id: no order, so the row stays whole and
    removes nothing. Where a doc_id repeats, its text with the smallest hash is judged, for all its rows with that text;
    rows with other texts stay whole. Empty table: no rows. Other columns are ignored."""
    scratch = Scratch(docs.sparkSession)
    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    repeated = two.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.xxhash64("text")).alias("own")).filter("n > 1")
    repeated = scratch.cut(repeated, "repeated")
    known, rest = two.filter("doc_id is not null"), two.filter("doc_id is null")
    judged = known
    if not repeated.isEmpty():
        marked = known.join(repeated, "doc_id", "left").withColumn("own", F.col("own").isNull() | (F.col("own") == F.xxhash64("text")))
        marked = scratch.cut(marked.select("doc_id", "text", "own"), "marked")
        known, rest = marked.filter("own").select("doc_id", "text"), rest.unionByName(marked.filter("not own").select("doc_id", "text"))
        judged = known.dropDuplicates(["doc_id"])
    spans = repeated_spans(judged, scratch).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    none = F.lit(None).cast("array<struct<start:int,end:int>>")
    packed = known.mapInArrow(_compress, "doc_id long, packed binary").join(scratch.cut(spans, "spans"), "doc_id", "left").select("doc_id", "packed", "spans")
    packed = packed.unionByName(rest.mapInArrow(_compress, "doc_id long, packed binary").withColumn("spans", none))
    return packed.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
