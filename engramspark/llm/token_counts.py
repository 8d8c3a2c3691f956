"""Token counts of sections: each text is encoded once, and its tokens' spans are joined to the sections' spans."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from . import words as W
from .scratch import ship


def attribute(bounds: np.ndarray, ends: np.ndarray, section_starts: np.ndarray, size: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Interval join of tokens (token i covers bytes bounds[i] to ends[i]) to the sections that divide 0..size:
    the section of each token, and whether the token lies in several."""
    section_ends = np.append(section_starts[1:], size)
    first = np.searchsorted(section_starts, bounds, side="right") - 1
    last = np.searchsorted(section_starts, ends - 1, side="right") - 1
    crossing = first != last
    chosen = first.copy()
    if rule == "most":
        for i in np.flatnonzero(crossing):
            own = np.arange(first[i], last[i] + 1)
            overlap = np.minimum(section_ends[own], ends[i]) - np.maximum(section_starts[own], bounds[i])
            chosen[i] = own[int(np.argmax(overlap))]
    elif rule == "last":
        chosen = last
    elif rule != "first":
        raise ValueError(f"rule must be first, last or most: {rule}")
    return chosen, crossing


NAMES = ["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing"]


def _counted(raw: np.ndarray, offs: np.ndarray, ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray, of: np.ndarray, rule: str) -> list[np.ndarray]:
    """The cells of NAMES from char_start on, for sections that begin at starts, ascending, of the texts of; the texts of a block are one
    long text whose sections never cross a text's end."""
    ends = np.cumsum(sizes[ids])
    chosen, crossing = attribute(ends - sizes[ids], ends, starts, len(raw), rule) if len(ids) else (np.zeros(0, int), np.zeros(0, bool))
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    base = points[offs[of]]
    counts = [np.bincount(x, minlength=len(starts)) for x in (chosen, chosen[crossing])]
    return [points[starts] - base, points[np.append(starts[1:], len(raw))] - base, *counts]


def _lines(path: str, rule: str, mark: int):
    @W.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = bpe.encoder(path).sizes
        for batch in batches:
            for lo, hi, raw, offs, ids, id_offs in bpe.encode_column(batch.column(1), path):
                starts = np.flatnonzero(raw == mark) + 1
                starts = np.unique(np.concatenate([starts[starts < len(raw)], offs[:-1][offs[:-1] < len(raw)]]))
                of = np.searchsorted(offs, starts, side="right") - 1
                empty = np.flatnonzero(np.diff(offs) == 0)
                none = np.zeros(len(empty), np.int64)
                cells = [np.arange(len(starts)) - np.searchsorted(starts, offs[of]), *_counted(raw, offs, ids, sizes, starts, of, rule)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(lo + np.concatenate([of, empty]))), *(pa.array(np.concatenate([x, none]).astype(np.int64)) for x in cells)], names=NAMES
                )

    return run


def _fields(path: str, rule: str, n: int):
    """Rows (doc_id, text, sizes): sizes are the bytes of the n fields that the text is made of."""

    @W.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = bpe.encoder(path).sizes
        for batch in batches:
            widths = np.array(batch.column(2).to_pylist(), np.int64).reshape(-1, n)
            for lo, hi, raw, offs, ids, id_offs in bpe.encode_column(batch.column(1), path):
                own = widths[lo:hi]
                starts = (offs[:-1, None] + np.cumsum(own, axis=1) - own).ravel()
                of, number = np.divmod(np.arange(len(starts)), n)
                cells = [number, *_counted(raw, offs, ids, sizes, starts, of, rule)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + of)), *(pa.array(x.astype(np.int64)) for x in cells)], names=NAMES)

    return run


def section_tokens(docs: DataFrame, path: str | None = None, rule: str = "most", mark: str = "\n") -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, section, char_start, char_end, n_tokens, n_crossing: a row a section.

    A section ends after each mark (one ASCII character), which belongs to it. The whole text is encoded once, and each token has the bytes that it stands for; a token
    that lies in several sections counts for one: with rule "most", that with most of its bytes (the first of equals),
    with "first" and "last", that with its first or last byte. So the counts of a text's sections add up to its tokens. n_crossing
    says how many of a section's tokens reach beyond it. Spans are in code points, end exclusive. Null or empty text: one
    section 0 from 0 to 0 without tokens. Null doc_id and repeated rows are carried. Empty table: no rows. Other columns
    are ignored. No shuffle."""
    ship(docs.sparkSession)
    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return two.mapInArrow(_lines(path or bpe.default_vocabulary(), rule, ord(mark)), "doc_id long, section long, char_start long, char_end long, n_tokens long, n_crossing long")


def field_tokens(docs: DataFrame, fields: Sequence[str], path: str | None = None, rule: str = "most", mark: str = "\n") -> DataFrame:
    """docs (doc_id, the fields, ...) -> doc_id, field, char_start, char_end, n_tokens, n_crossing: a row for each row of docs and field.

    The document is the fields' texts in their order, with mark after each but the last; it is encoded once, as training sees it, and its tokens are
    attributed as in section_tokens(); a mark belongs to the field before it. A null field is empty; an empty field has its place and at
    most the token of its mark. Null doc_id and repeated rows are carried. Empty table: no rows. Other columns are ignored. No shuffle."""
    ship(docs.sparkSession)
    fields = list(fields)
    if not fields:
        raise ValueError("there are no fields")
    parts = [F.concat(F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")), F.lit(mark if i < len(fields) - 1 else "")) for i, f in enumerate(fields)]
    three = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(*parts).alias("text"), F.array(*map(F.octet_length, parts)).alias("sizes"))
    counted = three.mapInArrow(_fields(path or bpe.default_vocabulary(), rule, len(fields)), "doc_id long, section long, char_start long, char_end long, n_tokens long, n_crossing long")
    named = F.element_at(F.array(*map(F.lit, fields)), (F.col("section") + 1).cast("int")).alias("field")
    return counted.select("doc_id", named, *NAMES[2:])
