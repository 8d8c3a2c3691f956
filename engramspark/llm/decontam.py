"""Benchmark decontamination: n-gram seeds join texts to items; Smith-Waterman scores the passage around them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import Scratch

SEED, SCORE = 4, 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of items that go to the driver and the executors at once, as arrays of about 40 bytes a word; more items are
#: taken in blocks of this size.
BLOCK_WORDS = 500_000

#: Words are runs of ASCII letters and digits and of other scripts' letters and digits, in lower case; in scripts without spaces
#: (kana, ideographs, Thai, Lao, Khmer, Myanmar) each character is a word.
NO_WORD = np.zeros(256, dtype=bool)
NO_WORD[:128] = [not chr(c).isalnum() for c in range(128)]
_OTHER_MARKS = re.compile(r"[^\x00-\x7f\w]+")
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def folded(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts beyond ASCII in lower case, with blanks for their marks and around the characters that are words."""
    if not len(raw) or raw.max() < 0x80:
        return raw, offs
    out = []
    for i in range(len(offs) - 1):
        own = raw[offs[i] : offs[i + 1]]
        text = own.tobytes()
        if len(own) and (high := own.max()) >= 0x80:
            said = _OTHER_MARKS.sub(" ", text.decode().lower())
            text = (_UNSPACED.sub(r" \g<0> ", said) if high >= 0xE0 else said).encode()
        out.append(text)
    joined = np.frombuffer(b"".join(out), np.uint8)
    return joined, np.cumsum([0, *map(len, out)])


def hashed_words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and each text's n + 1 offsets into them."""
    _, _, hashes, word_offs = W.words(*folded(raw, offs), NO_WORD)
    return hashes, word_offs


@dataclass
class Items:
    ids: np.ndarray
    words: np.ndarray  # hashes of all items' words
    offs: np.ndarray
    grams: np.ndarray  # distinct, sorted
    gram_offs: np.ndarray  # where each gram's places are
    item: np.ndarray  # of each place
    word: np.ndarray

    @staticmethod
    def of(ids: list[int], texts: pa.Array | list[str]) -> Items:
        raw, offs = W.utf8(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
        hashes, word_offs = hashed_words(raw, offs)
        found, at, found_offs = W.shingles(hashes, word_offs, SEED)
        of = np.repeat(np.arange(len(ids)), np.diff(found_offs))
        grams, number = np.unique(found, return_inverse=True)
        order = np.argsort(number, kind="stable")
        gram_offs = np.searchsorted(number[order], np.arange(len(grams) + 1))
        return Items(np.array(ids, np.int64), hashes, word_offs, grams, gram_offs, of[order].astype(np.int32), (at - word_offs[of])[order].astype(np.int32))

    def hashes(self, item: int) -> np.ndarray:
        return self.words[self.offs[item] : self.offs[item + 1]]

    def places(self, gram: int) -> Iterator[tuple[int, int]]:
        own = slice(self.gram_offs[gram], self.gram_offs[gram + 1])
        return zip(self.item[own].tolist(), self.word[own].tolist())


def _hits(items: Items):
    grams = items.grams

    @W.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 24, bool)
        seen[grams >> W.U64(40)] = True
        for batch in batches:
            raw, offs = W.utf8(batch.column(1))
            for lo, hi, part, own in W.blocks(raw, offs):
                hashes, word_offs = hashed_words(part, own)
                found, at, gram_offs = W.shingles(hashes, word_offs, SEED)
                maybe = np.flatnonzero(seen[found >> W.U64(40)])
                number = np.searchsorted(grams, found[maybe])
                real = (number < len(grams)) & (grams[np.minimum(number, len(grams) - 1)] == found[maybe])
                maybe, number = maybe[real], number[real]
                if not len(maybe):
                    continue
                doc = np.searchsorted(gram_offs, maybe, side="right") - 1
                rows, starts = np.unique(doc, return_index=True)
                offsets = pa.array(np.append(starts, len(doc)).astype(np.int32))
                place = (at[maybe] - word_offs[doc]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(lo + rows)), batch.column(1).take(pa.array(lo + rows)), pa.ListArray.from_arrays(offsets, pa.array(number.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(place))],
                    names=["doc_id", "text", "grams", "places"],
                )

    return run


def smith_waterman(passage: np.ndarray, item: np.ndarray) -> int:
    """The best local alignment of two sequences of word hashes; a row of the table at a time, in which gaps along the row
    are a running maximum."""
    best, slope = 0, -GAP * np.arange(len(item) + 1)
    above = np.zeros(len(item) + 1, np.int64)
    for word in passage:
        row = np.maximum(above + GAP, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(item == word, MATCH, MISMATCH))
        above = np.maximum.accumulate(row + slope) - slope
        best = max(best, int(above.max()))
    return best


def reachable(passage: np.ndarray, item: np.ndarray, least: float) -> bool:
    """False only if no alignment scores least: that takes least * len(item) matches, of as many of the item's words, within as
    many of the passage's words as the gaps leave."""
    need = least * len(item)
    if np.isin(item, passage).sum() < need:
        return False
    span = len(item) + int(MATCH * len(item) * max(0.0, 1 - least) / -GAP)
    total = np.concatenate([[0], np.cumsum(np.isin(passage, item))])
    return bool((total[span:] - total[:-span]).max() >= need) if span < len(total) else True


def _score(items: Items, least: float):
    @W.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            raw, offs = W.utf8(batch.column(1))
            for i, (grams, at) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                wanted: dict[int, list[int]] = {}
                for gram, place in zip(grams, at):
                    for item, inside in items.places(gram):
                        wanted.setdefault(item, []).append(place - inside)
                own = raw[offs[i] : offs[i + 1]]
                hashes, _ = hashed_words(own, np.array([0, len(own)]))
                for item, begins in wanted.items():
                    target = items.hashes(item)
                    slack, windows = len(target) // 2 + 8, []
                    for begin in sorted(begins):
                        lo, hi = max(0, begin - slack), min(len(hashes), begin + len(target) + slack)
                        if windows and lo <= windows[-1][1]:
                            windows[-1][1] = max(windows[-1][1], hi)
                        else:
                            windows.append([lo, hi])
                    near = [hashes[lo:hi] for lo, hi in windows if reachable(hashes[lo:hi], target, least)]
                    score = max((smith_waterman(x, target) for x in near), default=0) / (MATCH * len(target))
                    if score >= least:
                        for column, value in zip(out, (i, int(items.ids[item]), score, len(begins))):
                            column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.int64())],
                names=["doc_id", "item_id", "score", "n_seeds"],
            )

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SCORE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs (doc_id, text, ...), benchmark (item_id, text, ...) -> doc_id, item_id, score, n_seeds: the pairs of at least the score least.

    Words are lower-cased runs of letters and digits, and single characters in scripts without spaces. Seeds are all of the items' n-grams of SEED words, however many texts hold
    them, so that no number of copies, edited or not, takes an item its seeds. Around each seed a window of twice the item's length is aligned (match 2, mismatch and gap -1), unless it has too few of the item's words for the score least;
    score is the best alignment over that of the item with itself: 1 for a copy, 0.7 with a fifth of the words replaced.

    The items are a query set: of more than block_words words they are taken in blocks, each against all texts. Null
    or empty texts and items are in no pair. An item of fewer than SEED words names no passage; it is in a pair, with score 1, with the texts that have its words in its order and no others. Null doc_id is carried; repeated rows
    give repeated pairs. An empty table on either side: no rows. Other columns are ignored."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    size = F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+|\p{So}"), F.lit(0)))  # an estimate; it only sizes the blocks
    parts = max(1, -(-(items.agg(F.sum(size)).first()[0] or 0) // block_words))
    found = None
    for part in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).distinct().orderBy("item_id", "text").toArrow()
        block = Items.of(rows.column("item_id").to_pylist(), rows.column("text").combine_chunks() if len(rows) else [])
        if not len(block.grams):
            continue
        hits = scratch.cut(two.mapInArrow(_hits(block), "doc_id long, text string, grams array<int>, places array<int>"), f"hits-{part}")
        pairs = hits.mapInArrow(_score(block, least), "doc_id long, item_id long, score double, n_seeds long")
        found = pairs if found is None else found.unionByName(pairs)
    return found if found is not None else spark.createDataFrame([], "doc_id long, item_id long, score double, n_seeds long")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, whose doc_id is in no contaminated pair; rows without a doc_id stay."""
    scratch = Scratch(docs.sparkSession)
    drop = scratch.cut(contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("_dropped")).filter("_dropped is not null").distinct(), "dropped")
    return docs.join(drop, docs["doc_id"] == drop["_dropped"], "left_anti")
