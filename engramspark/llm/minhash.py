"""MinHash near-duplicates: banded candidates, sequential Bayesian pruning of signatures, exact check of survivors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .scratch import Scratch

BANDS, ROWS, CHECKED, BATCH = 40, 5, 200, 40
#: Classes of one key that are compared at a time, and the shingles they have together; more are divided by size, so that only sets of
#: sizes that can be similar meet, and within a size dealt out as pairs of blocks.
BLOCK, BLOCK_SHINGLES = 1000, 1_000_000


@lru_cache(None)
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(77003)
    return random.integers(0, 2**64, n, dtype=W.U64), random.integers(0, 2**64, n, dtype=W.U64) | W.U64(1)


def signatures(sets: np.ndarray, offs: np.ndarray, n: int) -> np.ndarray:
    """n minimum hashes (upper 32 bits) of each set; sets must not be empty."""
    flip, factor = _permutations(n)
    out = np.empty((len(offs) - 1, n), np.uint32)
    for k in range(n):
        out[:, k] = np.minimum.reduceat((sets ^ flip[k]) * factor[k], offs[:-1]) >> W.U64(32)
    return out


def set_keys(sets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for a whole set, in two halves."""
    sums = (np.add.reduceat(W.mix(x), starts).view(np.int64) for x in (sets ^ W.U64(0x5851F42D4C957F2D), sets + W.U64(0x14057B7EF767814F)))
    return next(sums), next(sums)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig[:, : bands * rows].reshape(len(sig), bands, rows).astype(W.U64)
    total = (parts * W.GRAM[:rows]).sum(axis=2, dtype=W.U64) + W.GRAM[rows : rows + 1] * np.arange(1, bands + 1, dtype=W.U64)
    return W.mix(total).view(np.int64)


def _sign(bands: int, rows: int, n: int):
    @W.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = W.utf8(batch.column(1))
            for lo, hi, part, own in W.blocks(raw, offs):
                _, _, hashes, word_offs = W.words(part, own)
                grams, _, gram_offs = W.shingles(hashes, word_offs, n)
                sets, set_offs = W.distinct(grams, gram_offs)
                sizes = np.diff(set_offs)
                full = np.flatnonzero(sizes)
                k1, k2 = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                sigs, keys = [None] * (hi - lo), [None] * (hi - lo)
                if len(full):
                    starts = set_offs[full]
                    k1[full], k2[full] = set_keys(sets, starts)
                    sig = signatures(sets, np.append(starts, len(sets)), max(bands * rows, CHECKED))
                    own_keys, short = band_keys(sig, bands, rows), sig[:, :CHECKED].astype(np.uint16)
                    for j, i in enumerate(full):
                        sigs[i], keys[i] = short[j].tobytes(), own_keys[j]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sizes), pa.array(k1), pa.array(k2), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "k1", "k2", "sig", "bands"],
                )

    return run


def _sets(n: int):
    @W.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = W.utf8(batch.column(1))
            for lo, hi, part, own in W.blocks(raw, offs):
                _, _, hashes, word_offs = W.words(part, own)
                grams, _, gram_offs = W.shingles(hashes, word_offs, n)
                sets, set_offs = W.distinct(grams, gram_offs)
                k1, k2, full = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64), np.flatnonzero(np.diff(set_offs))
                if len(full):
                    k1[full], k2[full] = set_keys(sets, set_offs[full])
                lists = pa.ListArray.from_arrays(pa.array(set_offs.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(k1), pa.array(k2), lists], names=["doc_id", "k1", "k2", "shingles"])

    return run


@lru_cache(None)
def least_matches(threshold: float, miss: float, batch: int = BATCH, total: int = CHECKED) -> tuple[int, ...]:
    """For each prefix of batch, 2 * batch, ... hashes, the fewest equal ones for which P(similarity >= threshold) is
    still at least miss, under a uniform prior: the posterior is Beta(1 + equal, 1 + unequal)."""
    grid = (np.arange(200_000) + 0.5) / 200_000
    out = []
    for n in range(batch, total + 1, batch):
        for m in range(n + 1):
            log = lgamma(n + 2) - lgamma(m + 1) - lgamma(n - m + 1) + m * np.log(grid) + (n - m) * np.log1p(-grid)
            if np.exp(log[grid >= threshold]).sum() / len(grid) >= miss:
                out.append(m)
                break
    return tuple(out)


def _prune(bounds: tuple[int, ...]):
    @W.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(n, CHECKED) for i in (2, 3))
            alive, equal = np.arange(n), np.zeros(n, np.int64)
            for j, least in enumerate(bounds):
                part = slice(j * BATCH, (j + 1) * BATCH)
                equal[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
                alive = alive[equal[alive] >= least]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive))], names=["a", "b"])

    return run


def _across(bounds: tuple[int, ...], percent: int):
    """Rows (key, low, high, block, rep, label, sig, shingles), sorted by the first three -> links between different labels,
    one class from each block. A class is compared with those of other labels by signature in batches, with the survivors by
    whole sets; a link joins its two labels. So the links are a spanning forest of all that there are."""

    def one_side(rows: list[tuple]) -> tuple[np.ndarray, ...]:
        sizes = np.array([len(r[7]) for r in rows])
        return np.array([r[4] for r in rows]), np.array([r[5] for r in rows]), np.frombuffer(b"".join(r[6] for r in rows), np.uint16).reshape(-1, CHECKED), sizes, np.cumsum(sizes) - sizes

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        low, high = rows[0][1:3]
        left, right = ([r for r in rows if r[3] == x] for x in (low, high))
        if not left or not right:
            return []
        vocabulary, ids = np.unique(np.concatenate([r[7] for r in rows]), return_inverse=True)
        at = np.cumsum([0, *(len(r[7]) for r in rows)])
        own = {id(r): ids[at[i] : at[i + 1]] for i, r in enumerate(rows)}
        reps, labels, sigs, sizes, starts = one_side(right)
        flat, mine, out = np.concatenate([own[id(r)] for r in right]), np.zeros(len(vocabulary), bool), []
        lefts = np.array([r[5] for r in left])
        for i, row in enumerate(left):
            # within one block both sides are the same rows, whose labels are joined together
            alive = np.flatnonzero(labels != lefts[i])
            if low == high:
                alive = alive[alive > i]
            alive = alive[100 * np.minimum(sizes[alive], len(row[7])) >= percent * np.maximum(sizes[alive], len(row[7]))]
            sig, equal = np.frombuffer(row[6], np.uint16), np.zeros(len(alive), np.int64)
            for j, least in enumerate(bounds):
                if not len(alive):
                    break
                part = slice(j * BATCH, (j + 1) * BATCH)
                equal += (sigs[alive, part] == sig[part]).sum(axis=1)
                keep = equal >= least
                alive, equal = alive[keep], equal[keep]
            if not len(alive):
                continue
            mine[own[id(row)]] = True
            n = sizes[alive]
            ends = np.cumsum(n)
            both = np.add.reduceat(mine[flat[np.arange(ends[-1]) + np.repeat(starts[alive] - ends + n, n)]].astype(np.int64), ends - n)
            mine[own[id(row)]] = False
            linked = alive[100 * both >= percent * (n + len(row[7]) - both)]
            for label in np.unique(labels[linked]):
                partner, kept = int(reps[linked[labels[linked] == label][0]]), lefts[i]
                out.append((min(row[4], partner), max(row[4], partner)))
                lefts[lefts == label] = kept
                linked = linked[labels[linked] != label]
                labels[labels == label] = kept
        return out

    @W.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            lists = batch.column(7)
            values, offs = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for i, row in enumerate(zip(*(batch.column(i).to_pylist() for i in range(7)))):
                if group and row[:3] != group[-1][:3]:
                    yield batch_of(links(group))
                    group = []
                group.append((*row, values[offs[i] : offs[i + 1]]))
        if group:
            yield batch_of(links(group))

    return run


def _size_class(n: Column, percent: int) -> Column:
    """Sets whose sizes differ by no more than the similarity allows are in one class or in neighbouring ones; a little wider for rounding."""
    return F.floor(F.log(n.cast("double")) / max(0.01, 1.001 * log(100 / percent))).cast("long")


def _blocks() -> Column:
    return F.ceil(F.greatest(F.col("size") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("long").alias("blocks")


def _dealt(labelled: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """labelled (key, rep, n_shingles, label) -> key, low, high, block, rep, label: the classes of each key that several labels share, for each
    pair of blocks they are to be compared in. A key that fits into one block is one; of the others each class meets the blocks
    of its own size class and of the two beside it."""
    summed = (F.count("*").alias("size"), F.sum("n_shingles").alias("total"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("one"), F.max("label").alias("other"), *summed).filter("one <> other")
    mixed = scratch.cut(mixed.select("key", _blocks()), "mixed")
    zero = F.lit(0).cast("long")
    small = labelled.join(mixed.filter("blocks = 1").select("key"), "key")
    small = small.select("key", zero.alias("low"), zero.alias("high"), zero.alias("block"), "rep", "label")
    large = mixed.filter("blocks > 1").select("key")
    if large.isEmpty():
        return small
    sized = labelled.join(large, "key").withColumn("class", _size_class(F.col("n_shingles"), percent))
    classes = scratch.cut(sized.groupBy("key", "class").agg(*summed).select("key", "class", _blocks()), "size-classes")
    own = scratch.cut(sized.join(classes, ["key", "class"]).withColumn("own", F.pmod(F.xxhash64("rep"), "blocks")), "sized")
    number = lambda of, block: of * (1 << 32) + block
    out = small
    for step in (-1, 0, 1):
        other = classes.select("key", (F.col("class") - step).alias("class"), F.col("blocks").alias("others"))
        met = own.join(other, ["key", "class"]).withColumn("with", F.explode(F.sequence(zero, F.col("others") - 1)))
        block, far = number(F.col("class"), F.col("own")), number(F.col("class") + step, F.col("with"))
        out = out.unionByName(met.select("key", F.least(block, far).alias("low"), F.greatest(block, far).alias("high"), block.alias("block"), "rep", "label"))
    return out


def near_duplicates(
    docs: DataFrame, percent: int = 75, n: int = 5, bands: int = BANDS, rows: int = ROWS, miss: float = 1e-6
) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id, kept; a row for each row of docs.

    A text's set has its distinct n-word shingles (A-Z lower-cased; all words if there are fewer than n). Texts with
    100 * shared >= percent * union are linked; a component's id is its smallest doc_id. Candidates share one of bands
    keys of rows minimum hashes: a pair at 0.75 is missed with probability (1 - 0.75 ** 5) ** 40 = 2e-5, one at 0.8
    with 2e-7. Batches of 40 hashes prune a candidate once P(similarity >= threshold) < miss; survivors are compared
    by their full sets.

    Equal sets are one class from the start. Of the rest, each class is first compared with the smallest class it
    shares a key with. Where a key's classes then still lie in several components, those of different components
    are compared block by block, by signature and then by whole sets; a link found joins two components, and classes known
    to be connected are not compared again. This loses no component; rows are made for one pair a class, then only for classes and links.

    Null or blank text: empty set, linked with nothing, its own component. Null doc_id: kept, component_id null, not
    linked. Rows that repeat a doc_id are judged each by its own text, so that with different texts they can be in different
    components. Empty table: no rows. Other columns are ignored."""
    scratch = Scratch(docs.sparkSession)
    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    signed = scratch.cut(
        two.mapInArrow(_sign(bands, rows, n), "doc_id long, n_shingles long, k1 long, k2 long, sig binary, bands array<long>"), "signed"
    )
    linkable = signed.filter("doc_id is not null and n_shingles > 0")
    several = linkable.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("own"), F.max(F.struct("k1", "k2")).alias("other")).filter("own <> other")
    several = scratch.cut(several.select("doc_id", "own"), "several")
    renamed = None
    if not several.isEmpty():
        # of an id's different texts all but one go by another number, until components are named
        texts = linkable.join(several, "doc_id").filter(F.struct("k1", "k2") != F.col("own")).select("doc_id", "k1", "k2").distinct()
        renamed = scratch.cut(texts.withColumn("number", F.xxhash64("doc_id", "k1", "k2")), "renamed")
        linkable = scratch.cut(_by_number(linkable, renamed).drop("id"), "linkable")
    classes = scratch.cut(
        linkable.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "classes"
    )
    keys = scratch.cut(classes.select("rep", "n_shingles", F.explode("bands").alias("key")), "keys")
    groups = scratch.cut(keys.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).filter("hub < last").drop("last"), "groups")
    shared = scratch.cut(keys.join(groups, "key"), "shared")
    scratch.drop("keys")

    involved = shared.select("rep").distinct().join(classes.select("rep", "k1", "k2"), "rep").withColumn("doc_id", F.col("rep"))
    if renamed is not None:
        real = renamed.select(F.col("number").alias("rep"), F.col("doc_id").alias("real"))
        involved = involved.join(real, "rep", "left").withColumn("doc_id", F.coalesce("real", "doc_id")).drop("real")
    sigs = classes.select(F.col("rep").alias("id"), "n_shingles", "sig")
    sets = two.join(involved, "doc_id", "left_semi").mapInArrow(_sets(n), "doc_id long, k1 long, k2 long, shingles array<long>")
    sets = scratch.cut(sets.join(involved, ["doc_id", "k1", "k2"]).dropDuplicates(["rep"]).select("rep", "shingles"), "sets")
    bounds = least_matches(percent / 100, miss)

    def verified(pairs: DataFrame, tag: str) -> DataFrame:
        left, right = (sigs.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sig").alias(f"s{x}")) for x in "ab")
        alive = pairs.join(left, "a").join(right, "b").filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        alive = scratch.cut(alive.select("a", "b", "sa", "sb").mapInArrow(_prune(bounds), "a long, b long"), f"{tag}-alive")
        left, right = (sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"t{x}")) for x in "ab")
        both = alive.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("ta", "tb")))
        return scratch.cut(both.filter(f"100 * shared >= {percent} * (size(ta) + size(tb) - shared)").select("a", "b"), f"{tag}-links")

    tested = shared.filter("hub < rep").groupBy(F.col("rep").alias("b")).agg(F.min("hub").alias("a")).select("a", "b")
    links = verified(tested, "first")
    # what a key's classes are still divided into: classes of different components are compared block by block, where
    # signatures and sets are at hand, so that no rows are made for pairs
    label = components(links, scratch, "first-components")
    labelled = scratch.cut(shared.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n_shingles", F.coalesce("label", "rep").alias("label")), "labelled")
    scratch.drop("shared")
    divided = _dealt(labelled, scratch, percent).join(classes.select("rep", "sig"), "rep").join(sets, "rep")
    divided = divided.select("key", "low", "high", "block", "rep", "label", "sig", "shingles")
    divided = divided.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    links = links.unionByName(scratch.cut(divided.mapInArrow(_across(bounds, percent), "a long, b long").distinct(), "across"))

    # rows of one class share its representative's component
    tied = components(links, scratch, "components").select(F.col("node").alias("rep"), "label")
    same = scratch.cut(linkable.select("doc_id", "k1", "k2", "n_shingles").join(classes.select("k1", "k2", "n_shingles", "rep"), ["k1", "k2", "n_shingles"]).select("doc_id", "rep").distinct(), "same")
    member = scratch.cut(same.join(tied, "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("found")), "member")
    if renamed is None:
        out = signed.select("doc_id", "n_shingles").join(member, "doc_id", "left").withColumn("component_id", F.coalesce("found", "doc_id"))
    else:
        out = _by_number(signed, renamed).select("id", "doc_id", "n_shingles").join(member, "doc_id", "left")
        out = scratch.cut(out.select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("found", "doc_id").alias("component")), "by-number")
        out = out.join(out.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component", "left")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _by_number(rows: DataFrame, renamed: DataFrame) -> DataFrame:
    """rows under the numbers that renamed has for some of their texts; id keeps the doc_id."""
    numbered = rows.withColumn("id", F.col("doc_id")).join(renamed, ["doc_id", "k1", "k2"], "left")
    return numbered.withColumn("doc_id", F.coalesce("number", "doc_id")).drop("number")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns; of rows that repeat a doc_id, one; rows without a doc_id all."""
    keep = near_duplicates(docs, **options).filter("kept and doc_id is not null").select(F.col("doc_id").alias("_kept")).distinct()
    staying = docs.join(keep, docs["doc_id"] == keep["_kept"], "left_semi").dropDuplicates(["doc_id"])
    return staying.unionByName(docs.filter("doc_id is null"))
