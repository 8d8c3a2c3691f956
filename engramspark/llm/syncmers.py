"""Document fingerprints of closed syncmers over words, in DataFrame functions alone."""

from __future__ import annotations

import json
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import ship

#: Units of an anchor, and of the substrings inside it whose least one must lie at an edge.
K, S = 5, 2
#: Characters of text that one window task orders, about, and windows at most (what the driver gets is a bound for each).
BUCKET_CHARS, MOST_BUCKETS = 64_000_000, 1 << 16
#: Runs of more characters than this have each character as a unit.
LONG_WORDS = 24
#: Scripts without spaces: Thai, Lao, Tibetan, Myanmar, Khmer, Tai, Balinese, Javanese, kana, ideographs.
UNSPACED = r"\u0E00-\u0FFF\u1000-\u109F\u1780-\u17FF\u1950-\u19FF\u1A20-\u1AAF\u1B00-\u1B7F\u2E80-\u312F\u3190-\u9FFF\uA980-\uA9FF\uAA60-\uAADF\uF900-\uFAFF\uFF66-\uFF9F\x{1AFF0}-\x{1B16F}\x{20000}-\x{3FFFF}"
_SPACE = r"\x20\x09-\x0D"
_WORD = f"[^{_SPACE}{UNSPACED}]"
UNIT = f"(?<!{_WORD}){_WORD}{{1,{LONG_WORDS}}}+(?!{_WORD})|[^{_SPACE}]"


def units(text: Column) -> Column:
    """Words (runs without white space), but characters in scripts without spaces and in runs of more than LONG_WORDS. A unit depends on
    its own run alone, whatever else the text holds."""
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def selected(hashes: Column, k: int = K, s: int = S) -> Column:
    """(at, anchor) of the closed syncmers in the order of the text: the k-mers of units of whose k - s + 1 inner s-mers the one with the least hash
    is the first or the last; at is the unit that they begin with. Whether a k-mer is chosen depends on it alone, so that equal passages choose equal k-mers wherever they stand. A text of
    fewer than k units, and one of which no k-mer is chosen, has itself; none without units."""
    n = F.size(hashes)
    inner = F.transform(hashes, lambda x, i: F.when(i <= n - s, F.xxhash64(F.slice(hashes, i + 1, s)))) if s > 1 else hashes

    def of(inner: Column) -> Column:
        def chosen(x: Column, i: Column) -> Column:
            low = F.array_min(F.slice(inner, i + 1, k - s + 1))
            edge = (low == F.get(inner, i)) | (low == F.get(inner, i + k - s))
            return F.when((i <= n - k) & edge, F.struct(i.alias("at"), F.xxhash64(F.slice(hashes, i + 1, k)).alias("anchor")))

        return F.filter(F.transform(hashes, chosen), lambda x: x.isNotNull())

    whole = F.filter(F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(hashes).alias("anchor"))), lambda x: n > 0)
    found = F.when(n < k, whole).otherwise(F.get(F.transform(F.array(inner), of), F.lit(0)))
    return F.get(F.transform(F.array(found), lambda x: F.when(F.size(x) == 0, whole).otherwise(x)), F.lit(0))


def written(anchors: Column) -> Column:
    """The lower 32 bits of each anchor in hexadecimal, one after another."""
    return F.array_join(F.transform(anchors, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Shared over all distinct anchors; 1 if neither has any, that is, if neither text has a unit."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def in_place(a: Column, b: Column) -> Column:
    """How many of the distinct (at, anchor) of two texts are the same: anchors that stand at one place in both."""
    keyed = lambda x: F.transform(x, lambda y: F.xxhash64(y["at"], y["anchor"]))
    return F.size(F.array_intersect(keyed(a), keyed(b))).cast("long")


def with_next(docs: DataFrame, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """docs (doc_id, text) -> bucket, at, late, doc_id, text, so that within a bucket, by (late, at, text), the row after a
    text is the next document; late rows are copies of the next bucket's first, there to be read only.

    Buckets are ranges of ids between quantiles (of the ids; the driver gets the bounds, one for bucket_chars of text and at most MOST_BUCKETS), so that
    one exchange of the texts by bucket does for a global order. Rows without an id stand before all, by a hash of their text, so that they
    are spread over buckets too."""
    # beyond any id that is in use: the lowest 2**40 of the 2**64 are the places of rows without one
    placed = docs.withColumn("at", F.coalesce("doc_id", F.lit(-(2**63)).cast("long") + F.pmod(F.xxhash64("text"), F.lit(2**40))))
    total = placed.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(64, -(-total // bucket_chars)))
    fine_size = isqrt(buckets)
    some = placed.agg(F.percentile_approx("at", [i / buckets for i in range(1, buckets)], max(20000, 4 * buckets)).alias("bounds")).first()["bounds"]
    bounds = sorted(set(some or []))
    coarse, fine = bounds[fine_size - 1 :: fine_size], [bounds[i : i + fine_size - 1] for i in range(0, len(bounds), fine_size)] or [[]]
    lists = F.from_json(F.lit(json.dumps(fine)), "array<array<bigint>>")
    group = F.size(F.filter(F.from_json(F.lit(json.dumps(coarse)), "array<bigint>"), lambda x: x <= F.col("at")))
    placed = placed.withColumn("group", group)
    inside = F.size(F.filter(F.coalesce(F.get(lists, F.col("group")), F.array().cast("array<bigint>")), lambda x: x <= F.col("at")))
    placed = placed.withColumn("bucket", (F.col("group") * fine_size + inside).cast("int")).drop("group")
    lowest = sorted(tuple(r) for r in placed.groupBy("bucket").agg(F.min("at")).collect())  # a row a bucket
    if not lowest:
        return placed.withColumn("late", F.lit(0))
    before = [(lowest[i - 1][0], at) for i, (_, at) in enumerate(lowest)]  # the first goes after the last
    wanted = docs.sparkSession.createDataFrame(before, "bucket int, at long")
    firsts = placed.drop("bucket").join(F.broadcast(wanted), "at").groupBy("bucket", "at", "doc_id").agg(F.min("text").alias("text"))
    return placed.withColumn("late", F.lit(0)).unionByName(firsts.withColumn("late", F.lit(1)))


def fingerprints(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_in_place: a
    row for each row of docs.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or all, of the next document by ascending doc_id
    (after the last: the first; null doc_id before all, by a hash of the text; rows that repeat a doc_id by their text). A
    fingerprint has 8 hexadecimal digits for each closed syncmer in the order of the text; likeness is that of the sets of syncmers. n_in_place counts the
    anchors that a text and its edited text have at the same unit. A text none of whose k-mers is
    a syncmer has itself as its one anchor. Equal passages of few more than k units may have no anchor of their own, so texts
    that share only these are alike by 0. Null text is empty; texts without words have an empty fingerprint, and two such texts are alike
    by 1. Empty table: no rows. Other columns are ignored."""
    ship(docs.sparkSession)
    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = Window.partitionBy("bucket").orderBy("late", "at", "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    hashed = lambda text: F.transform(units(text), lambda x: F.xxhash64(x))
    rows = with_next(two).withColumn("next", F.lead("text").over(order)).withColumn("hashes", hashed(F.col("text")))
    rows = rows.withColumn("anchors", selected(F.col("hashes"), k, s)).drop("hashes").withColumn("next_anchors", F.lead(F.col("anchors")["anchor"]).over(order)).filter("late = 0")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next", "text"), F.lit(1), half)).alias("edited"), "anchors", F.coalesce("next_anchors", F.col("anchors")["anchor"]).alias("next_anchors"))
    rows = rows.withColumn("edited_hashes", hashed(F.col("edited")))
    rows = rows.withColumn("edited_anchors", selected(F.col("edited_hashes"), k, s)).drop("edited_hashes")
    own, edited = F.col("anchors")["anchor"], F.col("edited_anchors")["anchor"]
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), written(own).alias("fingerprint"), written(edited).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"), likeness(own, F.col("next_anchors")).alias("near_next"), in_place(F.col("anchors"), F.col("edited_anchors")).alias("n_in_place"),
    )
