"""Benchmark decontamination: SimHash windows, multi-index Hamming blocks, exact check.

A document is contaminated by an item when some window of the item's length in
words reaches a weighted 5-word-shingle similarity of 0.75 with it.  A shingle
weighs as often as it occurs; similarity is the sum of the smaller weights over
the sum of the larger.

Plan (DataFrame functions only)
1. Windows.  A shingle position of the document is a hit of an item that holds the
   shingle, wherever in the item: similarity knows no order.  A window reaches the
   threshold only with enough hits (see least_shared), so every item-sized window
   with that many is kept for that item, and no other.  Nothing is lost here.
2. The windows' starts are written down, one row per (document, item).  Documents
   that have some are read again and hashed, and their windows are cut from slabs of
   SLAB starts, so a row never holds more than a slab's windows.
3. Each window gets a 64-bit SimHash of its weighted shingles.  Counting goes 32
   bits a lane, two bits of the hash in one long.
4. Fingerprints meet under (item, block number, block bits).  radius + 1 blocks
   guarantee every pair of fingerprints within the radius.  At similarity 0.75 about
   11 of 64 bits differ (sd 3), so RADIUS = 23 is four deviations out.  radius=None
   is the exact way: all windows of step 1 are verified, whatever their fingerprint.
5. Candidates are verified with the exact similarity; the best window of a
   (document, item) pair is reported.

Arrays are unrolled with the outer generators: for the inner ones the optimizer
adds a filter on the array's size, which would compute the whole array twice.

What is broadcast is sized first, each table by its own rows and array entries
(see _fits); beyond BROADCAST_BYTES the same joins shuffle.

Edge cases: null, empty and blank texts or items match nothing; an item or
document under five words is one shingle, its whole sequence; a document shorter
than an item is one window; repeated items are reported one by one, repeated rows
of a document once; null ids match nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import BROADCAST_BYTES, materialise

RADIUS = 23
BITS = 64
SLAB = 512  # window starts cut from one row


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def shingles_of(words: Column, size: int = 5) -> Column:
    """Hash of each run of size words, in order; of the whole sequence if it is shorter; none without words."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, size)))
    return F.when(n >= 1, many).otherwise(F.array().cast("array<bigint>"))


def simhash(shingles: Column) -> Column:
    """64-bit SimHash: a bit is set when it is set in more than half of the shingles."""
    lane = F.lit(0x0000000100000001)

    def counted(k: int) -> Column:
        return F.aggregate(shingles, F.lit(0).cast("bigint"), lambda s, h: s + F.shiftrightunsigned(h, k).bitwiseAND(lane))

    counts = F.array(*[counted(k) for k in range(BITS // 2)])
    n, one, low = F.size(shingles), F.lit(1).cast("bigint"), F.lit(0xFFFFFFFF)

    def half(shift: int) -> Column:
        bits = F.transform(counts, lambda c, k: F.when(2 * F.shiftrightunsigned(c, shift).bitwiseAND(low) > n, F.call_function("shiftleft", one, k + shift)).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))

    return half(0).bitwiseOR(half(32))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(radius: int) -> list[int]:
    """Masks of radius + 1 disjoint blocks that cover the fingerprint."""
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return [_signed((1 << b) - (1 << a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def blocks_of(fingerprint: Column, radius: int) -> Column:
    return F.posexplode_outer(F.array(*[fingerprint.bitwiseAND(F.lit(m)) for m in block_masks(radius)]))


def first_equal_block(differ: Column, radius: int) -> Column:
    """Number of the first block without a differing bit; null if there is none."""
    out = F
    for i, m in enumerate(block_masks(radius)):
        out = out.when(differ.bitwiseAND(F.lit(m)) == 0, i)
    return out


def shared_weight(a: Column, b: Column) -> Column:
    """Sum of the smaller weights of two bags of shingles; a set intersection where one of them repeats nothing."""
    counted = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, g: s + F.least(F.size(F.filter(a, lambda x: x == g)), F.size(F.filter(b, lambda x: x == g))))
    plain = (F.size(F.array_distinct(b)) == F.size(b)) | (F.size(F.array_distinct(a)) == F.size(a))
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(counted)


def least_shared(a: Column, b: Column, threshold: float) -> Column:
    """Shared weight at which bags of a and b shingles reach the threshold: shared / (a + b - shared) >= threshold."""
    return F.greatest(F.lit(1), F.ceil((a + b) * (threshold / (1 + threshold)) - 1e-9)).cast("int")


def _fits(size: int):
    """broadcast for a table of so many bytes, or nothing."""
    return F.broadcast if size <= BROADCAST_BYTES else lambda df: df


def _hashed(docs: DataFrame, words: int, *keep: str) -> DataFrame:
    """doc_id, m (words), hashes of the shingles in order."""
    split = docs.select("doc_id", *keep, words_of(F.col("text")).alias("words"))
    return split.select("doc_id", *keep, F.size("words").alias("m"), shingles_of(F.col("words"), words).alias("hashes"))


def window_starts(docs: DataFrame, anchors: DataFrame, threshold: float, words: int) -> DataFrame:
    """(doc_id, item_id, n, starts): the windows of each item's length with enough hits of that item."""
    hits = _hashed(docs, words).select("doc_id", "m", F.posexplode_outer("hashes").alias("p", "h")).join(anchors, "h")
    hits = hits.groupBy("doc_id", "m", "item_id", "n").agg(F.array_sort(F.collect_set("p")).alias("at"))
    own = F.greatest(F.least("m", "n") - (words - 1), F.lit(1))  # shingles of a window
    hits = hits.select("*", own.alias("own"), least_shared(own, F.greatest(F.col("n") - (words - 1), F.lit(1)), threshold).alias("least")).where("size(at) >= least")

    def starts(first: Column, i: Column) -> Column:
        """Windows that hold the hits from the i-th on, as many as are needed."""
        last = F.get("at", i + F.col("least") - 1)
        low, high = F.greatest(F.lit(0), last - F.col("own") + 1), F.greatest(F.lit(0), F.least(first, F.col("m") - F.col("n")))
        return F.when(last.isNotNull() & (low <= high), F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))

    return hits.select("doc_id", "item_id", "n", F.array_distinct(F.flatten(F.transform("at", starts))).alias("starts")).where("size(starts) > 0")


def _cut(docs: DataFrame, windows: DataFrame, words: int) -> DataFrame:
    """(doc_id, item_id, n, start, shingles) of the windows (doc_id, windows array<struct<item_id, n, starts>>)."""
    rows = _hashed(docs.join(windows, "doc_id"), words, "windows")
    own = lambda n: F.greatest(F.least(F.col("m"), n) - (words - 1), F.lit(1))
    widest = F.array_max(F.transform("windows", lambda w: own(w["n"])))
    slabs = F.transform(F.sequence(F.lit(0), F.floor((F.size("hashes") - 1) / SLAB).cast("int")), lambda s: F.struct(s.alias("slab"), F.slice("hashes", s * SLAB + 1, widest + SLAB).alias("own_hashes")))
    rows = rows.select("doc_id", "m", "windows", F.explode_outer(slabs).alias("s")).select("doc_id", "m", "windows", "s.slab", "s.own_hashes")
    here = F.flatten(F.transform("windows", lambda w: F.transform(F.filter(w["starts"], lambda p: F.floor(p / SLAB) == F.col("slab")), lambda p: F.struct(w["item_id"].alias("item_id"), w["n"].alias("n"), p.alias("start")))))
    rows = rows.select("doc_id", "m", "slab", "own_hashes", here.alias("here")).where("size(here) > 0")
    cut = F.transform("here", lambda w: F.struct(w["item_id"].alias("item_id"), w["n"].alias("n"), w["start"].alias("start"), F.slice("own_hashes", w["start"] - F.col("slab") * SLAB + 1, own(w["n"])).alias("shingles")))
    return rows.select("doc_id", F.explode_outer(cut).alias("w")).select("doc_id", "w.item_id", "w.n", "w.start", "w.shingles")


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.75, words: int = 5, radius: int | None = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity, start and n_words of the best window, distance of the fingerprints."""
    bench = items.select(F.col("item_id").cast("long"), words_of(F.col("text")).alias("words")).where("item_id IS NOT NULL AND size(words) > 0")
    # repeated ids with different texts are told apart by row
    bench = bench.select("item_id", F.size("words").alias("n"), shingles_of(F.col("words"), words).alias("item_shingles"))
    bench = materialise(bench.distinct().withColumn("row", F.monotonically_increasing_id()), "items")
    n_items, n_shingles = bench.agg(F.count("*"), F.coalesce(F.sum(F.size("item_shingles")), F.lit(0))).first()
    anchors = bench.select(F.col("row").alias("item_id"), "n", F.explode_outer(F.array_distinct("item_shingles")).alias("h"))
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    windows = materialise(window_starts(docs, _fits(100 * n_shingles)(anchors), threshold, words), "windows")
    n_rows, n_starts = windows.agg(F.count("*"), F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()
    per_doc = windows.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "n", "starts")).alias("windows"))
    cut = _cut(docs, _fits(150 * n_rows + 4 * n_starts)(per_doc), words)

    known = bench.select(F.col("row").alias("item_id"), "item_shingles")
    prints = cut.withColumn("print", simhash(F.col("shingles")))
    item_prints = known.select("item_id", simhash(F.col("item_shingles")).alias("item_print"))
    if radius is None:
        met = prints.join(_fits(120 * n_items)(item_prints), "item_id").withColumn("distance", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))))
    else:
        left = prints.select("*", blocks_of(F.col("print"), radius).alias("block", "bits"))
        right = item_prints.select("*", blocks_of(F.col("item_print"), radius).alias("block", "bits"))
        differ = F.col("print").bitwiseXOR(F.col("item_print"))
        met = left.join(_fits(120 * (radius + 1) * n_items)(right), ["item_id", "block", "bits"]).withColumn("distance", F.bit_count(differ))
        met = met.where((F.col("distance") <= radius) & (F.col("block") == first_equal_block(differ, radius)))  # a pair counts in its first equal block
    met = met.select("doc_id", "item_id", "n", "start", "shingles", "distance").join(_fits(100 * n_items + 8 * n_shingles)(known), "item_id")
    met = met.withColumn("shared", shared_weight(F.col("shingles"), F.col("item_shingles")))
    sure = met.withColumn("similarity", F.col("shared") / (F.size("shingles") + F.size("item_shingles") - F.col("shared"))).where(F.col("similarity") >= threshold)
    names = bench.select(F.col("row").alias("row"), F.col("item_id").alias("name"))
    sure = sure.join(_fits(60 * n_items)(names), F.col("item_id") == F.col("row"))
    best = sure.groupBy("doc_id", F.col("name").alias("item_id")).agg(F.max(F.struct("similarity", F.expr("-start").alias("back"), "n", "distance")).alias("best"))
    return best.selectExpr("doc_id", "item_id", "round(best.similarity, 6) AS similarity", "cast(-best.back AS bigint) AS start", "cast(best.n AS bigint) AS n_words", "cast(best.distance AS bigint) AS distance")


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the contaminated documents."""
    bad = contaminated(docs, items, **options).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == bad["_bad"], "left_anti")
