"""Benchmark decontamination by SimHash windows, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pinned

#: Words: runs of letters and digits of lower-cased text.
WORD = r"[\p{L}\p{N}]+"
SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Fingerprints of windows at the threshold differ in about 10 of 64 bits (deviation
#: below 3); within this radius lie all but one in some thousands of them.
BITS, RADIUS = 64, 20
#: Largest number of benchmark shingles that is broadcast (16 bytes each).
BROADCAST_ROWS = 1_000_000


def text_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def shingle_hashes(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order."""
    last = F.size(words) - size
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(words, i + 1, size)))
    return F.when(last >= 0, runs).otherwise(F.array().cast("array<bigint>"))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often lambdas name it."""
    return F.get(F.transform(F.array(value), use), 0)


def occurrences(shingles: Column) -> Column:
    """Different numbers for all entries: a shingle as it is, a repeat hashed with its number.

    As sets these are as alike as the shingles are by weight.
    """

    def told(ranked: Column) -> Column:
        before = lambda h, i: i - F.array_position(ranked, h).cast("int") + 1
        return F.transform(ranked, lambda h, i: F.when(before(h, i) == 0, h).otherwise(F.xxhash64(h, before(h, i))))

    repeats = F.size(F.array_distinct(shingles)) < F.size(shingles)
    return F.when(repeats, _bound(F.array_sort(shingles), told)).otherwise(shingles)


def simhash(shingles: Column) -> Column:
    """64-bit fingerprint of shingles told apart by their occurrence, each of weight 1, so that
    repeats do not move all bits together."""
    numbers = F.sequence(F.lit(0), F.lit(BITS - 1))
    powers = F.array(*[F.lit(1 << b if b < 63 else -(1 << 63)).cast("bigint") for b in range(BITS)])

    def of(features: Column) -> Column:
        votes = lambda b: F.aggregate(features, F.lit(0), lambda a, h: a + (F.getbit(h, b).cast("int") * 2 - 1))
        ones = F.filter(numbers, lambda b: votes(b) > 0)
        return F.aggregate(ones, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(F.get(powers, b)))

    return _bound(occurrences(shingles), of)


def blocks(radius: int = RADIUS) -> list[tuple[int, int]]:
    """(first bit, width) of radius + 1 blocks: two fingerprints within the radius agree in one of them."""
    edges = [i * BITS // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _part(value: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(value, first).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def _keys(fingerprint: Column, radius: int) -> Column:
    """Block number and its bits, as one number per block."""
    return F.array(*[_part(fingerprint, a, w) + (i << 40) for i, (a, w) in enumerate(blocks(radius))])


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller over sum of the larger weights; a shingle weighs as often as it occurs."""
    times = lambda x, g: F.size(F.filter(x, lambda h: h == g))
    common = F.aggregate(
        F.array_intersect(a, b), F.lit(0), lambda s, g: s + F.least(times(a, g), times(b, g))
    )
    return common / (F.size(a) + F.size(b) - common)


def _starts(at: Column, length: Column, need: Column, lowest: Column, highest: Column) -> Column:
    """Starts from lowest to highest of windows of ``length`` that hold ``need`` of the sorted places ``at``.

    A start belongs to the first place it does not lie behind, so the ranges do not overlap.
    """

    def around(i: Column) -> Column:
        first = F.greatest(lowest, F.get(at, i + need - 1) - length + 1, F.get(at, i - 1) + 1)
        last = F.least(highest, F.get(at, i))
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    ranges = F.flatten(F.transform(F.sequence(F.lit(0), F.size(at) - need), around))
    return F.when(F.size(at) >= need, ranges).otherwise(F.array().cast("array<int>"))


def window_starts(length: Column, similarity: float) -> Column:
    """Starts of all windows that can be alike enough, from the places ``at`` of shared shingles.

    Of two sets of m and k shingles with c common ones, c / (m + k - c) >= s needs
    c >= s (m + k) / (1 + s); a window that the text's end cuts has k < m, but k >= c, so c >= s m.
    """
    least = lambda share: F.greatest(F.lit(1), F.ceil(length * F.lit(share) - F.lit(1e-9)).cast("int"))
    whole = F.col("n_grams") - length
    full = _starts(F.col("at"), length, least(2 * similarity / (1 + similarity)), F.lit(0), whole)
    cut = _starts(F.col("at"), length, least(similarity), F.greatest(F.lit(0), whole + 1), F.col("n_grams") - 1)
    return F.concat(full, cut)


def benchmark_items(benchmark: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(item_id, n_words, size, grams, fingerprint) of every item that has words.

    An item of fewer than ``shingle`` words is one shingle of ``size`` words.
    """
    words = benchmark.select("item_id", text_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    sized = words.withColumn("n_words", F.size("words")).withColumn("size", F.least(F.lit(shingle), "n_words"))
    grams = F.coalesce(*[F.when(F.col("size") == k, shingle_hashes(F.col("words"), k)) for k in range(1, shingle + 1)])
    return sized.select("item_id", "n_words", "size", grams.alias("grams")).withColumn("fingerprint", simhash(F.col("grams")))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    shingle: int = SHINGLE_WORDS,
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
) -> DataFrame:
    """Benchmark passages in documents: (doc_id, item_id, start_word, n_words, similarity, text_key).

    One row per document and item with a window of the item's number of words that
    is at least ``similarity`` alike by weighted shingles; the best window counts,
    the first of equals. Every start of every text counts: a window of that likeness
    holds a least number of shingles of its item, and the windows that hold as many
    shingles of items of their length, at whatever offsets, are all laid
    (:func:`window_starts`). Their SimHash fingerprints meet those of all items of the
    same length in radius + 1 blocks, which finds all within the radius; exact
    similarity decides.

    Places of shared shingles leave the tasks first, numbers only; texts with such a
    window are then read again and alone are joined with their starts.

    * Null or empty text or item: no windows. Null ids: reported with a null id.
    * Repeated ids: texts are told apart by ``text_key``, a hash of the text;
      equal rows give one finding.
    * Empty tables: no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    items = pinned(benchmark_items(benchmark, shingle).distinct(), "benchmark-items")
    sizes = [r[0] for r in items.select("size").distinct().collect()]  # at most ``shingle`` numbers
    gate = pinned(items.select("size", "n_words", F.explode("grams").alias("gram")).distinct(), "benchmark-shingles")
    small = gate.count() <= BROADCAST_ROWS
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    windows = None
    for size in sorted(sizes):
        known = gate.filter(F.col("size") == size).select("gram", "n_words")
        # words are a column of their own: inside a shingle's expression they would be cut for each shingle
        words = texts.select("doc_id", "text_key", text_words(F.col("text")).alias("words"))
        grams = words.select("doc_id", "text_key", shingle_hashes(F.col("words"), size).alias("grams"))
        met = grams.select("doc_id", "text_key", F.size("grams").alias("n_grams"), F.posexplode_outer("grams").alias("at", "gram"))
        # outer, as Spark repeats the words for a filter below an inner explode; the join drops the nulls
        met = met.join(F.broadcast(known) if small else known, "gram")
        spots = met.groupBy("doc_id", "text_key", "n_words", "n_grams").agg(F.array_sort(F.collect_set("at")).alias("at"))
        starts = spots.select("doc_id", "text_key", "n_words", window_starts(F.col("n_words") - size + 1, similarity).alias("starts"))
        starts = pinned(starts.filter(F.size("starts") > 0), "window-starts")
        keys = starts.select("text_key").distinct()
        own = texts
        if keys.count() <= BROADCAST_ROWS:  # texts without such a window stay where they are
            own = texts.join(F.broadcast(keys), "text_key", "left_semi")
        laid = own.select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_"), "text").join(
            starts, F.col("id_").eqNullSafe(F.col("doc_id")) & (F.col("key_") == F.col("text_key"))
        )
        length = F.col("n_words") - size + 1
        cut = _bound(
            shingle_hashes(F.col("words"), size),
            lambda g: F.transform("starts", lambda s: F.struct(s.alias("start"), F.slice(g, s + 1, length).alias("grams"))),
        )
        laid = laid.select("doc_id", "text_key", "n_words", "starts", text_words(F.col("text")).alias("words"))
        laid = laid.select("doc_id", "text_key", "n_words", F.explode(cut).alias("window")).select("doc_id", "text_key", "n_words", "window.*")
        windows = laid if windows is None else windows.union(laid)
    if windows is None:
        return spark.createDataFrame([], _schema(docs, benchmark))
    prints = pinned(windows.distinct().withColumn("fingerprint", simhash(F.col("grams"))), "windows")
    theirs = items.select(
        "item_id", "n_words", F.col("grams").alias("item_grams"), F.col("fingerprint").alias("item_print"),
        F.posexplode(_keys(F.col("fingerprint"), radius)).alias("block", "key"),
    )
    ours = prints.select("*", F.explode(_keys(F.col("fingerprint"), radius)).alias("key"))
    few = items.count() * (radius + 1) <= BROADCAST_ROWS // 100
    near = ours.join(F.broadcast(theirs) if few else theirs, ["n_words", "key"])
    apart = F.col("fingerprint").bitwiseXOR(F.col("item_print"))
    # a pair that agrees in several blocks is taken in the first of them
    first = F.lit(len(blocks(radius)))
    for i, (a, w) in reversed(list(enumerate(blocks(radius)))):
        first = F.when(_part(apart, a, w) == 0, F.lit(i)).otherwise(first)
    near = near.filter((F.bit_count(apart) <= radius) & (F.col("block") == first))
    alike = near.withColumn("similarity", weighted_similarity(F.col("grams"), F.col("item_grams")))
    found = alike.filter(F.col("similarity") >= similarity)
    best = found.groupBy("doc_id", "text_key", "item_id", "n_words").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best")
    )
    return best.select(
        "doc_id", "item_id", (-F.col("best.back")).cast("int").alias("start_word"), "n_words",
        F.col("best.similarity").alias("similarity"), "text_key",
    )


def _schema(docs: DataFrame, benchmark: DataFrame) -> str:
    ids = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    return f"doc_id {ids[0]}, item_id {ids[1]}, start_word int, n_words int, similarity double, text_key bigint"


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows without a benchmark passage, all columns as they are."""
    found = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_"))
    found = pinned(found.distinct(), "contaminated")
    return docs.join(
        found, docs["doc_id"].eqNullSafe(F.col("id_")) & (F.xxhash64(docs["text"]) == F.col("key_")), "left_anti"
    )
