"""Near-duplicates: fast similarity sketches, banding, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Temporary, WordHashes, fold, pinned, slices

SHINGLE_WORDS = 5
#: Two sets are linked if 100 * common >= THRESHOLD * union.
THRESHOLD = 80
#: A pair at the threshold shares no band with probability (1 - 0.8^5)^35 < 1e-6.
BANDS, BAND_ROWS = 35, 5
#: Bits of the parity map of a set, in longs.
PARITY_LONGS = 16
#: Rounds in which unconnected members meet one drawn member of each bucket's main component.
ROUNDS = 2
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _seeds(start: int, count: int) -> np.ndarray:
    """A 64-bit seed for each number from ``start``."""
    return fold((np.arange(start, start + count, dtype=np.uint64) + np.uint64(1)) * _STEP)


def shingle_set(hashes: WordHashes, text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit digests of the runs of ``words`` words, A-Z lower-cased;
    with fewer words the whole text is one run, without words there is none."""
    h = hashes((text or "").encode("utf-8", "replace").lower().split())
    if not len(h):
        return h
    size = min(words, len(h))
    mixed = np.zeros(len(h) - size + 1, dtype=np.uint64)
    for i, seed in enumerate(_seeds(0, size)):
        mixed = fold(mixed + (h[i : len(h) - size + 1 + i] ^ seed))
    return np.unique(mixed + np.uint64(size))


def fast_sketch(elements: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketch (Dahlgaard, Knudsen and Thorup): ``size`` coordinates.

    In each of the first ``size`` rounds every element is thrown into a bin; a bin
    keeps the least hash of the first round that reached it. In the next ``size``
    rounds all elements compete for the bin of that number, so every bin fills.
    The chance that two sets agree in a bin is their similarity, with Chernoff-like
    concentration over the bins.
    """
    out = np.full(size, np.uint64(0))
    empty = np.ones(size, dtype=bool)
    done = 0
    while done < size and empty.any():
        rounds = min(size - done, max(1, -(-3 * size // len(elements))))
        h = fold(elements[None, :] ^ _seeds(done, rounds)[:, None])
        # earlier rounds first, then the least hash
        order = (np.arange(done, done + rounds, dtype=np.uint64)[:, None] << np.uint64(50)) | (h >> np.uint64(14))
        bins = (h % np.uint64(size)).astype(np.int64)
        free = empty[bins]
        keys, at = order[free], bins[free]
        by = np.argsort(keys)[::-1]  # the least is written last
        out[at[by]] = keys[by]
        empty[at] = False
        done += rounds
    for b in np.flatnonzero(empty):
        out[b] = (size + int(b) << 50) | int((fold(elements ^ _seeds(size + int(b), 1)) >> np.uint64(14)).min())
    return out


def bands_of(sketch: np.ndarray) -> np.ndarray:
    """A digest for each band of coordinates; equal bands of different number differ."""
    rows = sketch.reshape(BANDS, BAND_ROWS)
    out = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * _STEP
    for i in range(BAND_ROWS):
        out = fold(out + rows[:, i] * np.uint64(2 * i + 3))
    return out.view(np.int64)


def parity_map(elements: np.ndarray) -> np.ndarray:
    """Parity of the number of elements in each of 1,024 classes. Maps of two sets
    differ in at most as many bits as elements are in one set only."""
    counts = np.bincount((elements & np.uint64(64 * PARITY_LONGS - 1)).astype(np.int64), minlength=64 * PARITY_LONGS)
    return np.packbits((counts & 1).astype(bool)).view(np.int64)


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            n, d0, d1, bands, parity = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                elements = shingle_set(hashes, text, words)
                n.append(len(elements))
                if len(elements):
                    digest = np.frombuffer(blake2b(elements.tobytes(), digest_size=16).digest(), dtype=np.int64)
                    d0.append(int(digest[0]))
                    d1.append(int(digest[1]))
                    bands.append(bands_of(fast_sketch(elements, BANDS * BAND_ROWS)))
                    parity.append(parity_map(elements))
                else:
                    d0.append(None), d1.append(None), bands.append(None), parity.append(None)
            yield pa.record_batch(
                [batch.column("id_"), pa.array(n, pa.int64()), pa.array(d0, pa.int64()), pa.array(d1, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(parity, pa.list_(pa.int64()))],
                ["id_", "n", "d0", "d1", "bands", "parity"],
            )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            sets = [shingle_set(hashes, t, words).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("id_"), pa.array(sets, pa.list_(pa.int64()))], ["id_", "elements"])

    return run


def connected(links: DataFrame) -> DataFrame:
    """(id_, root_): the smallest id reachable over ``links`` (a, b), for ids that have links.

    Rounds of contraction: every node points to its smallest neighbour below it,
    pointers are doubled until they end in roots, links are drawn anew between
    roots. All of it is joins and minima over written tables; the number of rounds
    grows with the logarithm of the ids.
    """
    edges = links
    nodes = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = pinned(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "cc-point")
        while True:
            ahead = point.select(F.col("a").alias("to"), F.col("to").alias("next"))
            doubled = point.join(ahead, "to", "left").select("a", F.coalesce("next", "to").alias("to"), (F.col("next") < F.col("to")).alias("moved"))
            doubled = pinned(doubled, "cc-double")
            point = doubled.select("a", "to")
            if doubled.filter("moved").isEmpty():
                break
        if nodes is None:
            nodes = point.select(F.col("a").alias("id_"), F.col("to").alias("root_"))
        else:
            newer = point.select(F.col("a").alias("root_"), F.col("to").alias("newer_"))
            nodes = pinned(nodes.join(newer, "root_", "left").select("id_", F.coalesce("newer_", "root_").alias("root_")), "cc-nodes")
        left = point.select("a", F.col("to").alias("ra"))
        right = point.select(F.col("a").alias("b"), F.col("to").alias("rb"))
        edges = edges.join(left, "a").join(right, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("b"), F.greatest("ra", "rb").alias("a")).distinct()
        edges = pinned(edges, "cc-edges")
        if edges.isEmpty():
            return nodes


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("id_").alias("a"), F.col("elements").alias("x_"))
    right = sets.select(F.col("id_").alias("b"), F.col("elements").alias("y_"))
    common = F.size(F.array_intersect("x_", "y_"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", common.alias("n_"), (F.size("x_") + F.size("y_")).alias("sum_"))
    return met.filter(100 * F.col("n_") >= threshold * (F.col("sum_") - F.col("n_"))).select("a", "b")


def near_duplicates(
    docs: DataFrame, words: int = SHINGLE_WORDS, threshold: int = THRESHOLD, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    Documents with equal shingle sets are one class (a digest of 128 bits), in the
    name of its smallest id; classes are sketched and banded. Every class is first
    verified against one partner, the bucket head it shares most bands with; linked
    classes are contracted. In some rounds, members outside a bucket's main
    component then meet one drawn member of it. At last every pair of classes that
    share a bucket and are still not connected is verified: the members outside the
    main component against all others of another component. So no link between
    different texts is lost to the order, and a bucket of copies costs some pairs
    per member instead of all pairs. Verification is on full sets; sizes and parity
    maps rule out pairs first, both without loss.

    * Null or empty text, or one without words: no set, linked with nothing.
    * Null ids: rows of their own with null component, kept.
    * Repeated ids: links of any of the rows count for the id, so texts of one id are one
      group with all that they are linked with.
    * Ids are whole numbers; text that is none raises or, without ANSI mode, counts as null.
    * Empty table: no rows. Other columns are not read.

    The result is written out; the tables on the way to it are removed again.
    """
    with Temporary(docs.sparkSession) as temporary:
        return temporary.keep(pinned(_near_duplicates(docs, words, threshold, id_col, text), "near-duplicates"))


def _near_duplicates(docs: DataFrame, words: int, threshold: int, id_col: str, text: str) -> DataFrame:
    named = docs.select(F.col(id_col).cast("long").alias("id_"), F.col(text).alias("text"))
    sketched = pinned(named.mapInArrow(_sketches(words), "id_ bigint, n bigint, d0 bigint, d1 bigint, bands array<bigint>, parity array<bigint>"), "sketches")
    with_set = sketched.filter("n > 0 and id_ is not null")
    classes = pinned(with_set.groupBy("d0", "d1").agg(F.min("id_").alias("rep_")), "classes")

    head = classes.select("d0", "d1", F.col("rep_").alias("id_"))
    reps = with_set.join(head, ["d0", "d1", "id_"], "left_semi").select("id_", "n", F.explode("bands").alias("band"))
    reps = pinned(reps.distinct(), "bands")
    heads = reps.groupBy("band").agg(F.min("id_").alias("head_"), F.max("id_").alias("last_")).filter("head_ <> last_")
    heads = pinned(heads.select("band", "head_"), "heads")
    members = pinned(reps.join(heads, "band"), "members")  # id_, n, band, head_
    kept_sizes = lambda n, m: 100 * F.least(n, m) >= threshold * F.greatest(n, m)

    needed = members.select("id_").distinct()
    sets = named.join(needed, "id_", "left_semi").mapInArrow(_sets(words), "id_ bigint, elements array<bigint>")
    sets = pinned(sets, "sets")

    # classes that hold rows of one id belong together
    ids = with_set.join(classes, ["d0", "d1"]).select("id_", "rep_").distinct()
    least = ids.groupBy("id_").agg(F.min("rep_").alias("b"), F.count("*").alias("n_")).filter("n_ > 1")
    ties = pinned(ids.join(least, "id_").filter("rep_ > b").select(F.col("rep_").alias("a"), "b").distinct(), "ties")

    votes = members.filter("id_ <> head_").groupBy("id_", "head_").agg(F.count("*").alias("votes_"))
    first = votes.groupBy("id_").agg(F.max_by("head_", "votes_").alias("head_"))
    first = pinned(first.select(F.col("id_").alias("a"), F.col("head_").alias("b")), "first-pairs")
    links = pinned(_confirmed(first, sets, threshold), "first-links").union(ties)
    roots = _roots(links)

    for round_ in range(ROUNDS):
        open_ = _open_members(members, roots, f"round-{round_}")
        drawn = open_.filter("root_ = main_").groupBy("band").agg(F.min(F.xxhash64(F.lit(round_), "id_")).alias("draw_"))
        picks = open_.filter("root_ = main_").withColumn("draw_", F.xxhash64(F.lit(round_), "id_")).join(pinned(drawn, "draws"), ["band", "draw_"])
        picks = pinned(picks.select("band", F.col("id_").alias("b"), F.col("n").alias("nb")), "picks")
        rest = open_.filter("root_ <> main_").select("band", F.col("id_").alias("a"), F.col("n").alias("na"))
        pairs = rest.join(picks, "band").filter(kept_sizes(F.col("na"), F.col("nb")))
        pairs = pinned(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "round-pairs")
        links = links.union(pinned(_confirmed(pairs, sets, threshold), "round-links"))
        roots = _roots(links)

    maps = with_set.join(head, ["d0", "d1", "id_"], "left_semi").select("id_", "n", "parity").distinct()
    open_ = _open_members(members, roots, "last")
    open_ = pinned(open_.join(maps, ["id_", "n"]), "last-maps")
    rest = open_.filter("root_ <> main_").select(
        "band", F.col("id_").alias("a"), F.col("n").alias("na"), F.col("root_").alias("ra"), F.col("parity").alias("pa")
    )
    others = open_.select(
        "band", F.col("id_").alias("b"), F.col("n").alias("nb"), F.col("root_").alias("rb"), F.col("parity").alias("pb"),
        (F.col("root_") == F.col("main_")).alias("in_main"),
    )
    apart = sum((F.bit_count(F.col("pa")[i].bitwiseXOR(F.col("pb")[i])) for i in range(PARITY_LONGS)), F.lit(0))
    near = (100 + threshold) * apart <= (100 - threshold) * (F.col("na") + F.col("nb"))
    pairs = (
        rest.join(others, "band")
        .filter((F.col("ra") != F.col("rb")) & (F.col("in_main") | (F.col("a") < F.col("b"))) & kept_sizes(F.col("na"), F.col("nb")) & near)
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    more = pinned(_confirmed(pinned(pairs, "last-pairs"), sets, threshold), "last-links")
    roots = _roots(links.union(more)) if not more.isEmpty() else roots

    known = sketched.join(classes, ["d0", "d1"], "left")
    root = roots.select(F.col("id_").alias("rep_"), "root_")
    named_out = known.join(root, "rep_", "left").select(
        F.col("id_").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id_").isNotNull(), F.coalesce("root_", "rep_", "id_")).alias("component_id"),
    )
    return named_out.withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(True)))


def _open_members(members: DataFrame, roots: DataFrame, label: str) -> DataFrame:
    """(band, id_, n, root_, main_) of the buckets that hold several components;
    ``main_`` is the one with most members."""
    placed = members.select("band", "id_", "n").join(roots, "id_", "left").withColumn("root_", F.coalesce("root_", "id_"))
    placed = pinned(placed, f"{label}-placed")
    shares = placed.groupBy("band", "root_").agg(F.count("*").alias("c_"))
    mixed = shares.groupBy("band").agg(F.max_by("root_", "c_").alias("main_"), F.count("*").alias("r_")).filter("r_ > 1")
    return pinned(placed.join(pinned(mixed.select("band", "main_"), f"{label}-mixed"), "band"), f"{label}-open")


def _roots(links: DataFrame) -> DataFrame:
    if links.isEmpty():
        return links.select(F.col("a").alias("id_"), F.col("b").alias("root_"))
    return connected(links)


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the smallest id.

    Rows with equal ids stay or go together; null ids stay.
    """
    drop = near_duplicates(docs, words, threshold).filter("not kept").select(F.col("doc_id").alias("gone_")).distinct()
    return docs.join(drop, docs["doc_id"] == F.col("gone_"), "left_anti")
