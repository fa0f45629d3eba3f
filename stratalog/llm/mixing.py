"""Mixing sources to target weights by Sainte-Laguë apportionment, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pinned, word_count

SHARE = 1.5
WEIGHTS = (3, 1, 2)
MOST_PASSES = 2
#: Words of a block. Blocks are counted, never listed, so small ones cost nothing.
BLOCK_WORDS = 8
#: Words of a shard of the mix; a source is laid out in this many cells per shard of its own
#: words, and at least one. A cell is what one window group holds.
SHARD_WORDS, SHARD_CELLS = 100_000, 4
SEED = 20_240


def source_targets(
    sizes: DataFrame, share: float = SHARE, weights: tuple = WEIGHTS, most: int = MOST_PASSES
) -> DataFrame:
    """Targets per source from (source, source_size): one row per source.

    Sources in code point order, null last, take ``weights`` in turn and share
    ``share`` of all words; a target stops at ``most`` times its source and the
    excess goes to the rest by weight. With sources in order of size to weight, the
    level that the running rest allows is highest at the first source that stays
    below its bound, so the common level is a maximum and no loop is needed.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("ratio_", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (
        sizes.withColumn("source_no", F.row_number().over(by_name))
        .withColumn("weight", F.get(turns, (F.col("source_no") - 1) % len(weights)))
        .withColumn("bound_", F.col("source_size") * float(most))
        .withColumn("ratio_", F.col("bound_") / F.col("weight"))
        .withColumn("total_", F.sum("source_size").over(everything) * float(share))
        .withColumn("weights_", F.sum("weight").over(everything))
    )
    spent = F.coalesce(F.sum("bound_").over(by_ratio), F.lit(0.0))
    weighed = F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))
    level = ranked.withColumn("level_", (F.col("total_") - spent) / (F.col("weights_") - weighed))
    return level.withColumn("level_", F.max("level_").over(everything)).select(
        "source",
        "source_no",
        "source_size",
        "weight",
        F.least("bound_", F.col("level_") * F.col("weight")).alias("target"),
    )


def source_blocks(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``targets`` with the blocks each source gets: the highest of the quotients
    target / (2k + 1) over all sources take one block each until the mix is full.

    Rounding target / block_words gives the same numbers up to the count by which
    their sum misses the mix, and all sources move in the same direction, so only
    quotients within that distance are listed and ranked.
    """
    everything = Window.partitionBy()
    near = (
        targets.withColumn("round_", F.floor(F.col("target") / block_words + 0.5))
        .withColumn("house_", F.round(F.sum("target").over(everything) / block_words).cast("long"))
        .withColumn("off_", F.abs(F.col("house_") - F.sum("round_").over(everything)) + 1)
        .withColumn("sure_", F.greatest(F.lit(0), F.col("round_") - F.col("off_")).cast("long"))
        .withColumn("open_", F.col("house_") - F.sum("sure_").over(everything))
    )
    seats = near.select(
        "*", F.explode(F.sequence(F.col("sure_"), (F.col("round_") + F.col("off_")).cast("long"))).alias("k_")
    ).withColumn("quotient_", F.col("target") / (2 * F.col("k_") + 1))
    ranked = seats.withColumn(
        "place_", F.row_number().over(Window.orderBy(F.desc("quotient_"), "source_no", "k_"))
    )
    won = F.sum(((F.col("place_") <= F.col("open_")) & (F.col("quotient_") > 0)).cast("long"))
    return ranked.groupBy("source", "source_no", "source_size", "target", "sure_").agg(won.alias("won_")).select(
        "source", "source_no", "source_size", "target", (F.col("sure_") + F.col("won_")).alias("blocks")
    )


def _covered(x: Column, block: int) -> Column:
    """Words before ``x`` on a cell's line that lie in its chosen run."""
    start = F.col("first_") * block
    end = start + F.col("extra_")
    straight = F.greatest(F.lit(0), F.least(x, end) - start)
    wrapped = F.greatest(F.lit(0), F.least(x, end - F.col("cell_")))
    return F.when(F.col("extra_") == 0, F.lit(0)).otherwise(straight + wrapped)


def _cell_quotas(dealt: DataFrame) -> DataFrame:
    """(no_, at_, cell_, quota_): words of every cell and the words its source takes of it.

    A source's words up to the end of a cell take their share of its ``words_``, rounded; a
    cell gets the difference to the one before it. So quotas sum to the source's words
    exactly and miss a cell's own share by less than a word.
    """
    cells = dealt.groupBy("source_no", "source_size", "words_", "part_").agg(F.sum("size").alias("cell_"))
    before = Window.partitionBy("source_no").orderBy("part_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    due = lambda x: F.floor(F.coalesce(F.col("words_") * F.try_divide(x, F.col("source_size")), F.lit(0.0)) + 0.5)
    upto = cells.withColumn("upto_", F.sum("cell_").over(before))
    quota = F.least(due(F.col("upto_")) - due(F.col("upto_") - F.col("cell_")), F.col("cell_") * MOST_PASSES)
    return upto.select(F.col("source_no").alias("no_"), F.col("part_").alias("at_"), "cell_", quota.alias("quota_"))


def mix(
    rows: DataFrame,
    share: float = SHARE,
    weights: tuple = WEIGHTS,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """What the mix takes of every row of (doc_id, source, size, ...).

    Adds ``source_size``, ``target``, ``taken`` (words, repeats counted), ``copies``
    (passes that take the row's middle word) and ``mix_shard``. All rows are dealt
    to shards by a seeded hash, so a source with a third of the rows lies on all of
    them, and to the cells of their source, whose number follows from that source's
    words alone. In a cell rows stand on a line in seeded order. The words of the
    source's blocks go to its cells by their sizes and sum up exactly, whole passes
    first, the rest as a run of words from the seeded start of a block.

    * Null source: a source of its own, last in order. Null or empty text has size
      0, takes nothing and is not copied.
    * Rows that agree in id and size lie in one cell; what equal rows take may be
      swapped among them. Empty table: no rows.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = pinned(source_blocks(source_targets(sizes, share, weights), block_words), "mix-plan")
    words = plan.agg(F.sum("source_size")).first()[0] or 0
    shards = max(1, -(-words // shard_words))
    dealt = rows.withColumn("draw_", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn(
        "mix_shard", F.pmod("draw_", F.lit(shards).cast("long"))
    )
    cells = F.greatest(F.lit(1), F.floor(F.col("source_size") * SHARD_CELLS / shard_words)).cast("long")
    whole = F.least(F.col("blocks") * block_words, F.col("source_size") * MOST_PASSES)
    part = plan.select(
        F.col("source").alias("source_"), "source_no", "source_size", "target", cells.alias("cells_"), whole.alias("words_")
    )
    known = dealt.join(part, dealt["source"].eqNullSafe(part["source_"])).drop("source_")
    known = known.withColumn("part_", F.pmod("draw_", "cells_"))
    quotas = pinned(_cell_quotas(known), "mix-cells")
    cell = Window.partitionBy("source_no", "part_")
    order = cell.orderBy("draw_", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = (
        known.withColumn("end_", F.sum("size").over(order))
        .join(quotas, (F.col("source_no") == F.col("no_")) & (F.col("part_") == F.col("at_")))
        .withColumn("passes_", F.coalesce(F.floor(F.try_divide("quota_", "cell_")), F.lit(0)).cast("long"))
        .withColumn("extra_", F.col("quota_") - F.col("passes_") * F.col("cell_"))
        .withColumn(
            "first_",
            F.pmod(
                F.xxhash64(F.lit(seed), "source", "part_"),
                F.greatest(F.lit(1), F.ceil(F.col("cell_") / block_words)).cast("long"),
            ),
        )
        .withColumn("start_", F.col("end_") - F.col("size"))
    )
    middle = F.col("start_") + F.floor(F.col("size") / 2)
    extra = _covered(F.col("end_"), block_words) - _covered(F.col("start_"), block_words)
    again = _covered(middle + 1, block_words) - _covered(middle, block_words)
    taken = F.col("passes_") * F.col("size") + extra
    return laid.select(
        *rows.columns,
        "source_size",
        "target",
        taken.cast("long").alias("taken"),
        F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("passes_") + again).cast("int").alias("copies"),
        "mix_shard",
    )


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed documents: every row as often as a pass takes its middle word.

    The columns are those of ``docs``; names cannot clash, as the row travels in a
    struct of its own.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        F.struct(*docs.columns).alias("row_"),
    )
    mixed = mix(rows, **options).filter("copies > 0")
    return mixed.select("row_", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row_.*")


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """What the mix takes of every document: the text is read once, for its size."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(pinned(rows, "mix-sizes"), **options)
