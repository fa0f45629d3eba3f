"""The newest row per key without sorting the rows that lose.

An aggregate over strings or structs makes Spark sort every task's rows before it
combines them, and ships the payload of each task's winner. Here the order of events,
(time, id), is one number of fixed width, so a hash aggregate combines it, and the
payload is fetched afterwards for winners alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = T.DecimalType(38, 0)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _number(text: str) -> Column:
    return F.lit(text).cast(T.DecimalType(20, 0))


def micros(col: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(col).cast("timestamp_ntz") if isinstance(col, str) else col)


def has_whole_ids(df: DataFrame, tie: str = "id") -> bool:
    return isinstance(df.schema[tie].dataType, _WHOLE)


def order_code(df: DataFrame, time: str = "timestamp", tie: str = "id") -> Column:
    """(time, tie) as one decimal: microseconds, then 64 bits that order the tie.

    Whole-number ties are told apart completely. Text cannot be put into 64 bits in
    order, so such a code is the time alone: rows of one time are told apart when the
    payload of winners is fetched.
    """
    at = micros(time).cast(T.DecimalType(19, 0))
    if not has_whole_ids(df, tie):
        return at.cast(_NUMBER)
    low = F.col(tie).cast(T.DecimalType(20, 0)) + _number(str(1 << 63))
    return (at * _number(str(1 << 64)) + F.coalesce(low, _number("0"))).cast(_NUMBER)


def with_flag(code: Column, flag: Column) -> Column:
    """A code that carries one bit below its order; see :func:`flag_of`."""
    return (code * F.lit(2).cast(T.DecimalType(1, 0)) + F.when(flag, F.lit(1)).otherwise(F.lit(0)).cast(T.DecimalType(1, 0))).cast(_NUMBER)


def flag_of(code: Column) -> Column:
    return F.pmod(code, F.lit(2).cast(T.DecimalType(1, 0))) == 1


def fetch_winners(
    winners: DataFrame, rows: DataFrame, keys: list[str], code: str, tie: str, payload: list[str],
    how: str = "inner",
) -> DataFrame:
    """Add ``payload`` to ``winners(keys, code)`` from ``rows(keys, code, tie, payload)``.

    The join is on (keys, code), so a key with very many rows is spread by its codes.
    Rows that share a code (one time, repeated rows) are settled by ``tie``, then by the
    payload, among the winners only.
    """
    own = rows.select(*keys, code, F.col(tie).alias("_tie"), *[F.col(c).alias(f"_p_{c}") for c in payload])
    joined = winners.join(own, [*keys, code], how)
    last = Window.partitionBy(*keys).orderBy(F.col("_tie").desc(), *[F.col(f"_p_{c}").desc() for c in payload])
    one = joined.withColumn("_at", F.row_number().over(last)).where("_at = 1")
    return one.select(*[c for c in winners.columns if c != code], *[F.col(f"_p_{c}").alias(c) for c in payload])


def digest_of(col: str) -> Column:
    """64-bit digest of a text payload of few different values; null stays null."""
    return F.when(F.col(col).isNotNull(), F.xxhash64(col))


def dictionary(rows: DataFrame, col: str) -> DataFrame:
    """(digest, value) of the different values of a payload: one narrow pass that combines in its tasks."""
    return rows.select(F.col(col).alias("_value")).where("_value IS NOT NULL").distinct().select(F.xxhash64("_value").alias("_digest"), "_value")


def spell_out(df: DataFrame, words: DataFrame, digest: str, name: str) -> DataFrame:
    """Replace the column ``digest`` by the text behind it."""
    named = words.select(F.col("_digest").alias(digest), F.col("_value").alias(name))
    return df.join(named, digest, "left").drop(digest)
