"""A stored full-text index that follows writes: a base, deltas with tombstones, row statistics.

``part=<n>/postings`` holds (term, entity_id, tf, doc_len, positions) sorted by term,
``part=<n>/lengths`` (entity_id, doc_len), ``part=<n>/gone`` the ids whose rows in earlier
parts are void, and ``part=<n>/stats`` what the part adds to the numbers of rows and tokens.
``stats`` is written last; a part without it does not count, so a job that stops half
way changes nothing.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..model import QueryError, union_all
from ..operators import search as se
from ..runtime import stable
from .store import _file_system

#: Parts after which adding another one writes the index anew.
MOST_PARTS = 16


def parts_of(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete parts from the newest base on, ascending."""
    hadoop, fs = _file_system(spark, root)
    if not fs.exists(hadoop):
        return []
    found = []
    for status in fs.listStatus(hadoop):
        name = status.getPath().getName()
        match = re.fullmatch(r"part=(\d+)", name)
        done, _ = _file_system(spark, f"{root}/{name}/stats/_SUCCESS")
        if match and fs.exists(done):
            found.append(int(match.group(1)))
    found.sort()
    bases = [n for n in found if _stats(spark, root, n)["base"]]
    return [n for n in found if n >= bases[-1]] if bases else []


def _stats(spark: SparkSession, root: str, number: int) -> dict:
    (line,) = spark.read.text(f"{root}/part={number}/stats").collect()
    return json.loads(line[0])


def _publish(spark: SparkSession, root: str, number: int, gone: DataFrame | None, rows: int, tokens: int) -> None:
    path = f"{root}/part={number}"
    if gone is not None:
        gone.write.mode("overwrite").parquet(f"{path}/gone")
    told = json.dumps({"base": gone is None, "rows": rows, "tokens": tokens})
    spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/stats")


def _sizes(lengths: DataFrame) -> tuple[int, int]:
    row = lengths.agg(F.count("*").alias("rows"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("tokens")).first()
    return row.rows, row.tokens


def _store(spark: SparkSession, root: str, number: int, content: DataFrame) -> tuple[int, int]:
    """Write the postings and lengths of (entity_id, content) as a part; returns its rows and tokens.

    The texts are read once; the range sort looks at its rows twice, so they are written before it.
    """
    path = f"{root}/part={number}"
    texts = stable(se.postings_in_rows(content))
    columns = ["term", "entity_id", "tf", "doc_len", "positions"]
    se.write_fts_index(texts.select("entity_id", "doc_len", F.inline("postings")).select(*columns), f"{path}/postings")
    texts.select("entity_id", "doc_len").write.mode("overwrite").parquet(f"{path}/lengths")
    return _sizes(spark.read.parquet(f"{path}/lengths"))


def create(entities: DataFrame, field: str, root: str) -> None:
    """Index the live rows of an entity table as a new base."""
    spark = entities.sparkSession
    known = parts_of(spark, root)
    number = known[-1] + 1 if known else 0
    rows, tokens = _store(spark, root, number, se.content_rows(entities, field))
    _publish(spark, root, number, None, rows, tokens)


def add(changed: DataFrame, field: str, root: str) -> int:
    """Follow a write: ``changed`` are the new states of all rows it touched, gone ones too.

    The postings of the live ones are a delta; all their ids are tombstones for what
    earlier parts hold. Only the delta is written; returns its number.
    """
    spark = changed.sparkSession
    known = parts_of(spark, root)
    if not known:
        raise QueryError(f"no index at {root}")
    if len(known) >= MOST_PARTS:
        compact(spark, root)
        known = parts_of(spark, root)
    number = known[-1] + 1
    touched = changed.select(F.col("id").alias("entity_id")).distinct()
    old_rows, old_tokens = _sizes(lengths(spark, root).join(touched, "entity_id", "left_semi"))
    rows, tokens = _store(spark, root, number, se.content_rows(changed, field))
    _publish(spark, root, number, touched, rows - old_rows, tokens - old_tokens)
    return number


def _merged(spark: SparkSession, root: str, name: str, only=None) -> DataFrame:
    """A table of all parts without what later tombstones void; ``only`` filters the rows first."""
    known = parts_of(spark, root)
    if not known:
        raise QueryError(f"no index at {root}")
    out = []
    for at, number in enumerate(known):
        rows = spark.read.parquet(f"{root}/part={number}/{name}")
        rows = rows.where(only) if only is not None else rows
        later = known[at + 1 :]
        if later:
            gone = union_all([spark.read.parquet(f"{root}/part={n}/gone") for n in later])
            rows = rows.join(gone, "entity_id", "left_anti")
        out.append(rows)
    return union_all(out)


def postings(spark: SparkSession, root: str, terms: list[str] | None = None) -> DataFrame:
    """Current postings, of the given terms if any: the filter reaches the sorted files."""
    return _merged(spark, root, "postings", None if terms is None else F.col("term").isin(terms))


def lengths(spark: SparkSession, root: str) -> DataFrame:
    return _merged(spark, root, "lengths")


def totals(spark: SparkSession, root: str) -> tuple[int, int]:
    """Rows and tokens of the index, from the parts' statistics alone."""
    told = [_stats(spark, root, n) for n in parts_of(spark, root)]
    return sum(t["rows"] for t in told), sum(t["tokens"] for t in told)


def compact(spark: SparkSession, root: str) -> None:
    """Write base and deltas as one new base; readers of the old parts are not disturbed."""
    number = parts_of(spark, root)[-1] + 1
    path = f"{root}/part={number}"
    se.write_fts_index(postings(spark, root), f"{path}/postings")
    lengths(spark, root).write.mode("overwrite").parquet(f"{path}/lengths")
    rows, tokens = _sizes(spark.read.parquet(f"{path}/lengths"))
    _publish(spark, root, number, None, rows, tokens)


def search_phrase(spark: SparkSession, root: str, query: str, min_score: float = 0.0, limit: int | None = 100) -> DataFrame:
    """The phrase search on the stored index: reads the postings of the phrase's terms and
    the parts' statistics, no text and no lengths of other rows."""
    rows, tokens = totals(spark, root)
    words = list(dict.fromkeys(tx.query_tokens(query)))
    return se.rank_postings(postings(spark, root, words), query, rows, tokens / max(rows, 1), min_score, limit)
