"""Readers of record files, nested documents, SQL sources and stanza files.

Every reader keeps malformed input as rows of an error DataFrame instead of
failing or dropping it.
"""

from __future__ import annotations

import datetime as dt
import re
from typing import Any, Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import iso_to_utc
from ..model import QueryError, Schema
from ..operators.read import dispatch_by_type
from . import ranges
from .ranges import array_elements, csv_texts

# its Python passes then need no package on the executors
cloudpickle.register_pickle_by_value(ranges)

CORRUPT = "_corrupt_record"

# Statements a read-only query may not contain.
WRITE_KEYWORDS = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE")


def read_csv_records(
    spark: SparkSession, path: str, columns: list[str] | None = None, header: bool = True, multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """CSV records, every value a string. Returns (records, errors).

    Each file may start with a header of its own, which alone is dropped; quoted
    values may hold line breaks. Records with too many or too few fields go to
    ``errors`` with their text. Only the header comes to the driver, for the column
    names. Files split in either case: with ``multi_line`` records are cut in a second
    pass (:mod:`.ranges`); without it one pass is enough, and a line break ends a record.
    """
    source = spark.read.option("header", header)
    if columns is None:
        columns = source.csv(path).columns
    fields = ", ".join(f"`{c}` STRING" for c in [*columns, CORRUPT])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    if multi_line:
        told = csv_texts(spark, path, header).select("record", F.from_csv("record", fields, options).alias("r"))
        good = told.where(F.col(f"r.{CORRUPT}").isNull()).select(*[F.col(f"r.`{c}`") for c in columns])
        bad = told.where(F.col(f"r.{CORRUPT}").isNotNull())
        return good, bad.select("record", F.lit("malformed row").alias("error"))
    parsed = source.schema(fields).options(**options).option("columnPruning", False).csv(path)
    # Spark refuses a scan of the broken records alone, so each plan reads a value as well.
    read = F.length(F.coalesce(F.col(f"`{columns[0]}`"), F.lit(""))) >= 0 if columns else F.lit(True)
    good = parsed.where(F.col(CORRUPT).isNull() & read).select(*[F.col(f"`{c}`") for c in columns])
    bad = parsed.where(F.col(CORRUPT).isNotNull() & read).select(
        F.col(CORRUPT).alias("record"), F.lit("malformed row").alias("error")
    )
    return good, bad


def _objects(items: DataFrame, schema: T.StructType | None) -> tuple[DataFrame, DataFrame]:
    """Split ``items(line, position)`` of JSON text into objects and errors.

    Validity is judged by the JSON parser itself, typed by a leading brace.
    """
    text = F.trim("line")
    parsed = items.withColumn("_doc", F.try_parse_json(text))
    is_object = F.startswith(text, F.lit("{"))
    error = F.when(F.col("_doc").isNull(), "invalid JSON").when(~is_object, "not an object")
    judged = parsed.withColumn("error", error)
    good = judged.where(F.col("error").isNull()).select("position", F.col("line").alias("json"))
    if schema is not None:
        good = good.select("position", F.from_json("json", schema).alias("r")).select("position", "r.*")
    bad = judged.where(F.col("error").isNotNull()).select("position", F.col("line").alias("record"), "error")
    return good, bad


def number_lines(lines: DataFrame) -> DataFrame:
    """1-based ``position`` of each scanned line, in scan order.

    Counts per split give each split its offset: one row per split is summed and
    joined back, the lines themselves are not sorted.
    """
    placed = lines.withColumn("_split", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    counts = placed.groupBy("_split").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_split", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return placed.join(offsets, "_split").select(
        "line", (F.col("_offset") + F.col("_row") - F.col("_first") + 1).alias("position")
    )


def read_jsonl(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    id_field: str | None = None,
    line_numbers: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """One object per line; blank lines skipped. Returns (records, errors).

    ``position`` orders lines; with ``line_numbers`` it is the 1-based number of
    the line in its folder, which costs one pass to count lines per split.
    """
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    if line_numbers:
        lines = number_lines(lines)
    else:
        lines = lines.withColumn("position", F.monotonically_increasing_id())
    lines = lines.where(F.trim("line") != "")
    good, bad = _objects(lines, schema)
    if id_field is not None:
        value = F.col(id_field) if schema is not None else F.get_json_object("json", f"$.{id_field}")
        text = F.to_json(F.struct(*good.columns)) if schema is not None else F.col("json")
        missing = good.where(value.isNull()).select(
            "position", text.alias("record"), F.lit(f"missing {id_field}").alias("error")
        )
        good, bad = good.where(value.isNotNull()), bad.unionByName(missing)
    return good, bad


def read_json_array(
    spark: SparkSession, path: str, schema: T.StructType | None = None, whole_files: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Documents that each hold a JSON array of objects. Returns (records, errors).

    A document is a file, which is divided among tasks (:mod:`.ranges`), or a line when
    ``whole_files`` is off. Elements that are not objects become errors; any other top
    level raises. ``position`` counts within a document.
    """
    if whole_files:
        return _objects(array_elements(spark, path).select("position", "line"), schema)
    docs = spark.read.text(path)
    # An empty folder has nothing to refuse; a scalar or object top level does.
    other = docs.where(~F.startswith(F.ltrim("value"), F.lit("["))).head(1)
    if other:
        raise QueryError("a JSON source must hold an array of objects")
    broken = docs.where(F.try_parse_json("value").isNull()).head(1)
    if broken:
        raise QueryError("a JSON source cannot be parsed")
    items = docs.select(F.posexplode(F.from_json("value", "array<string>")).alias("position", "line"))
    return _objects(items.where(F.col("line").isNotNull()), schema)


def extract_json_path(df: DataFrame, column: str, path: str, element: str = "string") -> DataFrame:
    """Records at a JSON path: arrays explode, a single value gives one row.

    The parsed type decides, not the text: a string may begin with a bracket. A
    path with ``[*]`` names many values and always explodes.
    """
    found = F.get_json_object(F.col(column), path)
    many = F.from_json(found, f"array<{element}>")
    one = F.array(found if element == "string" else F.from_json(found, element))
    if "*" in path:
        listed = F.startswith(F.ltrim(found), F.lit("["))
    else:
        value = F.try_variant_get(F.try_parse_json(F.col(column)), path, "variant")
        listed = F.startswith(F.schema_of_variant(value), F.lit("ARRAY"))
    items = F.when(listed, many).when(found.isNotNull(), one)
    keep = [c for c in df.columns if c != column]
    return df.select(*keep, F.posexplode(items).alias("position", "record"))


def check_read_only(query: str) -> str:
    """Refuse a query that holds a write keyword anywhere, even in a literal."""
    for word in WRITE_KEYWORDS:
        if re.search(rf"\b{word}\b", query, flags=re.I):
            raise QueryError(f"{word} is not allowed in a read-only query")
    return query


def bind_since(query: str, since: Any) -> str:
    """Replace ``:since`` by a timestamp literal that was parsed, never pasted."""
    if ":since" not in query:
        return query
    mark = iso_to_utc(since) if since is not None else dt.datetime(1970, 1, 1)
    if mark is None:
        raise QueryError(f"not an ISO-8601 timestamp: {since!r}")
    return re.sub(r":since\b", f"TIMESTAMP '{mark.isoformat(sep=' ')}'", query)


def read_sql_query(
    spark: SparkSession,
    query: str,
    url: str | None = None,
    since: Any = None,
    options: dict[str, str] | None = None,
    partition: tuple[str, Any, Any, int] | None = None,
) -> DataFrame:
    """A read-only SELECT on a JDBC database, or on the session's own catalog
    when there is no ``url``.

    ``partition`` is (column, lower, upper, splits): the query then runs as that
    many range-restricted reads in parallel.
    """
    text = bind_since(check_read_only(query), since)
    if url is None:
        return spark.sql(text)
    reader = spark.read.format("jdbc").option("url", url)
    for name, value in (options or {}).items():
        reader = reader.option(name, value)
    if partition is None:
        return reader.option("query", text).load()
    column, lower, upper, splits = partition
    return (
        reader.option("dbtable", f"({text}) source_rows")
        .option("partitionColumn", column)
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", splits)
        .load()
    )


def read_bundle(
    spark: SparkSession, path: str, schema: Schema, collections: dict[str, str], kinds: dict[str, T.StructType],
    multi_line: bool = True,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Bundle documents keyed by collection name -> one DataFrame per class.

    ``collections`` maps a key to its base class, ``kinds`` to the record type.
    Rows are dispatched to the concrete class they name; the rest are errors.
    """
    shape = T.StructType([T.StructField(k, T.ArrayType(kinds[k])) for k in collections])
    docs = spark.read.schema(shape).option("multiLine", multi_line).json(path)
    tables: dict[str, DataFrame] = {}
    errors = None
    for key, base in collections.items():
        rows = docs.select(F.explode(key).alias("r")).select("r.*")
        if schema.type(base).designator is None:
            tables[base] = rows
            continue
        parts, bad = dispatch_by_type(rows, schema, base)
        tables.update(parts)
        told = bad.select(F.lit(base).alias("collection"), F.col("id").cast("string").alias("id"), "error")
        errors = told if errors is None else errors.unionByName(told)
    if errors is None:
        errors = spark.createDataFrame([], "collection string, id string, error string")
    return tables, errors


def read_stanzas(spark: SparkSession, path: str) -> DataFrame:
    """``[Term]`` stanzas -> (id, name, def); obsolete terms dropped.

    The reader itself splits at stanza heads, so big files are divided among
    tasks. A stanza ends where another ``[Kind]`` head starts.
    """
    raw = spark.read.option("lineSep", "[Term]\n").text(path)
    body = raw.select(F.regexp_extract("value", r"(?s)^(.*?)(?:\n\[[A-Za-z]+\]\s*\n.*)?$", 1).alias("body"))

    def field(name: str) -> Column:
        return F.regexp_extract(F.concat(F.lit("\n"), F.col("body")), rf"\n{name}: *([^\n]*)", 1)

    definition = field("def")
    quoted = F.regexp_extract(definition, r'^"((?:[^"\\]|\\.)*)"', 1)
    return (
        body.where(field("id") != "")
        .where(F.lower(F.trim(field("is_obsolete"))) != "true")
        .select(
            F.trim(field("id")).alias("id"),
            F.trim(field("name")).alias("name"),
            F.when(quoted != "", quoted).otherwise(definition).alias("def"),
        )
    )


def verify_file_digest(files: DataFrame, manifest: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Compare ``files(path, content)`` with ``manifest(path, sha256)``.

    ``files`` comes from ``spark.read.format("binaryFile")``. Files the manifest
    misses and manifest entries without file fail as well. Content fetched more than
    once from a path is told apart by further ``keys`` of both sides, ``path`` among them.
    """
    found = files.select(*keys, F.sha2("content", 256).alias("actual"))
    return found.join(manifest, list(keys), "full_outer").select(
        *keys, "actual", F.col("sha256").alias("expected"),
        F.coalesce(F.lower("sha256") == F.col("actual"), F.lit(False)).alias("matches"),
    )


def require_digests(files: DataFrame, manifest: DataFrame) -> None:
    bad = verify_file_digest(files, manifest).where(~F.col("matches")).head(1)
    if bad:
        raise QueryError(f"digest mismatch: {bad[0]['path']}")


def map_fields(
    df: DataFrame,
    field_map: dict[str, str] | None = None,
    vocabulary: dict[str, dict[str, Any]] | None = None,
    vocabulary_tables: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Rename columns, then normalise values; unknown values stay.

    Small vocabularies are literal maps. A vocabulary given as a DataFrame
    ``(term, standard)`` joins, and Spark picks the strategy by its size.
    """
    out = df.withColumnsRenamed(field_map or {})
    for name, terms in (vocabulary or {}).items():
        pairs = F.create_map(*[F.lit(x) for pair in terms.items() for x in pair])
        out = out.withColumn(name, F.coalesce(pairs[F.col(name)], F.col(name)))
    for name, table in (vocabulary_tables or {}).items():
        terms = table.groupBy(F.col("term").alias("_term")).agg(F.min("standard").alias("_standard"))
        out = (
            out.join(terms, F.col(name) == F.col("_term"), "left")
            .withColumn(name, F.coalesce("_standard", name))
            .drop("_term", "_standard")
        )
    return out


Loader = Callable[[Any], DataFrame]
