"""A folder layout for the five tables, published one commit at a time.

``entities/<class>/v=<n>`` are whole snapshots, ``log/v=<n>`` and ``write_log/v=<n>``
what commit ``n`` adds. Edges and external ids are a snapshot and what later commits
added to it (``edges/v=<n>``, ``edges/add=<n>``). A commit writes all its tables under
one number and then its manifest, which names the folders that are current; readers
go by the newest complete manifest. So a job never overwrites what it reads, and one
that stops half way changes nothing.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Catalog, QueryError, Schema, union_all
from ..operators.mutate import WriteSet
from .sinks import append_provenance

#: Folders of additions after which a commit writes a table anew.
MOST_PARTS = 16


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete snapshot numbers below ``path``, ascending."""
    hadoop, fs = _file_system(spark, path)
    if not fs.exists(hadoop):
        return []
    found = []
    for status in fs.listStatus(hadoop):
        match = re.fullmatch(r"v=(\d+)", status.getPath().getName())
        done, _ = _file_system(spark, f"{path}/{status.getPath().getName()}/_SUCCESS")
        if match and fs.exists(done):
            found.append(int(match.group(1)))
    return sorted(found)


def _manifest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """Number and content of the newest commit; 0 and nothing before the first."""
    known = versions(spark, f"{root}/manifest")
    if not known:
        return 0, {}
    (line,) = spark.read.text(f"{root}/manifest/v={known[-1]}").collect()
    return known[-1], json.loads(line[0])


def _current(spark: SparkSession, root: str, current: dict, name: str) -> DataFrame | None:
    """A table from its snapshot and what was added to it."""
    folders = [f if isinstance(f, str) else f"v={f}" for f in current.get(name, [])]
    return union_all([spark.read.parquet(f"{root}/{name}/{f}") for f in folders]) if folders else None


def load_catalog(spark: SparkSession, root: str, schema: Schema) -> Catalog:
    """The catalog as the last commit left it."""
    _, current = _manifest(spark, root)

    def read(name: str) -> DataFrame | None:
        return _current(spark, root, current, name)

    def parts(name: str) -> DataFrame | None:
        numbers = current.get(name)
        if not numbers:
            return None
        found = spark.read.option("basePath", f"{root}/{name}").parquet(*[f"{root}/{name}/v={n}" for n in numbers])
        return found.drop("v")

    tables = {k.name: read(f"entities/{k.name}") for k in schema.types if not k.abstract}
    return Catalog(
        schema,
        {name: df for name, df in tables.items() if df is not None},
        edges=read("edges"),
        log=parts("log"),
        external_ids=read("external_ids"),
        write_log=parts("write_log"),
    )


def stream_mark(spark: SparkSession, root: str, stream: str) -> int:
    """The last batch of a stream that was committed; -1 before the first."""
    return _manifest(spark, root)[1].get("streams", {}).get(stream, -1)


def commit(
    root: str, sets: dict[str, WriteSet], write_log: DataFrame | None = None, mark: tuple[str, int] | None = None
) -> int:
    """Write what a job returned as one commit and publish it; returns its number.

    ``mark`` is a stream's name and the batch this commit holds; it is published with
    the commit, so :func:`stream_mark` tells whether a replayed batch is there already.

    The keys of ``sets`` name entity classes; a set without ``entities`` may have any
    name. Additions go beside the current table, whole tables take its place. Validate
    before calling.
    """
    if not sets:
        raise QueryError("nothing to commit")
    frames = [
        df for out in sets.values()
        for df in (out.entities, out.edges, out.external_ids, out.new_edges, out.new_mappings, out.log) if df is not None
    ]
    spark = frames[0].sparkSession
    last, current = _manifest(spark, root)
    number = last + 1

    def snapshot(name: str, df: DataFrame | None) -> None:
        if df is not None:
            df.write.mode("overwrite").parquet(f"{root}/{name}/v={number}")
            current[name] = [number]

    def add(name: str, parts: list[DataFrame]) -> None:
        if not parts:
            return
        stored = _current(spark, root, current, name)
        rows = union_all(parts)
        if stored is not None:  # ids keep the stored table's types
            rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in stored.schema.fields])
        rows.write.mode("overwrite").parquet(f"{root}/{name}/add={number}")
        current[name] = [*current.get(name, []), f"add={number}"]
        if len(current[name]) > MOST_PARTS:
            snapshot(name, _current(spark, root, current, name))

    for name, out in sets.items():
        snapshot(f"entities/{name}", out.entities)
    # of several whole tables in one commit, each was made from the one before
    for name in ("edges", "external_ids"):
        whole = [df for out in sets.values() if (df := getattr(out, name)) is not None]
        snapshot(name, whole[-1] if whole else None)
    add("edges", [out.new_edges for out in sets.values() if out.new_edges is not None])
    add("external_ids", [out.new_mappings for out in sets.values() if out.new_mappings is not None])
    logs = [out.log for out in sets.values() if out.log is not None]
    if logs:
        # an attempt that stopped may have left a part under this number
        append_provenance(union_all(logs), f"{root}/log/v={number}", mode="overwrite")
        current["log"] = [*current.get("log", []), number]
    if write_log is not None:
        write_log.write.mode("overwrite").parquet(f"{root}/write_log/v={number}")
        current["write_log"] = [*current.get("write_log", []), number]
    if mark is not None:
        current["streams"] = {**current.get("streams", {}), mark[0]: mark[1]}
    published = spark.createDataFrame([(json.dumps(current),)], "value string").coalesce(1)
    published.write.mode("overwrite").text(f"{root}/manifest/v={number}")
    return number
