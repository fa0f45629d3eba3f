"""Multi-hop walks over the edge table.

Each hop is one join; ``stable`` cuts the lineage between hops, so a lost
executor costs one hop and the plan does not grow with depth. Frontiers and
layers stay DataFrames; the driver sees only whether a layer is empty.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Catalog, QueryError, union_all
from ..runtime import stable
from .links import column_edges, union_edge_stores
from .temporal import live_edges_at, state_at, temporal_summary_of

WALK_COLUMNS = ("id", "source_id", "target_id", "relationship_type")


def _checked_depth(depth: int) -> int:
    if depth < 1:
        raise QueryError(f"depth must be at least 1, got {depth}")
    return depth


def traverse(
    edges: DataFrame, source_id: Any, relationship_type: str | None = None, max_depth: int = 10
) -> DataFrame:
    """Directed walks from a start: one row per (edge, depth) with their number.

    ``edges`` holds live edges. The first hop obeys ``relationship_type``, later
    hops follow any edge. ``walks`` counts the walks that end with the edge at that
    depth, so a hop joins each distinct end node once however many reach it. The
    walk goes as deep as asked or until no edge leaves the last ends.
    """
    steps = edges.select(*WALK_COLUMNS)
    hop = steps.where(F.col("source_id") == F.lit(source_id))
    if relationship_type is not None:
        hop = hop.where(F.col("relationship_type") == relationship_type)
    hop = hop.withColumn("depth", F.lit(1)).withColumn("walks", F.lit(1).cast("long"))
    levels = []
    for depth in range(1, _checked_depth(max_depth) + 1):
        hop = stable(hop)
        if hop.isEmpty():
            break
        levels.append(hop)
        ends = hop.groupBy(F.col("target_id").alias("source_id")).agg(F.sum("walks").alias("walks"))
        # Written out, the ends are a plain join side: a hot source can be split.
        hop = steps.join(stable(ends), "source_id").select(*WALK_COLUMNS, F.lit(depth + 1).alias("depth"), "walks")
    return union_all(levels) if levels else hop


def walk_rows(counted: DataFrame) -> DataFrame:
    """The walks of :func:`traverse` as rows, one for each walk: the number of rows
    can grow with the power of the depth. Rows repeat in blocks, so that no single
    one expands alone."""
    block = 10_000
    blocks = counted.withColumn(
        "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("walks") - 1, F.lit(block).cast("long")))
    )
    return blocks.withColumn(
        "_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(block).cast("long"), F.col("walks") - F.col("start"))))
    ).select(*WALK_COLUMNS, "depth")


def traverse_as_of(
    log: DataFrame, source_id: Any, as_of: Any, relationship_type: str | None = None, max_depth: int = 10
) -> DataFrame:
    """Walks over the edges live at ``as_of``; the start need not exist."""
    return traverse(stable(live_edges_at(log, as_of)), source_id, relationship_type, max_depth)


@dataclass
class Neighborhood:
    nodes: DataFrame
    edges: DataFrame
    edge_sources: list[str]
    notices: list[str] = field(default_factory=list)


def _ends(edges: DataFrame, from_col: str, to_col: str, near: DataFrame) -> DataFrame:
    keys = near.select(F.col("id").alias("_near"))
    return edges.join(keys, F.col(from_col) == F.col("_near"), "left_semi").select(F.col(to_col).alias("id"))


def all_edges(catalog: Catalog) -> DataFrame:
    """Live link edges and foreign-key edges, not yet distinct."""
    links = catalog.live_edges().select(
        "source_id", "target_id", "relationship_type", F.lit("LINK_TABLE").alias("edge_source")
    )
    if not any(catalog.schema.references(name) for name in catalog.tables):
        return links
    return links.unionByName(column_edges(catalog))


def _distinct_edges(edges: DataFrame) -> DataFrame:
    return union_edge_stores(
        edges.where(F.col("edge_source") == "LINK_TABLE"), edges.where(F.col("edge_source") == "COLUMN")
    )


def _layers(edges: DataFrame, entity_id: Any, depth: int) -> tuple[DataFrame, DataFrame]:
    """``(expanded, seen)`` ids of a breadth-first walk that ignores direction."""
    kind = edges.schema["source_id"].dataType
    seen = edges.sparkSession.createDataFrame([(entity_id,)], f"id {kind.simpleString()}")
    frontier, layers = seen, []
    for _ in range(_checked_depth(depth)):
        layers.append(frontier)
        around = _ends(edges, "source_id", "target_id", frontier).unionByName(
            _ends(edges, "target_id", "source_id", frontier)
        )
        frontier = stable(around.distinct().join(seen, "id", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return union_all(layers), seen


def _met(edges: DataFrame, expanded: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch an expanded id and end in ``nodes`` on both sides."""
    opened, ends = expanded.select(F.col("id").alias("_id")), nodes.select(F.col("id").alias("_end"))
    return (
        edges.join(opened, F.col("source_id") == F.col("_id"), "left_semi")
        .unionByName(edges.join(opened, F.col("target_id") == F.col("_id"), "left_semi"))
        .distinct()
        .join(ends, F.col("source_id") == F.col("_end"), "left_semi")
        .join(ends, F.col("target_id") == F.col("_end"), "left_semi")
    )


def neighbors(catalog: Catalog, entity_id: Any, depth: int = 1, must_live: bool = True) -> Neighborhood:
    """Undirected neighbourhood over link and foreign-key edges, whole.

    Ids must be unique across the catalog's classes. The edges of all stores are
    written once; each layer is a semi join with them and an anti join with what
    was seen. Edges are those met while expanding, both ends live. A start that is
    not live raises; without ``must_live`` the walk leaves it by the edges it still
    has, and gives the live nodes around it.
    """
    live_ids = union_all(
        [catalog.live(n).select("id", F.lit(n).alias("entity_type")) for n in catalog.tables]
    )
    if must_live and live_ids.where(F.col("id") == F.lit(entity_id)).isEmpty():
        raise QueryError(f"{entity_id!r} not found")
    edges = stable(_distinct_edges(all_edges(catalog)))
    expanded, seen = _layers(edges, entity_id, depth)
    nodes = live_ids.join(seen, "id", "left_semi")
    return Neighborhood(nodes, _met(edges, expanded, nodes), ["LINK_TABLE", "COLUMN"])


#: Ids of a layer that go into the scan's filter; a larger layer is joined.
LISTED = 500


def adjacency_rows(catalog: Catalog) -> DataFrame:
    """(node, other, ahead, relationship_type, edge_source): every edge of all stores under either
    end, distinct and sorted by that end; an edge in both stores counts as a link-table edge.

    Ranges run over both ends of an edge, so a hub fills several files instead of one task.
    Equal edges meet in a range and its sort, so the edges move once and none are held to be made distinct.
    """
    ways = F.array(
        *[
            F.struct(F.col(near).alias("node"), F.col(far).alias("other"), F.lit(ahead).alias("ahead"))
            for near, far, ahead in (("source_id", "target_id", True), ("target_id", "source_id", False))
        ]
    )
    both = all_edges(catalog).select("relationship_type", "edge_source", F.inline(ways)).where("ahead OR node <> other")
    equal = Window.partitionBy("node", "other", "ahead", "relationship_type").orderBy(F.col("edge_source").desc())
    return (
        both.repartitionByRange("node", "other")
        .withColumn("_n", F.row_number().over(equal))
        .where("_n = 1")
        .select("node", "other", "ahead", "relationship_type", "edge_source")
        .sortWithinPartitions("node", "other")
    )


def write_adjacency(catalog: Catalog, path: str) -> None:
    """Store the neighbourhood graph for repeated use: :func:`adjacency_rows`, and the live ids
    with their class, sorted by id."""
    adjacency_rows(catalog).write.mode("overwrite").parquet(f"{path}/edges")
    live = union_all([catalog.live(n).select("id", F.lit(n).alias("entity_type")) for n in catalog.tables])
    live.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/nodes")


def _of(table: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is among ``ids(id)``: few ids prune the sorted files, many are joined."""
    few = ids.limit(LISTED + 1).collect()
    if len(few) <= LISTED:
        return table.where(F.col(key).isin([r.id for r in few]))
    return table.join(ids.select(F.col("id").alias(key)), key, "left_semi")


def neighbors_stored(
    spark: SparkSession, path: str, entity_id: Any, depth: int = 1, must_live: bool = True
) -> Neighborhood:
    """:func:`neighbors` on a stored adjacency: a layer reads the files of its nodes only."""
    edges, live = spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/nodes")
    if must_live and live.where(F.col("id") == F.lit(entity_id)).isEmpty():
        raise QueryError(f"{entity_id!r} not found")
    seen = frontier = spark.createDataFrame([(entity_id,)], f"id {live.schema['id'].dataType.simpleString()}")
    met = []
    for _ in range(_checked_depth(depth)):
        met.append(stable(_of(edges, "node", frontier)))
        around = met[-1].select(F.col("other").alias("id")).distinct()
        frontier = stable(around.join(seen, "id", "left_anti"))
        if frontier.isEmpty():
            break
        seen = stable(seen.unionByName(frontier))
    nodes = stable(_of(live, "id", seen))
    end = lambda first, second: F.when(F.col("ahead"), F.col(first)).otherwise(F.col(second))
    rows = union_all(met).select(
        end("node", "other").alias("source_id"), end("other", "node").alias("target_id"), "relationship_type", "edge_source"
    ).distinct()
    for side in ("source_id", "target_id"):
        rows = rows.join(nodes.select(F.col("id").alias(side)), side, "left_semi")
    columns = ["source_id", "target_id", "relationship_type", "edge_source"]
    return Neighborhood(nodes, rows.select(*columns), ["LINK_TABLE", "COLUMN"])


def node_rows(catalog: Catalog, found: Neighborhood, entity_type: str) -> DataFrame:
    """The neighbourhood's entities of a class, with their data and temporal fields."""
    ids = found.nodes.where(F.col("entity_type") == entity_type).select("id")
    rows = catalog.live(entity_type).join(ids, "id", "left_semi")
    if catalog.log is None:
        return rows
    times = temporal_summary_of(catalog.log, ids.select(F.col("id").alias("entity_id")))
    return rows.join(times.withColumnRenamed("entity_id", "id"), "id", "left")


def neighbors_as_of(log: DataFrame, entity_id: Any, as_of: Any, depth: int = 1) -> Neighborhood:
    """Neighbourhood over link edges live at ``as_of``; nodes are states then."""
    edges = stable(live_edges_at(log, as_of).select("source_id", "target_id", "relationship_type"))
    kind = edges.schema["source_id"].dataType
    expanded, seen = _layers(edges, entity_id, depth)
    wanted = seen.select(F.col("id").cast(log.schema["entity_id"].dataType).alias("entity_id"))
    states = state_at(log, as_of).join(wanted, "entity_id", "left_semi")
    nodes = states.select(F.col("entity_id").cast(kind).alias("id"), "state")
    met = _met(edges, expanded, nodes).withColumn("edge_source", F.lit("LINK_TABLE"))
    return Neighborhood(nodes, met, ["LINK_TABLE"], ["as-of neighbourhoods cover link-table edges only"])


def _pointers(entities: DataFrame) -> DataFrame:
    """(id, to) of superseded entities; one that names itself counts as not superseded."""
    return entities.where(F.col("superseded_by").isNotNull() & (F.col("superseded_by") != F.col("id"))).select(
        "id", F.col("superseded_by").alias("to")
    )


def supersession_ends(entities: DataFrame) -> DataFrame:
    """``(id, hops, terminal)``: where the chain of every superseded entity ends.

    Pointer jumping: each round joins the pointers with themselves, so they span twice
    as far, with one row per entity however long its chain. Rounds grow with the logarithm
    of the longest chain. Pointers that still move after spanning as many hops as there
    are entities run in a circle: their hops and terminal are NULL.
    """
    at = stable(_pointers(entities).select("id", "to", F.lit(1).cast("long").alias("hops"), F.lit(True).alias("moved")))
    total, span = at.count(), 1
    while span <= total and not at.where("moved").isEmpty():
        ahead = at.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("hops").alias("more"))
        at = at.join(ahead, "to", "left").select(
            "id", F.coalesce("next", "to").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"),
            F.col("next").isNotNull().alias("moved"),
        )
        at, span = stable(at), 2 * span
    return at.select("id", F.when(~F.col("moved"), F.col("hops")).alias("hops"), F.when(~F.col("moved"), F.col("to")).alias("terminal"))


def supersession_chain(entities: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """``(id, hop, replacement)`` following ``superseded_by`` from each start.

    Every superseded entity is a start by default; then a chain gives as many rows as it
    has suffixes, and :func:`supersession_ends` is the linear answer. A chain stops at the
    first entity that is not superseded, or that it has already met. Only the starts'
    chains are built: what they have met so far is carried over the pointers of one span,
    the pointers double, and so the rounds grow with the logarithm of the longest chain.
    """
    jump = stable(_pointers(entities))
    first = jump.select("id") if starts is None else starts.select("id").distinct()
    kind = entities.schema["superseded_by"].dataType
    met = stable(first.select(F.col("id").alias("start"), F.col("id").cast(kind).alias("node"), F.lit(0).cast("long").alias("hop")))
    span, known = 1, met.count()
    while not jump.isEmpty():
        ahead = jump.select(F.col("id").alias("node"), "to")
        further = met.join(ahead, "node").select("start", F.col("to").alias("node"), (F.col("hop") + span).alias("hop"))
        met = stable(met.unionByName(further).groupBy("start", "node").agg(F.min("hop").alias("hop")))
        grown = met.count()
        if grown == known:  # every chain has ended or come round
            break
        known, span = grown, 2 * span
        jump = stable(jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to")))
    return met.where("hop > 0").select(F.col("start").alias("id"), F.col("hop").cast("int").alias("hop"), F.col("node").alias("replacement"))
