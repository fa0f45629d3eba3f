"""Large single files of CSV records or JSON arrays, divided among tasks.

Spark's text reader cuts a file into splits at a separator (a line end, a closing
brace). What a separator means depends on all text before it: it may stand within
quotes or within nested values. So a first pass tells what every split does to that
state, whichever it begins with; prefix sums over one row per split give the state
each begins with; a second pass cuts records. Only pieces of records that lie in
several splits are grouped, by their first split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import QueryError
from ..runtime import scratch_path

#: What a piece is: a whole record, or the end, the beginning, the middle of one.
WHOLE, END, BEGIN, MIDDLE = range(4)
PIECES = "file string, block bigint, number bigint, kind int, record string"

_CLOSE = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
_ESCAPE = re.compile(r"\\.", re.S)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[\[\]{},]', re.S)
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*(?:"|\\?\Z)', re.S)


def _chunks(spark: SparkSession, path: str, separator: str) -> DataFrame:
    raw = spark.read.option("lineSep", separator).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value")
    )


def _written(df: DataFrame, label: str) -> DataFrame:
    """What a Python pass gave, kept in the shared folder: it is read more than once."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str], dict]]:
    """Texts of consecutive rows of one split, with the batch's first row of each run."""
    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        values, start = batch.column("value").to_pylist(), 0
        for i in range(1, len(files) + 1):
            if i == len(files) or (files[i], blocks[i]) != (files[start], blocks[start]):
                row = {c: batch.column(c)[start].as_py() for c in batch.schema.names if c != "value"}
                yield (files[start], blocks[start]), values[start:i], row
                start = i


def _before(by: str) -> Column:
    window = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(by).over(window), F.lit(0))


def quoted_after(line: str, quoted: bool, delimiter: str = ",") -> bool:
    """Whether the text after ``line`` is still within quotes.

    A quote opens at the start of a value only; the next one without a backslash closes
    it, and what follows belongs to the value up to the delimiter, as Spark reads it.
    """
    at = 0
    while True:
        if not quoted:
            if line[at : at + 1] != '"':
                found = line.find(delimiter + '"', at)
                if found < 0:
                    return False
                at = found + 1
            at += 1
        end = _CLOSE.match(line, at)
        if end is None:
            return True
        at = line.find(delimiter, end.end()) + 1
        if at == 0:
            return False
        quoted = False


def csv_texts(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(record): the CSV records of files, as they stand; quoted values may hold line breaks.

    A record ends with a line feed outside quotes, with or without a carriage return.
    ``header`` drops the first record of every file. Blank lines are no records.
    """
    lines = _chunks(spark, path, "\n")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[tuple[str, int], tuple[bool, bool]] = {}
        for split, values, _ in _runs(batches):
            plain, quoted = ends.get(split, (False, True))
            for value in values:
                plain, quoted = quoted_after(value, plain), quoted_after(value, quoted)
            ends[split] = plain, quoted
        yield pa.RecordBatch.from_pylist(
            [{"file": f, "block": b, "plain": int(p), "quoted": int(q)} for (f, b), (p, q) in ends.items()],
            pa.schema([("file", pa.string()), ("block", pa.int64()), ("plain", pa.int32()), ("quoted", pa.int32())]),
        )

    # lines without quotes change nothing
    ends = lines.where(F.contains("value", F.lit('"')))
    ends = _written(ends.mapInArrow(follow, "file string, block bigint, plain int, quoted int"), "csv-splits")
    splits = _written(lines.select("file", "block").distinct(), "csv-blocks").join(ends, ["file", "block"], "left")
    # a split keeps the state, turns it, or forgets it: the last that forgot, and the turns since, tell
    splits = splits.fillna({"plain": 0, "quoted": 1})
    turns = splits.withColumn("turn", F.when((F.col("plain") == 1) & (F.col("quoted") == 0), 1).otherwise(0))
    turns = turns.withColumn("turned", _before("turn"))
    known = F.when(F.col("plain") == F.col("quoted"), (F.col("plain") + F.col("turned")) % 2)
    after = Window.partitionBy("file").orderBy("block")
    state = (F.coalesce(F.last(known, ignorenulls=True).over(after), F.lit(0)) + F.col("turned") + F.col("turn")) % 2
    states = turns.select("file", "block", state.alias("state"))
    inside = states.select("file", "block", (F.lag("state", 1, 0).over(after) == 1).alias("quoted")).where("quoted")
    # at most a row per split, so its size is bounded by the number of splits
    lines = lines.join(F.broadcast(inside), ["file", "block"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Pieces()
        for split, values, row in _runs(batches):
            if cutter.at(split):
                cutter.begin(row["quoted"] or False, quoted=row["quoted"] or False)
            quoted = cutter.state["quoted"]
            for value in values:
                if not quoted and not value.rstrip("\r"):
                    continue
                quoted = quoted_after(value, quoted) if '"' in value else quoted
                cutter.held.append(value + "\n" if quoted else value)
                if not quoted:
                    cutter.close()
            cutter.state["quoted"] = quoted
            yield cutter.told()
        cutter.end()
        yield cutter.told()

    records = _joined(_written(lines.mapInArrow(cut, PIECES), "csv-pieces"))
    text = F.rtrim("record", F.lit("\r"))
    # the first record of a file begins at its first byte
    kept = records.where(~((F.col("block") == 0) & (F.col("number") == 0))) if header else records
    return kept.select(text.alias("record")).where(F.trim("record") != "")


class _Pieces:
    """Records of the splits of one task, in the order of their text."""

    def __init__(self):
        self.split, self.held, self.rows, self.state = None, [], [], {}

    def at(self, split: tuple[str, int]) -> bool:
        """Whether ``split`` is another than before, which then has ended."""
        if split == self.split:
            return False
        self.end()
        self.split = split
        return True

    def begin(self, within: bool, **state) -> None:
        self.number, self.within, self.state = 0, within, state

    def close(self, text: str | None = None) -> None:
        """The held text is a record, or the end of one that began in an earlier split."""
        self._tell(END if self.within else WHOLE, "".join(self.held) if text is None else text)
        self.within, self.held = False, []

    def end(self) -> None:
        if self.split is not None and (self.held or self.within):
            self._tell(MIDDLE if self.within else BEGIN, "".join(self.held))
        self.held = []

    def _tell(self, kind: int, text: str) -> None:
        self.rows.append((*self.split, self.number, kind, text))
        self.number += 1

    def told(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 5
        self.rows = []
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        names = ["file", "block", "number", "kind", "record"]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def _joined(pieces: DataFrame) -> DataFrame:
    """(file, block, number, record): pieces of a record put together under its first.

    The order of pieces is told on narrow rows, at most two of each split.
    """
    parts = pieces.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("block", "number")
    begun = F.max(F.when(F.col("kind") == BEGIN, F.struct("block", "number"))).over(order)
    named = parts.select("file", "block", "number", begun.alias("first"))
    grouped = parts.join(named, ["file", "block", "number"]).groupBy("file", "first").agg(
        F.array_sort(F.collect_list(F.struct("block", "number", "record"))).alias("parts")
    )
    whole = F.array_join(F.transform("parts", lambda p: p["record"]), "")
    lone = F.get("parts", 0)
    first = F.coalesce("first", F.struct(lone["block"].alias("block"), lone["number"].alias("number")))
    spread = grouped.select("file", first["block"].alias("block"), first["number"].alias("number"), whole.alias("record"))
    return pieces.where(F.col("kind") == WHOLE).drop("kind").unionByName(spread)


def _depth_after(text: str, quoted: bool) -> tuple[int, bool]:
    """What a text adds to the depth of brackets, and whether a string is open after it."""
    parts = (_ESCAPE.sub("", text) if "\\" in text else text).split('"')
    plain = "".join(parts[1::2] if quoted else parts[::2])
    added = plain.count("[") + plain.count("{") - plain.count("]") - plain.count("}")
    return added, quoted ^ (len(parts) % 2 == 0)


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, line): the elements of JSON arrays, one array per file, as text.

    A file is cut at closing braces, wherever its line breaks are. ``position`` counts
    within a file from 0. A file that holds no array, or whose brackets do not close,
    raises :class:`QueryError`. An element that is missing (a comma too many) comes as ",",
    text after the array as an element with a bracket before it: both are no JSON.
    """
    chunks = _chunks(spark, path, "}")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits: dict[tuple[str, int], list] = {}
        for split, values, _ in _runs(batches):
            # depth and string state if the split begins outside a string, and inside
            seen = splits.setdefault(split, [0, False, 0, True, values[0].lstrip()[:1]])
            text = "}".join(values) + "}"
            for i in (0, 2):
                added, seen[i + 1] = _depth_after(text, seen[i + 1])
                seen[i] += added
        yield pa.RecordBatch.from_pylist(
            [
                {"file": f, "block": b, "plain": p, "turn": int(turn), "quoted": q, "head": head}
                for (f, b), (p, turn, q, _, head) in splits.items()
            ],
            pa.schema(
                [("file", pa.string()), ("block", pa.int64()), ("plain", pa.int64()), ("turn", pa.int64()), ("quoted", pa.int64()), ("head", pa.string())]
            ),
        )

    shape = "file string, block bigint, plain bigint, turn bigint, quoted bigint, head string"
    splits = _written(chunks.mapInArrow(follow, shape), "json-splits")
    turned = splits.withColumn("inside", _before("turn") % 2 == 1)
    moved = turned.withColumn("added", F.when(F.col("inside"), F.col("quoted")).otherwise(F.col("plain")))
    # the last chunk of a file has no brace after it; that one too many gives -1 for a closed array
    total = moved.groupBy("file").agg(
        F.sum("added").alias("depth"), (F.sum("turn") % 2).alias("open"), F.min_by("head", "block").alias("head")
    )
    if total.where(F.col("head") != "[").head(1):
        raise QueryError("a JSON source must hold an array of objects")
    if total.where((F.col("depth") != -1) | (F.col("open") != 0)).head(1):
        raise QueryError("a JSON source cannot be parsed")
    entry = moved.select("file", "block", "inside", _before("added").alias("depth"))
    # most splits begin between elements; of the others there is at most a row per split
    entry = entry.where(F.col("inside") | (F.col("depth") != 1))
    chunks = chunks.join(F.broadcast(entry), ["file", "block"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Pieces()
        for split, values, row in _runs(batches):
            if cutter.at(split):
                depth = 1 if row["depth"] is None else row["depth"]
                cutter.begin(depth > 0, depth=depth, quoted=row["inside"] or False, comma=False, shut=row["block"] > 0)
            _cut_elements("}".join(values) + "}", cutter)
            yield cutter.told()
        cutter.end()
        yield cutter.told()

    pieces = _joined(_written(chunks.mapInArrow(cut, PIECES), "json-pieces"))
    line = F.btrim("record", F.lit(" \t\r\n"))
    counts = pieces.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("number").alias("least"))
    counts = counts.select("file", "block", _before("n").alias("before"), "least")
    placed = pieces.join(counts, ["file", "block"])
    position = F.col("before") + F.col("number") - F.col("least")
    return placed.select("file", position.alias("position"), line.alias("line"))


def _cut_elements(text: str, cutter: _Pieces) -> None:
    """Cut a text at the commas of the outermost array; ``cutter`` carries the state."""
    state = cutter.state
    at = start = 0
    if state["quoted"]:
        at = _STRING_END.match(text).end()
        state["quoted"] = at == len(text) and _depth_after(text, True)[1]
    depth = state["depth"]
    for token in _TOKEN.finditer(text, at):
        mark = token.group()[0]
        if mark == '"':
            if token.end() == len(text):
                state["quoted"] = _depth_after(token.group(), False)[1]
        elif mark in "[{":
            depth += 1
            if depth == 1:
                if state["shut"]:
                    cutter.close("]" + text[start : token.start()])
                start = token.end()
        elif mark in "]}":
            depth -= 1
            if depth == 0:
                cutter.held.append(text[start : token.start()])
                _close_element(cutter, last=True)
                state["shut"] = True
                start = token.end()
            elif depth < 0:
                # the brace after the last chunk; before it only space may stand
                if text[start : token.start()].strip():
                    cutter.close("]" + text[start : token.start()])
                start = len(text)
        elif depth == 1:
            cutter.held.append(text[start : token.start()])
            _close_element(cutter, last=False)
            state["comma"] = True
            start = token.end()
    state["depth"] = depth
    if depth > 0 and start < len(text):
        cutter.held.append(text[start:])


def _close_element(cutter: _Pieces, last: bool) -> None:
    text = "".join(cutter.held)
    if text.strip() or cutter.within:
        cutter.close(text)
    elif not last or cutter.state["comma"]:
        cutter.close(",")
    cutter.held = []
