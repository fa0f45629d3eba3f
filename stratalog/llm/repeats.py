"""Substring dedup: repeated paragraphs, lines and sentences by global digests."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pinned, slices

#: Words from which a sentence, a run of sentences or a paragraph counts; shorter sentences join their neighbours.
LEAST_WORDS = 8
LAST = (1 << 63) - 1

_LINE = re.compile(r"[^\n]+")
_SENTENCE = re.compile(r"\S[^\n]*?(?:[.!?]+(?=\s|$)|[。！？]+|$)", re.M)


def _joined(sizes: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """(first, last) of the shortest runs that are long enough, from every sentence on and up
    to every sentence. ``sizes`` holds words and characters. Runs do not depend on what
    stands outside of them, so a passage has the same ones wherever it begins."""
    runs = set()
    for step in (1, -1):
        order = range(len(sizes)) if step > 0 else range(len(sizes) - 1, -1, -1)
        ahead, words, characters, waiting = 0, 0, 0, list(order)
        for at, i in enumerate(waiting):
            while ahead < len(waiting) and words < least and characters < 8 * least:
                words += sizes[waiting[ahead]][0]
                characters += sizes[waiting[ahead]][1]
                ahead += 1
            if words < least and characters < 8 * least:
                break
            runs.add((min(i, waiting[ahead - 1]), max(i, waiting[ahead - 1])))
            words -= sizes[i][0]
            characters -= sizes[i][1]
    return sorted(runs)


def units(text: str | None, least: int = LEAST_WORDS, least_line: int | None = None) -> list[tuple[str, int, int, int, str]]:
    """(level, start, end, words, normalised) of the paragraphs and lines of a text and of the sentences in them.

    Offsets are characters of the text, by which the units are ordered. Normalised: lower
    case, white space single. Paragraphs are lines between blank ones; one of a single line
    counts as a line only, and so does a line that is one sentence. Sentences are the
    shortest runs within a line that reach ``least`` words (or eight times as many
    characters), from each sentence on and up to each: a long sentence is a run of its own,
    a short one joins its neighbours. Lines count from ``least_line`` words on (as ``least``
    if not given).
    """
    text, out = text or "", []

    def add(level: str, start: int, end: int, few: int) -> None:
        words = text[start:end].lower().split()
        body = " ".join(words)
        if words and (len(words) >= few or len(body) >= 8 * few):
            out.append((level, start, end, len(words), body))

    lines = list(_LINE.finditer(text))
    block: list[re.Match] = []
    for line in [*lines, None]:
        if line and not line.group().isspace() and (not block or block[-1].end() + 1 == line.start()):
            block.append(line)
            continue
        if len(block) > 1:
            add("paragraph", block[0].start(), block[-1].end(), least)
        block = [line] if line and not line.group().isspace() else []
    for line in lines:
        add("line", *line.span(), least if least_line is None else least_line)
        parts = [s.span() for s in _SENTENCE.finditer(text, *line.span())]
        if len(parts) > 1:
            for i, j in _joined([(len(text[a:b].split()), b - a) for a, b in parts], least):
                if j - i + 1 < len(parts):
                    add("sentence", parts[i][0], parts[j][1], least)
    return sorted(out, key=lambda u: (u[1], u[0]))


def _units_of(docs: DataFrame, least: int, least_line: int | None) -> DataFrame:
    """A row per unit: digest in two halves, first of its text (or overlapping that one) or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import struct
        from hashlib import blake2b

        names = ["doc_id", "text_key", "level", "start", "end", "n_words", "first_here", "d0", "d1"]
        for batch in slices(batches, 256):
            rows: list[tuple] = []
            for doc, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text"))):
                met: dict[bytes, int] = {}
                for level, start, end, n, body in units(text, least, least_line):
                    digest = blake2b(body.encode("utf-8", "replace"), digest_size=16).digest()
                    rows.append((doc, key, level, start, end, n, start < met.setdefault(digest, end), *struct.unpack("<qq", digest)))
            columns = list(zip(*rows)) if rows else [()] * len(names)
            types = [batch.column("doc_id").type, pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        run,
        f"doc_id {kind}, text_key bigint, level string, start int, end int, n_words int, first_here boolean, d0 bigint, d1 bigint",
    )


def repeated_units(docs: DataFrame, least: int = LEAST_WORDS, least_line: int | None = None) -> DataFrame:
    """The units to remove: (doc_id, level, start, end, n_words, digest, keeper, text_key).

    A unit is a line of at least ``least_line`` words (1: every line that is not blank;
    as ``least`` if not given), or a paragraph of several lines or a run of sentences within
    a line of at least ``least`` words, see ``units``; its digest (128 bits of its
    normalised words, so a line equals the same sentence elsewhere, and a paragraph the same
    words broken otherwise) is grouped over all documents. The occurrence in the document of
    smallest id stays, the first one in its text, and with it those that overlap it there;
    ``keeper`` is that id. Offsets are characters of the original text. A sentence of a
    removed line is listed as well.

    Digests are counted with partial sums and written before they meet the units
    again, so a line with a third of all rows is split by skew handling.

    * Null or empty text: no units. Null id: after all others.
    * Repeated ids: equal rank, each keeps its first occurrence.
    * Very long texts: whole; a text without line ends is one line and its sentences.
    * Empty table: no rows. Other columns are not read.
    """
    cut = pinned(_units_of(docs, least, least_line).withColumn("rank_", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))), "units")
    again = pinned(
        cut.groupBy("d0", "d1")
        .agg(F.min("rank_").alias("first_"), F.count("*").alias("n_"))
        .filter("n_ > 1")
        .select("d0", "d1", "first_"),
        "repeats",
    )
    kept = (F.col("rank_") == F.col("first_")) & F.col("first_here")
    return cut.join(again, ["d0", "d1"]).filter(~kept).select(
        "doc_id", "level", "start", "end", "n_words",
        F.concat(F.lpad(F.lower(F.hex("d0")), 16, "0"), F.lpad(F.lower(F.hex("d1")), 16, "0")).alias("digest"),
        F.nullif("first_", F.lit(LAST)).alias("keeper"),
        "text_key",
    )


def remove_units(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs`` with the listed spans cut out of ``text``; rows and other columns stay.

    Spans are gathered per (doc_id, digest of the text), which a text bounds. Lines
    emptied this way go with their line end.
    """
    spans = removed.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = pinned(spans.select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_"), "spans"), "spans")

    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for texts, lists in batches:
            out = []
            for text, pieces in zip(texts, lists):
                if text is None or pieces is None or not len(pieces):
                    out.append(text)
                    continue
                at, parts = 0, []
                for p in sorted((p["start"], p["end"]) for p in pieces):
                    if p[0] > at:
                        parts.append(text[at : p[0]])
                    at = max(at, p[1])
                parts.append(text[at:])
                out.append(re.sub(r"\n[ \t]*(?=\n)", "", "".join(parts)).strip("\n"))
            yield pd.Series(out, dtype=object)

    row = docs.select(F.struct(*docs.columns).alias("row_"))
    joined = row.join(
        spans, F.col("row_.doc_id").eqNullSafe(F.col("id_")) & (F.xxhash64("row_.text") == F.col("key_")), "left"
    )
    text = F.when(F.col("spans").isNull(), F.col("row_.text")).otherwise(cut(F.col("row_.text"), F.col("spans")))
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"row_.`{c}`") for c in docs.columns])
