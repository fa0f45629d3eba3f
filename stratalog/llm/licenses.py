"""Licence scan by a positional index of rare words, DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words in lower-cased text: digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """A licence text: its words, the phrase that must stand in it, and its label.

    ``exact`` templates match only where all words agree.
    """

    label: str
    text: str
    key: str = ""
    exact: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_span(self) -> tuple[int, int]:
        words, key = self.words, (self.key or self.text).split()
        start = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        return start, start + len(key)


#: Phrases and labels every scan reports.
BASE = (
    Template("mit", "under the mit license", exact=True),
    Template("apache-2", "apache license version 2", exact=True),
    Template("cc-by-nc", "cc by nc", exact=True),
)

#: Notices of common licences, with the phrase each must contain.
NOTICES = (
    Template("mit", "released under the mit license", "the mit license"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction",
        "permission is hereby granted free of charge",
    ),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    Template(
        "apache-2",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "in compliance with the license",
    ),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", "public license version 3"),
    Template(
        "gpl-3",
        "under the terms of the gnu general public license as published by the free software foundation either version 3",
        "gnu general public license",
    ),
    Template("gpl-2", "licensed under the gnu general public license version 2", "public license version 2"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by", "licensed under the creative commons attribution 4 0 international license", "creative commons attribution 4"),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
        "redistribution and use in source and binary forms",
    ),
    Template(
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "mozilla public license v 2",
    ),
    Template("agpl-3", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    Template("bsl-1", "distributed under the boost software license version 1 0", "boost software license version 1"),
    Template("epl-2", "made available under the terms of the eclipse public license 2 0", "eclipse public license 2"),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "permission to use copy modify",
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable "
        "for any damages arising from the use of this software",
        "in no event will the authors be held liable",
    ),
    Template(
        "cc0",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
        "waived all copyright and related or neighboring rights",
    ),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "into the public domain"),
)

#: Words of a template looked up in a file, rarest first, beside one of its mandatory phrase; share of a template's weight that must agree.
PROBES, ENOUGH = 3, 0.8
_LEFT = 1 << 32


def license_words(text: Column) -> Column:
    """The words of a whole text with A-Z lower-cased; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def word_weights(words: DataFrame, templates: tuple[Template, ...]) -> dict[str, float]:
    """Inverse document frequency of every template word over all rows of ``words``.

    Only words of templates are counted, so what reaches the driver is bounded by
    the templates.
    """
    vocabulary = sorted({w for t in templates for w in t.words})
    literal = F.array(*[F.lit(w) for w in vocabulary])
    present = F.array_append(F.array_intersect("words", literal), F.lit(""))
    counts = dict(
        map(tuple, words.select(F.explode_outer(present).alias("word")).groupBy("word").agg(F.count("*")).collect())
    )
    rows = counts.get("", 0)
    return {w: math.log((rows + 2) / (counts.get(w, 0) + 1)) for w in vocabulary}


def _array(values: list, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def scan_licenses(
    docs: DataFrame,
    templates: tuple[Template, ...] = BASE + NOTICES,
    id_col: str = "doc_id",
    text: str = "text",
    probes: int = PROBES,
    enough: float = ENOUGH,
) -> DataFrame:
    """Licence places of every row: (doc_id, n_words, places, score).

    ``places`` is an array of (template number, start word, share, found). The
    rarest words of every template, by their document frequency over all rows, and the
    rarest of its mandatory phrase form an index word -> (template, offset). That phrase
    must stand word for word, so no place is missed, whatever else was edited. A file's occurrences of these words give
    candidate starts (position less offset); the template's other words are then
    looked up at their relative positions and weighted by rarity. A place is found
    if the mandatory phrase stands in it word for word and the share reaches
    ``enough`` (1 for exact templates). ``score`` is the best share among places with the mandatory
    phrase, 0 without one.

    The scan is one narrow pass: nothing is shuffled, a row with very many places
    keeps them in its own array.

    * Null or empty text: no words, no places, score 0. Null or repeated ids: rows
      are looked at one by one. Empty table: no rows. Other columns are not read.
    """
    words = docs.select(F.col(id_col).alias("doc_id"), license_words(F.col(text)).alias("words"))
    weights = word_weights(words, templates)
    index: dict[str, list[tuple[int, int]]] = {}
    for number, t in enumerate(templates):
        rare = sorted(range(len(t.words)), key=lambda i: (-weights[t.words[i]], i))
        vital = next(i for i in rare if t.key_span[0] <= i < t.key_span[1])
        for offset in dict.fromkeys([*rare[:probes], vital]):
            index.setdefault(t.words[offset], []).append((number, offset))
    anchors = _array(sorted(index), "string")
    # template * 2^32 - offset: adding a position gives a candidate as one number
    entries = F.create_map(
        *[c for w in sorted(index) for c in (F.lit(w), _array([n * _LEFT - o for n, o in index[w]], "bigint"))]
    )
    texts = F.array(*[_array(t.words, "string") for t in templates])
    weighed = F.array(*[_array([weights[w] for w in t.words], "double") for t in templates])
    totals = _array([sum(weights[w] for w in t.words) for t in templates], "double")
    key_from = _array([t.key_span[0] for t in templates], "int")
    key_to = _array([t.key_span[1] for t in templates], "int")
    exact = _array([t.exact for t in templates], "boolean")

    at = F.transform("words", lambda w, i: F.struct(i.cast("bigint").alias("i"), w.alias("w")))
    rare_at = F.filter(at, lambda s: F.array_contains(anchors, s["w"]))
    codes = F.flatten(F.transform(rare_at, lambda s: F.transform(F.element_at(entries, s["w"]), lambda e: e + s["i"])))
    hits = words.withColumn(
        "codes", F.when(F.arrays_overlap("words", anchors), F.array_distinct(codes)).otherwise(_array([], "bigint"))
    )

    def place(code: Column) -> Column:
        # a start may lie before the text; half a stride keeps the number of the template right
        number = F.shiftright(code + _LEFT // 2, 32).cast("int")
        start = (code - number.cast("bigint") * _LEFT).cast("int")
        return F.struct(number.alias("template"), start.alias("start"))

    def agreement(p: Column) -> Column:
        mine, worth = F.get(texts, p["template"]), F.get(weighed, p["template"])
        low, high = F.get(key_from, p["template"]), F.get(key_to, p["template"])
        same = F.transform(
            mine,
            lambda w, k: F.coalesce(
                (p["start"] + k >= 0) & (F.get(F.col("words"), p["start"] + k) == w), F.lit(False)
            ),
        )
        return F.struct(
            p["template"].alias("template"),
            p["start"].alias("start"),
            F.aggregate(
                F.zip_with(same, worth, lambda s, v: F.when(s, v).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v
            ).alias("weight"),
            F.forall(same, lambda s: s).alias("whole"),
            F.forall(F.slice(same, low + 1, high - low), lambda s: s).alias("key"),
        )

    def verdict(p: Column) -> Column:
        share = F.when(p["whole"], F.lit(1.0)).otherwise(p["weight"] / F.get(totals, p["template"]))
        found = p["whole"] | (~F.get(exact, p["template"]) & p["key"] & (share >= enough))
        return F.struct(
            p["template"].alias("template"),
            p["start"].alias("start"),
            F.when(found | p["key"], share).otherwise(0.0).alias("share"),
            found.alias("found"),
        )

    agreed = hits.withColumn("agreed", F.transform(F.transform("codes", place), agreement))
    judged = agreed.select("doc_id", F.size("words").cast("long").alias("n_words"), F.transform("agreed", verdict).alias("places"))
    best = F.array_max(F.transform("places", lambda p: p["share"]))
    return judged.withColumn("score", F.least(F.coalesce(best, F.lit(0.0)), F.lit(1.0)))


def license_report(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES) -> DataFrame:
    """One row per document: counts and ends of the base places, labels, score."""
    labels = _array([t.label for t in templates], "string")
    base = len([t for t in templates if t.exact])
    if not all(t.exact for t in templates[:base]):
        raise ValueError("exact templates come first")

    def joined(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: F.get(labels, p["template"])))), ",")

    found = scan_licenses(docs, templates).withColumn("places", F.filter("places", lambda p: p["found"]))
    exact = found.withColumn("base", F.filter("places", lambda p: p["template"] < base))
    starts = F.transform("base", lambda p: p["start"].cast("bigint"))
    return exact.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(F.col("base")).alias("base_labels"),
        joined(F.col("places")).alias("labels"),
        "score",
    )
