"""License notices by a positional index of rare template words, in column expressions alone.

Every template is a sequence of words. The weight of a word is its inverse document frequency over all
documents. Of each template the rarest words are indexed with their position, as many as needed so that no
match of the wanted share of weight can lack all of them. A document's words are looked up in the index; a hit
at word i for position k of a template proposes the place i - k, shifted by no more than the template's drift.
There the template's other words are intersected by relative position, and a place counts if the words found
carry the wanted share of weight and all mandatory phrases of the template stand within it. Short phrases
that must match in full are templates of share 1 without drift. All of this happens inside the document's row,
so no text, and no word of a common notice, is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girderframe.llm.common import Query, lower_ascii, table

#: Runs of letters, digits and all that is not ASCII; as a class of the text before A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of all templates together, at most: the index is part of the plan.
MOST_WORDS = 5_000
#: Parts in which weights are counted.
UNIT = 1000


@dataclass(frozen=True)
class Template:
    """A notice: its words, the label it stands for and the phrases that must be in it."""

    label: str
    words: str
    phrases: tuple[str, ...]
    #: Share of the weight that a place must hold, in hundredths.
    percent: int = 80
    #: Words by which a part of the notice may be shifted.
    drift: int = 2
    base: bool = False

    @property
    def sequence(self) -> list[str]:
        return self.words.split()


# Fixed values of the contract: phrase and label.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Customary wordings of license notices, lower-case and without punctuation.
TEMPLATES = (
    *(Template(label, phrase, (phrase,), 100, 0, True) for phrase, label in BASE.items()),
    Template("gpl-2.0", "gnu general public license version 2", ("gnu general public license", "version 2"), 90),
    Template("gpl-3.0", "gnu general public license version 3", ("gnu general public license", "version 3"), 90),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",), 60),
    Template("agpl", "gnu affero general public license", ("gnu affero general public license",), 100, 0),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use", "source and binary forms")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license", "2 0")),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc-by", "creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


def _texts(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values))


def words_of(text: Column) -> Column:
    """Words of a text as they are written; null gives none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def document_frequencies(documents: DataFrame, vocabulary: Sequence[str]) -> tuple[int, dict[str, int]]:
    """Rows of ``documents``, and how many of them hold each word of the bounded ``vocabulary``."""
    wanted = list(vocabulary)
    # lower() maps some letters beyond ASCII to ASCII ones; only words that it lets through are looked at closely.
    some = F.filter(words_of(F.col("text")), lambda w: F.lower(w).isin(wanted))
    words = F.array_distinct(F.transform(some, lower_ascii))
    found = documents.select(F.explode(F.concat(F.array(F.lit("")), words)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("docs"))
    # At most one row for each word of the vocabulary.
    counts = {r["word"]: r["docs"] for r in found.filter(F.col("word").isin(["", *wanted])).collect()}
    return counts.pop("", 0), counts


def weights(documents: DataFrame, templates: Sequence[Template] = TEMPLATES) -> dict[str, int]:
    """Inverse document frequency of each template word in thousandths, at least 1."""
    import math

    vocabulary = sorted({w for t in templates for w in t.sequence})
    rows, found = document_frequencies(documents, vocabulary)
    return {w: 1 + math.floor(UNIT * math.log((rows + 1) / (found.get(w, 0) + 1)) + 1e-6) for w in vocabulary}


def indexed_positions(template: Template, weight: dict[str, int]) -> list[int]:
    """Positions of the rarest words, such that no place of the wanted share lacks them all."""
    words = template.sequence
    total = sum(weight[w] for w in words)
    chosen, held = [], 0
    for at in sorted(range(len(words)), key=lambda k: (-weight[words[k]], k)):
        # Without the chosen words at most the rest can be found.
        if (total - held) * 100 < template.percent * total:
            break
        chosen.append(at)
        held += weight[words[at]]
    return chosen


def _places(words: Column, templates: Sequence[Template], weight: dict[str, int]) -> Column:
    """array<struct<template, start, share>> of all places that count in an array of words."""
    index: dict[str, list[tuple[int, int]]] = {}
    for number, template in enumerate(templates):
        for at in indexed_positions(template, weight):
            for shift in range(-template.drift, template.drift + 1):
                index.setdefault(template.sequence[at], []).append((number, at + shift))
    rare = sorted(index)
    entry = "array<struct<template:int,at:int>>"
    none = F.array().cast(entry)
    postings = F.create_map(*[x for w in rare for x in (F.lit(w), F.array(*[F.struct(F.lit(n).alias("template"), F.lit(k).alias("at")) for n, k in index[w]]).cast(entry))])
    hits = F.array_compact(F.transform(words, lambda w, i: F.when(F.lower(w).isin(rare), i)))
    proposed = F.flatten(
        F.transform(
            hits,
            lambda i: F.transform(F.coalesce(F.element_at(postings, lower_ascii(F.element_at(words, i + 1))), none), lambda p: F.struct(p["template"].alias("template"), (i - p["at"]).alias("start"))),
        )
    )
    spec = F.array(
        *[
            F.struct(
                _texts(t.sequence).alias("words"),
                F.array(*[F.lit(weight[w]) for w in t.sequence]).alias("weights"),
                F.lit(sum(weight[w] for w in t.sequence)).alias("total"),
                F.lit(t.percent).alias("percent"),
                F.lit(t.drift).alias("drift"),
                _texts([f" {p} " for p in t.phrases]).alias("phrases"),
            )
            for t in templates
        ]
    )

    def beside(place: Column) -> Column:
        """The place with the words of it and of the drift before and behind it; those before the text are empty."""
        t = F.element_at(spec, place["template"] + 1)
        before = place["start"] - t["drift"]
        inside = F.slice(words, F.greatest(before, F.lit(0)) + 1, F.greatest(F.size(t["words"]) + 2 * t["drift"] + F.least(before, F.lit(0)), F.lit(0)))
        here = F.concat(F.array_repeat(F.lit(""), F.greatest(-before, F.lit(0))), F.transform(inside, lower_ascii))
        return F.struct(place["template"].alias("template"), place["start"].alias("start"), here.alias("here"))

    def weighed(place: Column) -> Column:
        """The place with the weight of the template's words that stand there."""
        t = F.element_at(spec, place["template"] + 1)
        found = F.aggregate(
            F.sequence(F.lit(0), F.size(t["words"]) - 1),
            F.lit(0),
            lambda sum_, k: sum_ + F.when(F.array_contains(F.slice(place["here"], k + 1, 2 * t["drift"] + 1), F.element_at(t["words"], k + 1)), F.element_at(t["weights"], k + 1)).otherwise(0),
        )
        return F.struct(place["template"].alias("template"), place["start"].alias("start"), place["here"].alias("here"), found.alias("found"))

    def counts(place: Column) -> Column:
        """Whether the weight suffices and all phrases are there."""
        t = F.element_at(spec, place["template"] + 1)
        line = F.concat(F.lit(" "), F.array_join(place["here"], " "), F.lit(" "))
        return (place["found"] * 100 >= t["percent"] * t["total"]) & F.forall(t["phrases"], lambda p: F.contains(line, p))

    def shared(place: Column) -> Column:
        return F.struct(place["template"].alias("template"), place["start"].alias("start"), F.round(place["found"] / F.element_at(spec, place["template"] + 1)["total"], 6).alias("share"))

    places = F.transform(F.transform(F.array_distinct(proposed), beside), weighed)
    return F.transform(F.filter(places, counts), shared)


def scan_licenses(documents: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, places): the words of every document and all places of notices in it.

    A place has label, base, start (from word 0; up to the drift before the text), words (the template's length)
    and share, the part of the template's weight found. Null and empty texts have no words. Texts are looked at
    whole, however long. Repeated rows are judged alike, and each counts for the weights; doc_id may be null.
    An empty table gives none. Other columns of ``documents`` do not matter.
    """
    if sum(len(t.sequence) for t in templates) > MOST_WORDS:
        raise ValueError(f"the templates have more than {MOST_WORDS} words")
    rows = documents.select("doc_id", "text")
    places = _places(F.col("words"), templates, weights(rows, templates))
    label, base, size = _texts([t.label for t in templates]), F.array(*[F.lit(t.base) for t in templates]), F.array(*[F.lit(len(t.sequence)) for t in templates])
    named = F.transform(
        F.col("places"),
        lambda p: F.struct(
            F.element_at(label, p["template"] + 1).alias("label"), F.element_at(base, p["template"] + 1).alias("base"),
            p["start"].cast("long").alias("start"), F.element_at(size, p["template"] + 1).alias("words"), p["share"].alias("share"),
        ),
    )
    worded = rows.select("doc_id", words_of(F.col("text")).alias("words"))
    return worded.select("doc_id", F.size("words").cast("long").alias("n_words"), places.alias("places")).select("doc_id", "n_words", named.alias("places"))


def license_digest(scanned: DataFrame) -> DataFrame:
    """One row per document: base places, their first and last word, and the labels and score of all places."""
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )


def _sql(templates: Sequence[Template] = TEMPLATES) -> str:
    """SQL of the query: every template is tried at every place, without an index."""
    quoted = lambda values: "[" + ", ".join("'" + v + "'" for v in values) + "]"
    rows = ",\n  ".join(f"({n}, '{t.label}', {str(t.base).lower()}, {quoted(t.sequence)}, {quoted([f' {p} ' for p in t.phrases])}, {t.percent}, {t.drift})" for n, t in enumerate(templates))
    return rf"""
WITH templates(no, label, base, words, phrases, percent, drift) AS (VALUES
  {rows}),
d AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
t AS (SELECT no, percent, drift, unnest(range(len(words))) AS k, unnest(words) AS word FROM templates),
w AS (SELECT doc, unnest(range(len(words))) AS i, unnest(words) AS word FROM d),
hit AS (SELECT * FROM w WHERE word IN (SELECT word FROM t)),
df AS (SELECT word, count(DISTINCT doc) AS docs FROM hit GROUP BY word),
weight AS (SELECT word, 1 + floor(1000 * ln(((SELECT count(*) FROM d) + 1)::DOUBLE / (coalesce(docs, 0) + 1)) + 1e-6)::BIGINT AS weight FROM (SELECT DISTINCT word FROM t) LEFT JOIN df USING (word)),
total AS (SELECT no, sum(weight) AS total FROM t JOIN weight USING (word) GROUP BY no),
found AS (SELECT DISTINCT hit.doc, t.no, t.k, hit.i - t.k - unnest(range(-t.drift, t.drift + 1)) AS start, weight FROM hit JOIN t USING (word) JOIN weight USING (word)),
share AS (SELECT doc, no, start, sum(weight) AS got FROM found GROUP BY ALL),
place AS (SELECT doc, no, start, label, base, round(got / total, 6) AS share, phrases, len(templates.words) AS size, drift FROM share JOIN total USING (no) JOIN templates USING (no) WHERE got * 100 >= percent * total),
good AS (SELECT place.* FROM place JOIN d USING (doc) WHERE len(list_filter(phrases, lambda p: contains(' ' || array_to_string(list_filter(list_transform(range(start - drift, start + size + drift), lambda j: CASE WHEN j < 0 THEN '' WHEN j >= len(d.words) THEN NULL ELSE d.words[j + 1] END), lambda v: v IS NOT NULL), ' ') || ' ', p))) = len(phrases)),
g AS (SELECT doc, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM good GROUP BY doc)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN g USING (doc)
"""


QUERIES: dict[str, Query] = {"op11_license_scan": Query(lambda spark, folder: license_digest(scan_licenses(table(spark, folder, "documents"))), _sql())}
