"""Licence scan by a positional index of rare words.

The index holds, per template, its words and positions. How rare a word is
follows from the number of documents that have it. In a document, the places
of a template's two rarest words give two sets of possible starts; only starts
in both are looked at, and there the template's mandatory phrase must stand in
full. The share of the remaining template words found at their positions
decides whether the place counts. Names and identifiers of licences, as in
"CC BY-NC 4.0" or "MPL-2.0", are templates that are mandatory in full.

Words are runs of letters, digits and characters beyond ASCII, A-Z in lower
case. A null or empty text has no words and no labels. Every row is judged by
itself, so repeated rows and null ids are kept as they are; columns of the
input other than id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscale.llm.common import ascii_lower, materialised, split_words

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAST_SHARE = 0.6


@dataclass(frozen=True)
class Template:
    """``words`` with the mandatory phrase from ``phrase_at`` on, ``phrase_size`` words long."""

    label: str
    words: tuple[str, ...]
    phrase_at: int
    phrase_size: int
    base: bool

    @property
    def phrase(self) -> tuple[str, ...]:
        return self.words[self.phrase_at : self.phrase_at + self.phrase_size]


def _template(label: str, before: str, phrase: str, after: str, base: bool = False) -> Template:
    parts = [part.split() for part in (before, phrase, after)]
    return Template(label, tuple(sum(parts, [])), len(parts[0]), len(parts[1]), base)


# Phrases of well-known licences; the second text is mandatory.
TEMPLATES = (
    _template("mit", "", "mit license", "", True),
    _template("apache", "", "apache license", "", True),
    _template("gpl", "", "general public license", "", True),
    _template("mit", "permission is hereby granted", "free of charge to any person obtaining a copy", "of this software"),
    _template("mit", "the software is provided", "as is without warranty of any kind", "express or implied"),
    _template("apache", "licensed under the", "apache license version 2 0", "the license"),
    _template("apache", "you may not use this file except in", "compliance with the license", "you may obtain a copy"),
    _template("gpl", "you can redistribute it and or modify it", "under the terms of the gnu", "general public license"),
    _template("gpl", "licensed under the", "gnu general public license", ""),
    _template("lgpl", "under the terms of the", "gnu lesser general public license", "as published"),
    _template("agpl", "under the terms of the", "gnu affero general public license", "as published"),
    _template("bsd", "redistribution and use in", "source and binary forms", "with or without modification"),
    _template("mpl", "subject to the terms of the", "mozilla public license", "v 2 0"),
    _template("isc", "permission to use copy modify and or", "distribute this software for any purpose", "with or without fee"),
    _template("unlicense", "this is free and unencumbered", "software released into the public domain", ""),
    _template("cc", "licensed under a", "creative commons attribution", "license"),
)

# Names and identifiers that say enough by themselves: all of their words are mandatory.
_NAMES = {
    "mit": ("mit licence", "licensed under mit", "under the mit", "identifier mit"),
    "apache": ("apache licence", "apache 2 0", "licensed under apache", "apache software license"),
    "gpl": (
        "general public licence",
        "gnu gpl",
        "gplv2",
        "gplv3",
        *(f"gpl {version}" for version in ("1 0", "2 0", "3 0", "v2", "v3", "version 2", "version 3", "license", "licence")),
    ),
    "lgpl": (
        *(f"{kind} general public {noun}" for kind in ("lesser", "library") for noun in ("license", "licence")),
        "gnu lgpl",
        "lgplv2",
        "lgplv3",
        *(f"lgpl {version}" for version in ("2 0", "2 1", "3 0", "v2", "v3", "version 2", "version 3", "license", "licence")),
    ),
    "agpl": (
        "affero general public license",
        "affero general public licence",
        "gnu agpl",
        "agplv3",
        *(f"agpl {version}" for version in ("1 0", "3 0", "v3", "version 3", "license", "licence")),
    ),
    "bsd": ("bsd license", "bsd licence", "bsd style license", *(f"bsd {count} clause" for count in (1, 2, 3, 4)), *(f"{count} clause bsd" for count in (2, 3, 4)), "identifier 0bsd"),
    "mpl": ("mozilla public license", "mozilla public licence", "mpl 1 0", "mpl 1 1", "mpl 2 0"),
    "isc": ("isc license", "isc licence", "identifier isc"),
    "unlicense": ("the unlicense", "identifier unlicense", "unlicense org"),
    "cc": (
        "creative commons attribution",
        "creative commons by",
        "creative commons license",
        "creative commons licence",
        *(f"cc by {rest}" for rest in ("nc", "nd", "sa", "1 0", "2 0", "2 5", "3 0", "4 0", "license", "licence")),
        *(f"under {article} cc by".replace("  ", " ") for article in ("", "a", "the")),
        "identifier cc by",
    ),
    "cc0": ("cc0 1 0", "cc0 license", "cc0 licence", "under cc0", "creative commons zero"),
}
NAMES = tuple(_template(label, "", name, "") for label, names in _NAMES.items() for name in names)


def document_frequencies(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How many rows of ``words`` have each word of the vocabulary (a few dozen counts)."""
    present = F.array_intersect(F.col("words"), F.array(*map(F.lit, vocabulary)))
    rows = words.select(F.explode(present).alias("word")).groupBy("word").count().collect()
    return dict.fromkeys(vocabulary, 0) | {row["word"]: row["count"] for row in rows}


def _places(template: Template, rarest: list[str]) -> Column:
    """Starts of the template's phrase in ``words``, from the array ``rare`` of (position, word)."""

    def starts_by(word: str) -> Column:
        hits = F.filter("rare", lambda hit: hit["word"] == word)
        return F.transform(hits, lambda hit: hit["position"] - template.phrase.index(word))

    sets = [starts_by(word) for word in rarest]
    starts = F.array_intersect(*sets) if len(sets) > 1 else sets[0]
    phrase = F.array(*map(F.lit, template.phrase))
    return F.filter(starts, lambda at: (at >= 0) & (F.slice("words", F.greatest(at + 1, F.lit(1)), template.phrase_size) == phrase))


def _share(template: Template, start: Column) -> Column:
    """Which part of the whole template stands around a place of its phrase."""
    begin = start - template.phrase_at
    found = [
        F.when(F.get("words", begin + offset) == word, 1).otherwise(0) for offset, word in enumerate(template.words)
    ]
    return sum(found[1:], found[0]) / F.lit(float(len(template.words)))


def _named(rarest: dict[Template, list[str]]) -> Column:
    """The places of ``NAMES``; as they are many, they are data of one expression."""

    def entry(name: Template) -> Column:
        words = rarest[name]
        return F.struct(
            F.lit(name.label).alias("label"),
            F.array(*map(F.lit, name.phrase)).alias("phrase"),
            *(F.lit(word).alias(column) for column, word in zip(("first", "second"), (words[0], words[-1]), strict=True)),
            *(F.lit(name.phrase.index(word)).alias(column) for column, word in zip(("first_at", "second_at"), (words[0], words[-1]), strict=True)),
        )

    def places(name: Column) -> Column:
        def starts_by(word: str) -> Column:
            hits = F.filter("rare", lambda hit: hit["word"] == name[word])
            return F.transform(hits, lambda hit: hit["position"] - name[f"{word}_at"])

        size = F.size(name["phrase"])
        starts = F.array_intersect(starts_by("first"), starts_by("second"))
        whole = F.filter(starts, lambda at: (at >= 0) & (F.slice("words", F.greatest(at + 1, F.lit(1)), size) == name["phrase"]))
        return F.transform(
            whole,
            lambda at: F.struct(
                name["label"].alias("label"),
                F.lit(False).alias("base"),
                at.cast("long").alias("start"),
                size.alias("size"),
                F.lit(1.0).alias("share"),
            ),
        )

    present = F.filter(
        F.array(*map(entry, NAMES)), lambda name: F.exists("rare", lambda hit: hit["word"] == name["first"])
    )
    return F.flatten(F.transform(present, places))


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_words, places, score``.

    ``places`` lists every place of a licence as (label, base, start, size,
    share); ``score`` is the largest share, 0 without a place.
    """
    text = ascii_lower(F.col(f"`{text_column}`"))
    plain = docs.select(F.col(f"`{id_column}`").alias("doc_id"), split_words(text, SEPARATOR).alias("words"))
    vocabulary = sorted({word for template in TEMPLATES + NAMES for word in template.phrase})
    frequency = document_frequencies(plain, vocabulary)

    # The two words of each phrase that fewest documents have; ties by name.
    def rarest(template: Template) -> list[str]:
        once = [word for word in dict.fromkeys(template.phrase) if template.phrase.count(word) == 1]
        return sorted(once, key=lambda word: (frequency[word], word))[:2]

    chosen = {template: rarest(template) for template in TEMPLATES + NAMES}
    anchors = F.array(*map(F.lit, sorted({word for words in chosen.values() for word in words})))
    places = F.array().cast("array<struct<position:int,word:string>>")
    found = F.filter(
        F.transform("words", lambda word, at: F.struct(at.alias("position"), word.alias("word"))),
        lambda hit: F.array_contains(anchors, hit["word"]),
    )
    # A text without the rarest word of any phrase has no phrase.
    needed = F.array(*map(F.lit, sorted({words[0] for words in chosen.values()})))
    rare = F.when(F.arrays_overlap("words", needed), found).otherwise(places)
    marked = materialised(materialised(plain, words=F.col("words")), rare=rare)

    def of(template: Template) -> Column:
        def place(at: Column) -> Column:
            return F.struct(
                F.lit(template.label).alias("label"),
                F.lit(template.base).alias("base"),
                at.cast("long").alias("start"),
                F.lit(template.phrase_size).alias("size"),
                _share(template, at).alias("share"),
            )

        return F.transform(_places(template, chosen[template]), place)

    some = F.filter(F.concat(*map(of, TEMPLATES), _named(chosen)), lambda place: place["base"] | (place["share"] >= LEAST_SHARE))
    none = F.array().cast("array<struct<label:string,base:boolean,start:bigint,size:int,share:double>>")
    placed = materialised(marked, places=F.when(F.size("rare") > 0, some).otherwise(none))
    return placed.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        "places",
        F.coalesce(F.array_max(F.transform("places", lambda place: place["share"])), F.lit(0.0)).alias("score"),
    )


def license_digest(scanned: DataFrame) -> DataFrame:
    """The columns of the registered query, from ``scan_licenses``."""
    base = F.filter("places", lambda place: place["base"])
    starts = F.transform(base, lambda place: place["start"])

    def labels(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda place: place["label"]))), ",")

    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        "score",
    )
