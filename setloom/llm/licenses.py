"""License scan: MinHash over overlapping windows finds templates, exact shingle containment confirms them.

Texts are lower-cased, freed of common punctuation and cut into words; shingles are five words. A text's shingle hashes
form windows that overlap by half. A window keeps its ``MINIMA`` least hashes, each a band of its own. Templates are cut
into pieces of half a window, so every piece lies whole in some window and makes up half of it at least (J >= 1/2): the
chance that none of the window's eight least hashes is the piece's is at most 1/256 for one piece, and a long template has
several. Templates shorter than a piece use windows of two shingles that keep both minima: collisions are certain.

A candidate (text and template) is confirmed if at least ``threshold`` of the template's shingles, as words, occur in the
whole text. Only then is it reported, with the exact share. Null and empty texts and texts under five words match
nothing. Templates need five words. Repeated rows are all reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE, own_names, sealed

WORDS = 5
WINDOW = 32
MINIMA = 8
MARKS = r"[.,;:!?()\"'*#]+"
MAX_TEMPLATES = 10_000

# Names and notices of common licenses, as published by their owners.
TEMPLATES = (
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", "you may not use this file except in compliance with the License. You may obtain a copy of the "
     "License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
     "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
     "KIND, either express or implied."),
    ("mit-notice", "Released under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
     "Software, and to permit persons to whom the Software is furnished to do so"),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version."),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met"),
)


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), MARKS, ""), SPACE), lambda w: w != "")


def _places(words: Column) -> Column:
    return F.when(F.size(words) >= WORDS, F.sequence(F.lit(0), F.size(words) - WORDS)).otherwise(
        F.array().cast("array<int>"))


def shingle_hashes(words: Column) -> Column:
    return F.transform(_places(words), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WORDS)]))


def shingles(words: Column) -> Column:
    return F.array_distinct(F.transform(_places(words), lambda i: F.array_join(F.slice(words, i + 1, WORDS), " ")))


def sketches(hashes: Column, window: int, minima: int) -> Column:
    """The least hashes of windows that overlap by half, of all windows together."""
    half = window // 2
    starts = F.when(F.size(hashes) > 0, F.sequence(F.lit(1), F.greatest(F.size(hashes) - half, F.lit(1)), F.lit(half)))
    return F.flatten(F.transform(starts, lambda i: F.slice(F.sort_array(F.slice(hashes, i, window)), 1, minima)))


def _bands(templates: DataFrame) -> tuple[dict[int, set[str]], dict[int, set[str]]]:
    """Template names by the hash of a band, for short and for long templates."""
    hashed = templates.select("template", shingle_hashes(word_list(F.col("body"))).alias("h")).collect()
    short: dict[int, set[str]] = {}
    long: dict[int, set[str]] = {}
    for name, values in hashed:
        if len(values) < WINDOW // 2:
            for v in values:
                short.setdefault(v, set()).add(name)
        else:
            for at in range(0, len(values) - WINDOW // 2 + 1, WINDOW // 4):
                for v in sorted(values[at:at + WINDOW // 2])[:MINIMA]:
                    long.setdefault(v, set()).add(name)
    return short, long


def _templates_met(values: Column, bands: dict[int, set[str]]) -> Column:
    named = F.create_map(*[x for v, names in bands.items() for x in (F.lit(v), F.array(*[F.lit(n) for n in sorted(names)]))])
    met = F.array_distinct(F.filter(values, lambda v: v.isin(*bands)))
    return F.flatten(F.transform(met, lambda v: F.element_at(named, v)))


def scan(docs: DataFrame, templates: DataFrame, text: str = "text", threshold: float = 0.8) -> DataFrame:
    """Rows of ``docs`` without the text, one for each template found: ``template, containment`` (double).

    ``templates`` has ``template, body`` and at most ``MAX_TEMPLATES`` rows: they become part of the plan.
    """
    if templates.limit(MAX_TEMPLATES + 1).count() > MAX_TEMPLATES:
        raise ValueError("too many templates for one scan: split them")
    kept = [F.col(f"`{c}`") for c in own_names(docs, text, "template", "containment").columns]
    known = templates.select("template", shingles(word_list(F.col("body"))).alias("_shingles"))
    short, long = _bands(templates)
    step = docs.select(*kept, word_list(F.col(f"`{text}`")).alias("_words"))
    step = step.select(*kept, "_words", shingle_hashes(F.col("_words")).alias("_h"))
    hits = []
    for bands, window, minima in ((short, 2, 2), (long, WINDOW, MINIMA)):
        if bands:
            hits.append(_templates_met(sketches(F.col("_h"), window, minima), bands))
    if not hits:
        hits = [F.array().cast("array<string>")]
    met = F.array_distinct(F.concat(*[F.coalesce(h, F.array().cast("array<string>")) for h in hits]))
    found = sealed(step.select(*kept, "_words", met.alias("_met"))).where(F.size("_met") > 0)
    found = found.select(*kept, shingles(F.col("_words")).alias("_held"), F.explode("_met").alias("template"))
    found = found.join(F.broadcast(known), "template")
    share = F.size(F.array_intersect("_held", "_shingles")) / F.size("_shingles")
    return found.select(*kept, "template", share.alias("containment")).where(F.col("containment") >= threshold)
