"""Licence scans by a positional index of rare tokens, in DataFrame functions alone.

A template is a label with passages of a licence; each passage has mandatory key phrases, in order. How many files hold
each mandatory word is counted over the whole corpus; each phrase is filed under its two rarest words, with their places
in it. In a file every such word points to where a phrase would start; starts that both words agree on are candidates,
and a candidate counts once the whole phrase stands there. A passage stands where its phrases follow one another in
order, each up to SLACK words nearer or further than the passage has it: so what lies between key phrases may be worded
otherwise, with more words or fewer. A label needs all of its passages, in whatever order; both index words of a phrase
are mandatory, so the index loses no place.

Defined results: a null or empty text has no words and no places (null first and last word, empty labels, score 0);
repeated rows and null ids keep their rows; an empty table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import read, texts_of

#: Everything between words: ASCII that is neither digit nor letter.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words by which the distance of two phrases may differ from the passage's.
SLACK = 12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Passage:
    """Words of a licence as they follow each other; those of `keys` are mandatory, without any all of them."""

    text: str
    keys: tuple[str, ...] = ()

    def parts(self) -> list[tuple[int, list[str]]]:
        """Place and words of each mandatory phrase."""
        words, out = self.text.split(" "), []
        for key in self.keys or (self.text,):
            k = key.split(" ")
            out.append((next(i for i in range(len(words)) if words[i : i + len(k)] == k), k))
        return out

    def mandatory(self) -> dict[int, str]:
        """Place -> word."""
        return {at + i: w for at, k in self.parts() for i, w in enumerate(k)}


@dataclass(frozen=True)
class Template:
    label: str
    passages: tuple[Passage, ...]
    base: bool = False


def named(label: str, *phrases: str, base: bool = False) -> Template:
    return Template(label, tuple(map(Passage, phrases)), base)


AS_IS = Passage("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", ("the software is provided as is", "without warranty of any kind"))
REDISTRIBUTION = Passage("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "are permitted provided that the following conditions are met"))
RETAIN = Passage("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code must retain", "this list of conditions and the following disclaimer"))
#: Names of licences, and passages of their texts and of the headers that point to them.
TEMPLATES = (
    named("mit", "mit license", base=True),
    named("apache", "apache license", base=True),
    named("gpl", "general public license", base=True),
    Template(
        "mit",
        (
            Passage(
                "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
                "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
                ("permission is hereby granted free of charge", "obtaining a copy of this software", "to deal in the software without restriction"),
            ),
            AS_IS,
        ),
    ),
    Template("boost", (Passage("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("permission is hereby granted free of charge", "or organization obtaining a copy", "documentation covered by this license")),)),
    Template("isc", (Passage("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "for any purpose with or without fee is hereby granted")),)),
    Template("zlib", (Passage("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("this software is provided as is", "in no event will the authors be held liable")),)),
    Template("bsd", (REDISTRIBUTION, RETAIN)),
    Template("bsd-3-clause", (REDISTRIBUTION, RETAIN, Passage("may be used to endorse or promote products derived from this software without specific prior written permission", ("may be used to endorse or promote products derived from this software",)))),
    named("apache-2.0", "apache license version 2 0"),
    Template("apache-2.0", (Passage("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("licensed under the apache license", "you may not use this file except in compliance with the license")),)),
    named("gpl-3.0", "general public license version 3"),
    named("gpl-2.0", "general public license version 2"),
    *(
        Template(
            f"{label}-{version}.0",
            (
                Passage(
                    f"{what} is free software you can redistribute it and or modify it under the terms of the gnu {kind}general public license as published by the free software foundation either version {version} of the license",
                    ("is free software you can redistribute it and or modify it", f"gnu {kind}general public license as published by the free software foundation", f"version {version} of the license"),
                ),
            ),
        )
        for label, kind, what, versions in (("gpl", "", "program", (2, 3)), ("lgpl", "lesser ", "library", (2, 3)), ("agpl", "affero ", "program", (3,)))
        for version in versions
    ),
    named("lgpl", "lesser general public license"),
    named("agpl", "affero general public license"),
    named("mpl", "mozilla public license"),
    Template("mpl-2.0", (Passage("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file", ("this source code form is subject to the terms of the mozilla public license", "if a copy of the mpl was not distributed with this file")),)),
    named("epl", "eclipse public license"),
    named("cc-by", "creative commons attribution"),
    named("cc-by", "licensed under cc by"),
    named("cc-by-nc", "cc by nc"),
    named("cc-by-nc", "creative commons attribution noncommercial"),
    named("cc-by-sa", "cc by sa"),
    named("cc-by-sa", "creative commons attribution sharealike"),
    Template("unlicense", (Passage("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute")),)),
    named("proprietary", "all rights reserved"),
)
#: A place is one long: the passage's number above, its start below, moved up by REACH as it may lie before the text.
SHIFT, REACH = 33, 1 << 12


def passages_of(templates: tuple[Template, ...]) -> list[Passage]:
    """Every passage once; its number is its place here."""
    return list(dict.fromkeys(p for t in templates for p in t.passages))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BETWEEN), "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case. The faster lower() changes other letters too, which no word of a licence has; only two of
    them become ASCII letters, and texts with those take the exact way."""
    return F.when(text.rlike("[\u0130\u212a]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def document_frequencies(texts: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """How many files hold each mandatory word, over all files; and how many files there are. Every file counts for the
    empty word, which no file has."""
    own = F.array_append(F.array_intersect(words_of(lower_ascii(F.col("text"))), strings(vocabulary)), "")
    counted = {r.word: r["count"] for r in texts.select(F.explode(own).alias("word")).groupBy("word").count().collect()}
    return counted, counted.pop("", 0)


def _steps(number: int, passage: Passage, phrases: list[tuple[str, ...]]) -> Column:
    """passage, at (place of its first phrase), steps: from the last phrase to the first, with the distance to the next."""
    parts = passage.parts()
    gaps = [b - a for (a, _), (b, _) in zip(parts, parts[1:], strict=False)] + [0]
    steps = [
        F.struct(F.lit(phrases.index(tuple(k))).alias("phrase"), F.lit(len(k)).alias("size"), F.lit(gap).alias("gap"), F.lit(i == len(parts) - 1).alias("last"))
        for i, ((_, k), gap) in enumerate(zip(parts, gaps, strict=True))
    ]
    return F.struct(F.lit(number).alias("passage"), F.lit(parts[0][0]).alias("at"), F.array(*steps[::-1]).alias("steps"))


def phrases_of(passages: list[Passage]) -> list[tuple[str, ...]]:
    """Every key phrase once; its number is its place here."""
    return list(dict.fromkeys(tuple(k) for p in passages for _, k in p.parts()))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, slack: int = SLACK) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels (all), score, places (array of passage, start:
    where its first key phrase has it start)."""
    texts = texts_of(docs)
    passages = passages_of(templates)
    phrases = phrases_of(passages)
    vocabulary = sorted({w for k in phrases for w in k})
    df, n = document_frequencies(texts, vocabulary)
    idf = {w: math.log1p((n - df.get(w, 0) + 0.5) / (df.get(w, 0) + 0.5)) for w in vocabulary}
    postings: list[dict[str, list[int]]] = [{}, {}]
    for k, words in enumerate(phrases):
        at = {w: i for i, w in reversed(list(enumerate(words)))}
        rare = sorted(at, key=lambda w: (df.get(w, 0), w))
        for half, w in zip(postings, (rare[0], rare[min(1, len(rare) - 1)]), strict=True):
            half.setdefault(w, []).append((k << SHIFT) + REACH - at[w])
    anchors = sorted(set(postings[0]) | set(postings[1]))

    split = texts.select("doc_id", words_of(lower_ascii(F.col("text"))).alias("all"))
    may = F.arrays_overlap("all", strings(anchors))
    low = split.select("doc_id", F.size("all").cast("long").alias("n_words"), F.when(may, F.col("all")).otherwise(F.array().cast("array<string>")).alias("words"))

    def starts(half: dict[str, list[int]]) -> Column:
        """Places that the words of one half of the index point to, as longs, which are intersected by hashing."""
        index = F.create_map(*[c for w, ps in half.items() for c in (F.lit(w), F.array(*[F.lit(x).cast("long") for x in ps]))])
        here = F.filter("seen", lambda s: s["w"].isin(list(half)))
        return F.flatten(F.transform(here, lambda s: F.transform(F.element_at(index, s["w"]), lambda x: x + s["i"])))

    keys = F.array(*[F.struct(F.lit(len(k)).alias("size"), F.lit(" ".join(k)).alias("text")) for k in phrases])

    def stands(p: Column) -> Column:
        """The whole phrase in its place. Comparing the joined words keeps the length in the comparison."""
        key = F.element_at(keys, p["phrase"] + 1)
        return (p["start"] >= 0) & (F.array_join(F.slice("words", F.greatest(p["start"], F.lit(0)) + 1, key["size"]), " ") == key["text"])

    # each passage's phrases from the last to the first: what is left in the end are starts from which all others follow
    steps = F.array(*[_steps(k, p, phrases) for k, p in enumerate(passages)])

    def chained(p: Column) -> Column:
        def before(later: Column, step: Column) -> Column:
            here = F.transform(F.filter("stood", lambda q: q["phrase"] == step["phrase"]), lambda q: q["start"])
            # all starts from which a later one is near enough, met by hashing: linear, however often phrases stand
            reach = lambda y: F.sequence(y - step["gap"] - slack, F.least(y - step["gap"] + slack, y - step["size"]))
            return F.when(step["last"], here).otherwise(F.array_intersect(here, F.array_distinct(F.flatten(F.transform(later, reach)))))

        first = F.aggregate(p["steps"], F.array().cast("array<int>"), before)
        return F.transform(first, lambda x: F.struct(p["passage"].alias("passage"), (x - p["at"]).alias("start")))

    seen = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda s: s["w"].isin(anchors))
    found = low.select("doc_id", "n_words", "words", seen.alias("seen")).select("doc_id", "n_words", "words", F.array_intersect(starts(postings[0]), starts(postings[1])).alias("candidates"))
    decoded = F.transform("candidates", lambda c: F.struct(F.shiftright(c, SHIFT).cast("int").alias("phrase"), (c.bitwiseAND((1 << SHIFT) - 1) - REACH).cast("int").alias("start")))
    stood = found.select("doc_id", "n_words", "words", decoded.alias("decoded")).select("doc_id", "n_words", F.filter("decoded", stands).alias("stood"))
    none = F.array().cast("array<struct<passage:int,start:int>>")
    places = stood.select("doc_id", "n_words", F.when(F.size("stood") > 0, F.flatten(F.transform(steps, chained))).otherwise(none).alias("places"))
    places = places.withColumn("passages", F.array_distinct(F.transform("places", lambda p: p["passage"])))

    number = {p: k for k, p in enumerate(passages)}

    def labels(which: list[Template]) -> Column:
        held = [F.when(F.forall(F.array(*[F.lit(number[p]) for p in t.passages]), lambda k: F.array_contains("passages", k)), F.lit(t.label)) for t in which]
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*held)))), ",")

    base = [number[p] for t in templates if t.base for p in t.passages]
    base_starts = F.transform(F.filter("places", lambda p: p["passage"].isin(base)), lambda p: p["start"].cast("long"))
    weights = F.array(*[F.lit(round(sum(idf[w] for w in set(p.mandatory().values())), 6)) for p in passages])
    top = max(idf.values(), default=1.0) or 1.0
    evidence = F.aggregate(F.array_sort("passages"), F.lit(0.0), lambda s, k: s + F.element_at(weights, k + 1))
    out = places.withColumn("base", base_starts)
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base").alias("first_word"), F.array_max("base").alias("last_word"),
        labels([t for t in templates if t.base]).alias("base_labels"), labels(list(templates)).alias("labels"), F.round(evidence / (evidence + F.lit(round(top, 6))), 6).alias("score"), "places",
    )


def op3_licence_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents")).drop("places")


def _oracle() -> str:
    """Every word of every phrase at every word, without an index; then phrase after phrase."""
    passages = passages_of(TEMPLATES)
    phrases = phrases_of(passages)
    number = {p: k for k, p in enumerate(passages)}
    rows = ", ".join(f"({k}, {j}, '{w}', {len(words)})" for k, words in enumerate(phrases) for j, w in enumerate(words))
    parts = ", ".join(f"({k}, {j}, {phrases.index(tuple(words))}, {at}, {len(words)}, {len(p.parts())})" for k, p in enumerate(passages) for j, (at, words) in enumerate(p.parts()))
    needs = [(i, t.label, t.base, number[p], len(t.passages)) for i, t in enumerate(TEMPLATES) for p in t.passages]
    needed = ", ".join(f"({i}, '{label}', {str(base).lower()}, {k}, {n})" for i, label, base, k, n in needs)
    return f"""
WITH RECURSIVE p(phrase, rel, word, size) AS (VALUES {rows}), q(passage, j, phrase, pos, size, many) AS (VALUES {parts}), t(template, label, base, passage, needs) AS (VALUES {needed}),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM d),
v AS (SELECT * FROM w WHERE word IN (SELECT word FROM p)),
f AS (SELECT word, count(DISTINCT r) AS df FROM v GROUP BY word),
idf AS (SELECT word, ln(1 + ((SELECT count(*) FROM d) - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf FROM (SELECT DISTINCT word FROM p) LEFT JOIN f USING (word)),
weight AS (SELECT passage, round(sum(idf), 6) AS weight FROM (SELECT DISTINCT passage, word FROM q JOIN p USING (phrase)) JOIN idf USING (word) GROUP BY passage),
stood AS (SELECT r, phrase, i - rel AS start FROM v JOIN p USING (word) GROUP BY r, phrase, i - rel, size HAVING count(*) = size),
s AS (SELECT r, passage, j, start, pos, size, many FROM stood JOIN q USING (phrase)),
chain AS (SELECT r, passage, j, start AS first, start - pos AS place, start, pos, size, many FROM s WHERE j = 0
  UNION SELECT c.r, c.passage, s.j, c.first, c.place, s.start, s.pos, s.size, s.many FROM chain c JOIN s ON s.r = c.r AND s.passage = c.passage AND s.j = c.j + 1 AND s.start >= c.start + c.size AND abs(s.start - c.start - (s.pos - c.pos)) <= {SLACK}),
place AS (SELECT DISTINCT r, passage, place AS start FROM chain WHERE j = many - 1),
held AS (SELECT r, label, base FROM (SELECT DISTINCT r, passage FROM place) JOIN t USING (passage) GROUP BY r, template, label, base, needs HAVING count(*) = needs),
lab AS (SELECT r, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM held GROUP BY r),
b AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word FROM place WHERE passage IN (SELECT passage FROM t WHERE base) GROUP BY r),
e AS (SELECT r, sum(weight) AS e FROM (SELECT DISTINCT r, passage FROM place) JOIN weight USING (passage) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  round(coalesce(e, 0) / (coalesce(e, 0) + (SELECT round(max(idf), 6) FROM idf)), 6) AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN lab USING (r) LEFT JOIN e USING (r)"""


ORACLE = {"op3_licence_positions": _oracle()}
