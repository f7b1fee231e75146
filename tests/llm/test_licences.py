import re
import time

import duckdb

from corpusmill.llm import licences as L
from corpusmill.llm.common import read

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " .,! ", "MIT License", "mit-LICENSE", "The MIT  License. mit license; MIT\nlicense", "mit licence", "éMIT license", "license mit", "general public License VERSION 3",
    "gnu lesser general public license", "permission is hereby granted, free of charge", "Permission is hereby granted, free of charge. The software is provided \"as is\"", "mit mit license license",
    *(" ".join(p.text for p in t.passages) for t in L.TEMPLATES),
    *(" -- ".join(p.text.replace("the", "THE") for p in reversed(t.passages)) for t in L.TEMPLATES),
    "x " + L.AS_IS.text.replace("express or implied", "be it so"), L.AS_IS.text.replace("as is without", "as is and without"), L.TEMPLATES[3].passages[0].text,
    "is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
    L.TEMPLATES[3].passages[0].text.replace("documentation files", "documents files") + " copies. " + L.AS_IS.text, "all rights reserved", "apache apache license version 2.0 apache license", "cc by nc 4.0, licensed under CC BY-NC", "admit license", "MIT LİCENSE; MIT LICENSE \u212a", "\u212aey MIT License É", "mit licen\u017fe", "MİT license", "word " * 60_000 + "MIT License", "mit license " * 20_000, "license\x00general\x7fpublic license",
]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    places, where = [], {}
    for i, w in enumerate(words):
        where.setdefault(w, []).append(i)
    for t in L.TEMPLATES:
        for p in t.passages:
            need = p.mandatory()
            rel = min(need)
            for i in where.get(need[rel], ()):
                if all(0 <= i - rel + at < len(words) and words[i - rel + at] == w for at, w in need.items()):
                    places.append((t, p, i - rel))
    starts = [i for t, _, i in places if t.base]
    have = {p for _, p, _ in places}
    held = [t for t in L.TEMPLATES if set(t.passages) <= have]
    labels = lambda ts: ",".join(sorted({t.label for t in ts}))
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), labels([t for t in held if t.base]), labels(held)


def chains(words, passage, slack=L.SLACK):
    """Starts of a passage: all ways to place its phrases one after the other."""
    parts = passage.parts()
    open_ = [(i - parts[0][0], i) for i in range(len(words)) if words[i : i + len(parts[0][1])] == parts[0][1]]
    for (a, k), (b, after) in zip(parts, parts[1:]):
        open_ = [(first, j) for first, i in open_ for j in range(i + len(k), min(len(words), i + b - a + slack + 1)) if abs(j - i - (b - a)) <= slack and words[j : j + len(after)] == after]
    return {first for first, _ in open_}


def test_words_between_phrases_may_come_and_go(spark):
    mit = next(t for t in L.TEMPLATES if t.label == "mit" and len(t.passages) > 1)
    whole = " ".join(p.text for p in mit.passages)
    texts = {
        "as it is": whole, "inserted": whole.replace("associated documentation", "its associated documentation"), "and": whole.replace("as is without", '"as is" and, without'),
        "dropped": whole.replace("and associated documentation", "and documentation"), "wrapped": whole.replace(" ", "\n * ").upper(), "far": whole.replace("as is without", "as is " + "word " * 40 + "without"),
        "backwards": " ".join(" ".join(k) for p in mit.passages for _, k in reversed(p.parts())),
    }
    rows = list(enumerate([*texts.values(), *ODD[:-4]]))
    out = {r.doc_id: r for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    passages = L.passages_of(L.TEMPLATES)
    for i, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        if len(words) < 5000:
            assert {(p.passage, p.start) for p in out[i].places} == {(k, at) for k, p in enumerate(passages) for at in chains(words, p)}
    held = {name: "mit" in out[i].labels.split(",") for i, name in enumerate(texts)}
    assert held == {"as it is": True, "inserted": True, "and": True, "dropped": True, "wrapped": True, "far": False, "backwards": False}
    assert out[1].score == out[0].score == out[2].score


def test_matches_brute_force(spark):
    rows = [*enumerate(ODD), (5, ODD[5]), (None, ODD[3])]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, labels string")
    out = L.scan(df).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in out), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=repr)
    assert all((r.score > 0) == bool(r.places) and 0 <= r.score <= 1 for r in out)
    assert L.scan(df.limit(0)).count() == 0


def test_a_million_words_take_seconds(spark):
    """Every word of a very long text is an index word; places are found in linear time."""
    texts = ["mit license " * 500_000, "general public license " * 300_000 + "version 3"]
    began = time.monotonic()
    out = L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "n_words", "n_base", "last_word", "labels").orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == [(0, 1_000_000, 500_000, 999_998, "mit"), (1, 900_002, 300_000, 899_997, "gpl,gpl-3.0")]
    assert time.monotonic() - began < 60
    began = time.monotonic()
    phrases = (L.AS_IS.text + " ") * 30_000
    out = L.scan(spark.createDataFrame([(1, phrases)], "doc_id long, text string")).select(L.F.size("places").alias("n")).first()
    assert out.n == 30_000 and time.monotonic() - began < 60


def test_query_matches_sql_and_stays_native(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = db.execute(L.ORACLE["op3_licence_positions"]).fetchall()
    out = L.op3_licence_positions(spark, SF).select([d[0] for d in db.description])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    got = out.collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert read(spark, SF, "documents").count() == len(got)
