import random

from corpusmill.llm import decontaminate as D


def best_match(pattern, text):
    """Least edits of pattern to any stretch of text, by the plain table."""
    row, best = list(range(len(pattern) + 1)), len(pattern)
    for w in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(new[i - 1] + 1, row[i] + 1, row[i - 1] + (p != w)))
        row = new
        best = min(best, row[-1])
    return best


def fixture(seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choices(words, k=r.choice([5, 9, 10, 17, 30, 80])))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "too short"), (93, "Three Quite-long words"), (95, "天地玄黃宇宙洪荒日月盈昃"), (96, "w1 w2 w3"), (97, items[3][1]), (3, items[3][1]), (94, " ".join(words[:40]))]
    docs = []
    for d in range(120):
        out = r.choices(words, k=r.randrange(0, 60))
        for _ in range(r.randrange(3)):
            passage = D.words_of(r.choice(items[:25])[1])
            for _ in range(r.randrange(0, len(passage) // 4 + 2)):
                at = r.randrange(len(passage)) if passage else 0
                passage[at : at + r.choice([0, 1])] = r.choice([[], ["new"], ["w1", "x"]])
            out += passage + r.choices(words, k=5)
        docs.append((d, ", ".join(out).upper()))
    return docs + [(200, None), (201, ""), (None, items[4][1]), (7, docs[7][1]), (300, (items[5][1] + " . ") * 500), (301, "so three quite long words too short"), (302, "三字經：天地玄黃，宇宙洪水日月盈昃。"), (303, "天地 hi"), (304, "three quite wrong words")], items


def want(docs, items, least=0):
    out = {}
    for d, t in docs:
        for i, x in items:
            p = D.words_of(x or "")
            if p and sum(map(len, p)) >= least and (e := best_match(p, D.words_of(t or ""))) <= int(0.2 * len(p)):
                out[d, i] = min(e, out.get((d, i), 99))
    return out


def test_matches_brute_force(spark, monkeypatch):
    docs, items = fixture()
    df = spark.createDataFrame([(d, t, 5) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    expected = want(docs, items)
    for block in (D.BLOCK_ITEMS, 7):
        monkeypatch.setattr(D, "BLOCK_ITEMS", block)
        rows = D.leaks(df, bench).collect()
        assert {(r.doc_id, r.item_id): r.edits for r in rows} == expected and len(rows) == len(expected)
    by_id = dict(docs)
    for r in rows:
        text = D.words_of(by_id[r.doc_id])
        assert best_match(D.words_of(dict(items)[r.item_id]), text[r.first_word : r.last_word + 1]) == r.edits
    assert {(301, 93), (302, 95)} <= expected.keys() and 304 not in {d for d, _ in expected}
    assert {r.item_id: r.reason for r in D.skipped(bench).collect()} == {90: "no_words", 91: "no_words"}
    assert {r.item_id: r.reason for r in D.skipped(bench, 12).collect()} == {90: "no_words", 91: "no_words", 92: "under_least_letters", 96: "under_least_letters"}
    long = {(r.doc_id, r.item_id): r.edits for r in D.leaks(df, bench, min_letters=12).collect()}
    assert long == want(docs, items, 12) and len(long) < len(expected)
    clean = {r.doc_id for r in D.without_leaks(df, bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in expected}


def test_a_piece_that_thousands_of_items_share():
    """Items of one wording that differ in a few words: texts with the wording alone are settled without looking at places."""
    r = random.Random(4)
    stem = [f"s{i}" for i in range(24)]
    items = [(i, " ".join([*stem, *(f"own{i}x{j}" for j in range(12))])) for i in range(5000)]
    index = D.PieceIndex.of(items, 0.2, 5)
    looked = []
    index_verify = index._verify
    index._verify = lambda words, k, starts: looked.append(k) or index_verify(words, k, starts)
    texts = [" ".join(stem) + " and " + " ".join(r.choices(stem, k=300)), (items[77][1] + " ") * 3, " ".join(stem * 200)]
    found = index.matches(texts)
    assert found[0] == {} and found[2] == {} and {index.ids[k][0] for k in found[1]} == {77} and len(looked) < 10


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.leaks(docs, none).count() == 0 and D.leaks(some, none).count() == 0
    assert D.without_leaks(some, none).count() == 1


def test_pieces_cover_an_item():
    for m in range(5, 90):
        pieces = D.pieces_of(m, int(0.2 * m))
        assert pieces[0][0] == 0 and sum(n for _, n in pieces) == m and min(n for _, n in pieces) >= 2


def test_short_items_are_found(spark):
    docs = spark.createDataFrame([(1, "Everyone knows: 2 + 2 = 5, he said."), (2, "And who is he? Nobody."), (3, "2 + 5 is he")], "doc_id long, text string")
    items = spark.createDataFrame([(10, "2 + 2 = 5"), (11, "Who is he?")], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.edits) for r in D.leaks(docs, items).collect()} == {(1, 10, 0), (2, 11, 0)}
    assert [r.doc_id for r in D.without_leaks(docs, items).collect()] == [3]
