import numpy as np
import pytest
import xxhash

from corpusmill.llm import simhash as S


def naive_fingerprint(text, width=3):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(rows, width=3):
    prints = {(d, t): naive_fingerprint(t or "", width) for d, t in rows}
    fps = sorted(set(prints.values()))
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for (d, _), f in prints.items():
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    return sorted(((d, prints[d, t], least.get(find(prints[d, t]))) for d, t in rows), key=repr)


def texts():
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words, n)) for n in rng.integers(1, 900, 40)]
    out = list(base)
    for t in base[:25]:
        for _ in range(4):
            w = t.split()
            for _ in range(max(1, len(w) // 150)):
                w[int(rng.integers(len(w)))] = "changed"
            out.append(" ".join(w))
    return [*out, *base[:5], None, "", " \t\n", "One", "one two", "ÀB Àb\x0bcc\x0cdd", "x" * 200_000, "a b c " * 60_000, None]


def got(df):
    return sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in df.collect()), key=repr)


@pytest.mark.parametrize("tile", [S.TILE, 2])
def test_matches_brute_force(spark, tile):
    rows = list(enumerate(texts()))
    rows = [(7 * d + 3, t) for d, t in rows][::-1] + [(3, rows[0][1]), (None, "one two"), (None, "alone it stands here and there")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, fp int, component_id string")
    assert got(S.near_duplicates(df, 3, tile)) == naive_components(rows)


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    near = base.copy()
    for i in range(len(near)):
        for b in rng.choice(64, i % 6, replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    fps = np.concatenate([base, near])
    for radius in (0, 1, 2, 3, 5, 8, 20):
        q, w = S.within(fps[:200], S.bit_planes(fps), len(fps), radius)
        want = {(i, j) for i in range(200) for j in range(len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= radius}
        assert set(zip(q.tolist(), w.tolist(), strict=True)) == want and len(q) == len(want)


def test_any_two_blocks_lose_nothing():
    masks = S._masks()
    rng = np.random.default_rng(2)
    for _ in range(500):
        d = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(d & m % (1 << 64) == 0 for m in masks)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(df).count() == 0
