import itertools
import random

import numpy as np
import pyarrow as pa

from plainsight.llm import caps, minhash
from plainsight.llm.graph import components
from plainsight.llm.words import hashed_words, shingle_sets
from corpora import corpus  # noqa: F401
from test_filters import ODD


def grouped(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    want = grouped({x for e in edges for x in e}, edges)
    df = spark.createDataFrame(edges, "x long, y long").repartition(5)
    for limit in (500_000, 20):
        got = {r["node"]: r["component"] for r in components(df, limit).collect()}
        assert all(got.get(n, n) == c for n, c in want.items())
    assert components(df.limit(0)).count() == 0


def test_words():
    texts = pa.array(["Ab c", "", None, "é É x\x0by\x1fz  ", "q", "Ab  c d"] * 3)
    seen = {}
    for a, b in ((0, 18), (1, 7), (5, 6)):
        part = texts.slice(a, b - a)
        hashes, at = hashed_words(part)
        for i, text in enumerate(part.to_pylist()):
            words = (text or "").encode().lower().split()
            assert at[i + 1] - at[i] == len(words)
            assert all(seen.setdefault(w, h) == h for w, h in zip(words, hashes[at[i] : at[i + 1]]))
    assert len(set(seen.values())) == len(seen)


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(5)
    for shared, own in ((80, 10), (5, 1), (400, 400)):
        errors = []
        for _ in range(40):
            x = rng.integers(0, 1 << 63, shared + 2 * own, dtype=np.uint64)
            sets = np.concatenate([x[: shared + own], x[:shared], x[shared + own :]])
            sig = minhash.superminhash(sets, np.array([0, shared + own, 2 * (shared + own)]), 128, chunk=97)
            errors.append((sig[0] == sig[1]).mean() - shared / (shared + 2 * own))
        assert abs(np.mean(errors)) < 0.02
        # Independent hashes would vary by sqrt(j (1 - j) / 128).
        j = shared / (shared + 2 * own)
        assert np.std(errors) < 1.3 * np.sqrt(j * (1 - j) / 128)


def word_sets(rows, size):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
        if i is not None and s:
            sets.setdefault(i, []).append(frozenset(s))
    return sets


def test_near_duplicates(spark, corpus):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = list(ODD) + [(8, "one"), (9, "ONE "), (5, "another text of the same id"), (200, "another text of the same id")]
    for family in range(6):
        base = rng.choices(vocabulary, k=rng.choice([12, 60, 150]))
        for k in range(25):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 9))):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((1000 + 100 * family + k, " ".join(text)))
    rng.shuffle(rows)
    for size in (2, 5):
        sets = word_sets(rows, size)
        links = [
            (a, b) for a, b in itertools.combinations(sets, 2) if any(100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])
        ]
        want = grouped({i for i, _ in rows if i is not None}, links)
        got = minhash.near_duplicates(corpus(rows, ["component_id", "n", "key"]), size=size).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])
            assert r["kept"] == (r["doc_id"] is None or r["component_id"] == r["doc_id"])
        assert len({c for c in want.values()}) < len(want) - 50
    kept = minhash.drop_near_duplicates(corpus(rows))
    assert kept.count() == sum(r["kept"] for r in got)
    assert minhash.near_duplicates(corpus([])).count() == 0


def test_pairs_that_meet_only_in_buckets_of_two(spark, corpus):
    # 3 is a near copy of 2, and shares other buckets with 1, which is like neither.
    rng = random.Random(11)
    rows = []
    for k in range(0, 400, 10):
        base = [f"w{k}x{i}" for i in range(60)]
        near = list(base)
        for i in rng.sample(range(60), 2):
            near[i] = f"w{k}y{i}"
        at = rng.randrange(25)
        rows += [(k + 1, " ".join([f"w{k}z{i}" for i in range(25)] + base[at : at + 35])), (k + 2, " ".join(near)), (k + 3, " ".join(base))]
    sets = word_sets(rows, 2)
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if any(100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])]
    want = grouped({i for i, _ in rows}, links)
    assert all(want[i] == (i - 1 if i % 10 == 3 else i) for i, _ in rows)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(corpus(rows), size=2).collect()}
    assert got == want


def test_shingles_of_short_texts():
    h, at = shingle_sets(pa.array(["a b", "A  B", "b a", "a b c d e", "", None]), 5)
    assert np.diff(at).tolist() == [1, 1, 1, 1, 0, 0] and h[0] == h[1] != h[2]


def test_cap_filters(spark):
    rng = np.random.default_rng(7)
    rows, n = [], 0
    for label in (0, 1):
        for size, noise in ((150, 0.02), (40, 0.03), (60, 0.0)):
            centre = rng.normal(size=24)
            for _ in range(size):
                rows.append((n, (centre + noise * rng.normal(size=24) * np.linalg.norm(centre)).tolist(), label))
                n += 1
        rows += [(n + i, rng.normal(size=24).tolist(), label) for i in range(200)]
        n += 200
    bad = [None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23]
    rows += [(n + i, v, 1) for i, v in enumerate(bad)] + [(n + 10, rows[0][1], None), (None, rows[0][1], 0), (n + 11, [1.0, 2.0], 0), (n + 12, [2.0, 4.0], 0)]
    rows.append(rows[3])
    got = caps.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == len(rows)
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    links, counts = [], dict.fromkeys((r[0] for r in rows), 0)
    for a, b in itertools.combinations(ok, 2):
        if a[2] == b[2] and len(a[1]) == len(b[1]):
            x, y = np.array(a[1]), np.array(b[1])
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                links.append((a[0], b[0]))
                counts[a[0]] += 1
                counts[b[0]] += b[0] != a[0]
    want = grouped({r[0] for r in rows if r[0] is not None}, links)
    found = sum(r["n_links"] for r in got if r["vec_id"] != 3)
    assert found >= 0.999 * sum(c for i, c in counts.items() if i != 3) and found <= sum(c for i, c in counts.items() if i != 3)
    for r in got:
        if r["vec_id"] is None:
            assert r["component_id"] is None and r["n_links"] == 0 and r["kept"]
        else:
            assert r["component_id"] == want[r["vec_id"]] and r["kept"] == (want[r["vec_id"]] == r["vec_id"])
    assert caps.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_texts_reach_the_shingles_in_small_slices(spark, corpus, monkeypatch):  # noqa: F811
    sizes, plain = {}, minhash.with_arrays

    def noted(*args, **options):
        sizes[args[2].fieldNames()[-1]] = options.get("max_bytes", 4 << 20)
        return plain(*args, **options)

    monkeypatch.setattr(minhash, "with_arrays", noted)
    words = " ".join(f"w{i}" for i in range(50))
    found = minhash.near_duplicates(corpus([(1, words), (2, words + " x"), (3, "other")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(1, 1), (2, 1), (3, 3)]
    assert sizes and max(sizes.values()) <= 1 << 20
