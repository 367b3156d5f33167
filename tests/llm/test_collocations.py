import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plainsight.llm import collocations, queries

SCHEMA = "doc_id long, text string, lang string"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_count, top, max_words=5):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        inside = collections.Counter()
        for p, a in candidates.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside[p[i:j]], a)
        scored = []
        for p, a in candidates.items():
            if inside[p] < a:
                cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        scored.sort()
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(scored[:top])]
    return sorted(out)


def corpus(seed, n, vocabulary, copies):
    """Random text with passages that repeat, so that rare words score high and nested phrases tie."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "é", "x-y", "B"]
    passages = [[rng.choice([f"r{rng.randrange(60)}", rng.choice(words)]) for _ in range(rng.randrange(2, 9))] for _ in range(12)]
    rows = []
    for _ in range(n):
        text = []
        for _ in range(rng.randrange(6)):
            text += rng.choice(passages) if rng.random() < copies else [words[min(int(rng.expovariate(0.2)), len(words) - 1)] for _ in range(rng.randrange(9))]
            text.append(rng.choice([".", ",", "\n", "\t", " ", "", "\x0b", "? "]))
        rows.append((" ".join(text), rng.choice(["en", "en", "en", None, "und", "de"])))
    return rows


def mined(spark, rows, **options):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).withColumn("RANK", F.lit(1)).repartition(5)
    got = collocations.mine(df, filter_bits=18, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("seed, top, min_count, first_share", [(1, 2000, 3, 8), (2, 5, 2, 8), (3, 3, 4, 2)])
def test_phrases_equal_brute_force(spark, seed, top, min_count, first_share):
    rows = corpus(seed, 400, 40, 0.5) + [(None, "en"), ("", "en"), ("alone", "xx"), (" . , ", None)]
    want = brute(rows, min_count, top)
    assert len(want) > 8
    assert mined(spark, rows, min_count=min_count, top=top, first_share=first_share) == want


def test_one_language_one_phrase_and_ties(spark):
    rows = [("aa bb cc dd ee ff", "en")] * 30 + [("Z b", "en")] * 30 + [("ä b", "en")] * 30
    for top in (1, 2, 3, 50):
        assert mined(spark, rows, min_count=5, top=top) == brute(rows, 5, top)


def test_long_texts_and_long_words(spark):
    rows = [("ab cd " * 40_000, "en"), (("x" * 100_000 + " y ") * 4, "en"), ("ab cd", "de")]
    assert mined(spark, rows, min_count=3, top=10) == brute(rows, 3, 10)


def test_empty_table(spark):
    assert mined(spark, [], min_count=2) == []
    assert mined(spark, [(None, None), ("a", "en")], min_count=2) == []


def test_a_full_first_frontier_settles_without_the_frequent_words(spark, monkeypatch):
    """The bound stops the growth: phrases between frequent words are never counted."""
    rng = random.Random(1)
    rows = [(" ".join(rng.choice("abcdefgh") for _ in range(60)), "en") for _ in range(300)]
    rows += [(f"p{i} q{i} s{i} t{i}", "en") for i in range(40) for _ in range(5)]
    counted = []
    inner = collocations.phrase_counts

    def spy(texts, size, *rest):
        counts = inner(texts, size, *rest)
        counted.append((size, counts.count()))
        return counts

    monkeypatch.setattr(collocations, "phrase_counts", spy)
    got = mined(spark, rows, min_count=5, top=20)
    assert got == brute(rows, 5, 20)
    assert counted == [(2, 120), (3, 80), (4, 40), (5, 0)]


def test_filters_of_a_fixed_size(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(-(1 << 63), 1 << 63, 3000)
    for bits in (15, 20):
        found = collocations.filter_of(spark.createDataFrame([(int(k),) for k in keys], "key long"), bits)
        assert len(found.table) == (1 << min(bits, 16)) // 8
        assert found.has(keys.view(np.uint64)).all()
        assert found.has(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)).mean() < 3000 / (8 * len(found.table)) * 1.5
    assert not collocations.filter_of(spark.createDataFrame([], "key long"), 16).has(keys.view(np.uint64)).any()


def test_windows():
    w = collocations.Windows(pa.array(["en", None, "und"]), pa.array(["A b.c d e", "a b", "a  b\tc"]))
    assert [w.phrase(i, 2) for i in w.of(2)[0]] == ["a b", "c d", "d e", "a b", "a b", "b c"]
    assert [w.phrase(i, 3) for i in w.of(3)[0]] == ["c d e", "a b c"]
    start, keys = w.of(2)
    assert keys[start[3]] == keys[start[4]] != keys[start[0]]


def test_registered_query(spark, data):
    df = queries.QUERIES["op12_collocations"](spark, data)
    assert [f.simpleString() for f in df.schema] == [
        "lang:string", "rank:bigint", "phrase:string", "a:bigint", "l:bigint", "r:bigint", "n:bigint", "score:bigint"]
    rows = [(r["text"], r["lang"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in df.collect()) == brute(rows, 100, 2000)
