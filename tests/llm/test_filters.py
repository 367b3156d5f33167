import collections
import random
import time

import numpy as np
import pytest

from plainsight.llm import decontaminate, lines, toxicity
from plainsight.llm.rows import fold_of
from corpora import corpus  # noqa: F401

ODD = [(1, None), (2, ""), (3, " "), (None, "no id"), (4, "x" * 300_000), (5, "same"), (5, "same"), (6, "\n\n"), (7, "é\x0bÀ\x1f\n  É  ")]


def brute_lines(rows, min_docs):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    docs = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            docs[key(line)].add(("id", i) if i is not None else ("text", t))
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if not key(x) or len(docs[key(x)]) < min_docs]
        out.append((i, t if len(kept) == len(all_) else "\n".join(kept), len(all_), len(all_) - len(kept)))
    return out


def order(rows):
    return sorted(rows, key=repr)


def test_lines(spark, corpus):
    rng = random.Random(1)
    pool = ["a", "A ", "b\t", "", "Straße", "c d", "É", "é"]
    rows = ODD + [(100 + i, "\n".join(rng.choices(pool + [str(i)], k=rng.randint(0, 6)))) for i in range(60)]
    got = lines.drop_common_lines(corpus(rows, ["N_Lines", "doc", "_gone"]), min_docs=3)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "doc", "_gone", "n_lines", "n_dropped"]
    assert order(tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_dropped").collect()) == order(brute_lines(rows, 3))
    assert lines.drop_common_lines(corpus([])).count() == 0


def test_lines_stay_in_the_jvm(spark, corpus):
    plan = lines.drop_common_lines(corpus([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.fixture(scope="module")
def toxic(spark, corpus):
    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        text = rng.choices(words, k=40) + (["vileness" + rng.choice(["", "s", "xy"])] * 2 if bad else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark, corpus, toxic):
    rows, labels = toxic
    # Labels of the held-out fold are turned round: reading them would show.
    told = spark.createDataFrame([(i, 1 - t if fold_of(i, 3) == 1 else t) for i, t in labels], "doc_id long, toxic int")
    docs = corpus(rows + ODD, ["score"])
    model = toxicity.train(docs, told)
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "predicted"]
    found = {r["doc_id"]: r for r in got.collect()}
    truth = dict(labels)
    held = [i for i in truth if fold_of(i, 3) == 1]
    right = sum(found[i]["predicted"] == truth[i] for i in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found.values())
    assert found[1]["score"] is not None
    kept = toxicity.drop_toxic(docs, told)
    assert kept.columns == docs.columns and kept.count() == got.where("predicted = 0").count()


def test_toxicity_without_examples(spark, corpus):
    none = spark.createDataFrame([(1, 0), (None, 1), (3, None), (3, 7)], "doc_id long, toxic int")
    docs = corpus(ODD)
    assert {r[0] for r in toxicity.score(docs, toxicity.train(docs, none)).select("score").collect()} == {0.0}
    assert toxicity.score(corpus([]), toxicity.train(corpus([]), none.limit(0))).count() == 0


def test_risk_is_corrected_for_the_prior():
    # Half of the unlabelled examples are positive: a classifier that took them for negatives would score positives 0.5.
    n = 400
    features = np.concatenate([np.zeros(n, int), np.arange(n) % 2])
    w = toxicity.fit_nnpu(np.arange(2 * n + 1), features, np.arange(n), np.arange(n, 2 * n), 0.5, 2, 0)
    assert 1 / (1 + np.exp(-(w[0] + w[2]))) > 0.9 and 1 / (1 + np.exp(-(w[1] + w[2]))) < 0.1


def semi_global(a, b):
    last = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return min(last)


def test_passages_against_alignment():
    rng = random.Random(3)
    words = ["the", "and", "thon", "ering", "tion", "able", "re", "xeno", "quart", "mit"]
    items = [" ".join(rng.choices(words, k=rng.randint(4, 30))) for _ in range(20)]
    index = decontaminate.PassageIndex(list(range(20)), items, 8, 0.08)
    hits = 0
    for _ in range(40):
        docs = []
        for _ in range(3):
            item = list(rng.choice(items))
            for _ in range(rng.randint(0, int(0.12 * len(item)))):
                at, kind = rng.randrange(len(item)), rng.random()
                item[at : at + (kind < 0.7)] = [rng.choice("abcxyz ")] if kind < 0.4 or kind >= 0.7 else []
            docs.append(" ".join(rng.choices(words, k=9)) + "\n" + "".join(item) + " " + " ".join(rng.choices(words, k=rng.randint(0, 9))))
        for doc, found in zip(docs, index.find(docs)):
            text = "".join(map(chr, decontaminate.normalised(doc)[0]))
            best = {}
            for i, start, end, edits in found:
                best[i] = min(edits, best.get(i, edits))
                assert 0 <= start < end <= len(doc)
            for i, budget in enumerate(index.budget):
                edits = semi_global(items[i], text)
                assert best.get(i) == (edits if edits <= budget else None)
                hits += edits <= budget
    assert hits > 50


def test_short_passages():
    rng = random.Random(4)
    items = ["q", "zw", "seven 7", "eight888", "twelve chars", "thirteen char", "fourteen chars", "fifteen chars x", "sixteen chars xy", " "]
    index = decontaminate.PassageIndex(list(range(10)), items, 8, 0.08)
    docs, hits = [""], 0
    for _ in range(200):
        item = list(rng.choice(items))
        for _ in range(rng.randint(0, 2)):
            at, kind = rng.randrange(len(item) + 1), rng.random()
            item[at : at + (kind < 0.7)] = [rng.choice("abc ")] if kind < 0.4 or kind >= 0.7 else []
        docs.append(rng.choice(["", "ab ", "x" * 50]) + "".join(item) + rng.choice(["", " ba"]))
    for doc, found in zip(docs, index.find(docs)):
        text = "".join(map(chr, decontaminate.normalised(doc)[0]))
        best = {}
        for i, start, end, edits in found:
            best[i] = min(edits, best.get(i, edits))
            assert 0 <= start < end <= len(doc)
        want = {i: semi_global(x, text) for i, x in enumerate(items) if x.strip()}
        want = {i: n for i, n in want.items() if n <= int(0.08 * len(items[i]))}
        assert best == want
        hits += len(want)
    assert hits > 100
    assert index.find(["a zw", "zw zw"]) == [[(1, 2, 4, 0)], [(1, 0, 2, 0), (1, 3, 5, 0)]]


def test_decontamination(spark, corpus):
    items = [(1, "The quick brown fox jumps over the lazy dog near the river bank."), (2, None), (3, "short"), (None, "An item without an identifier, found all the same, of course."), (1, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = ODD + [(10, "before " + items[0][1].upper().replace(" ", "\n ") + " after"), (11, "x" * 50_000 + items[0][1]), (12, items[3][1]), (13, items[0][1][:30])]
    docs = corpus(rows, ["found"])
    for block in (4_000_000, 40):
        marked = decontaminate.mark(docs, benchmark, block_chars=block)
        found = {r["doc_id"]: [x["item_id"] for x in r["found"]] for r in marked.where("size(found) > 0").collect()}
        assert found == {10: [1], 11: [1], 12: [None]}
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    spans = {r["doc_id"]: r for r in decontaminate.passages(docs, benchmark).collect()}
    assert rows[-4][1][spans[10]["start"] : spans[10]["end"]].split() == items[0][1].upper().split()
    assert decontaminate.mark(corpus([]), benchmark).count() == 0
    assert decontaminate.drop_contaminated(docs, benchmark.limit(0)).count() == len(rows)


def test_lines_of_very_long_texts(spark, corpus):
    """A text is split once, whatever its lines: half a million of them take seconds."""
    n = 500_000
    long = "\n".join(f"line {i}" if i % 1000 else "common" for i in range(n))
    start = time.monotonic()
    got = lines.drop_common_lines(corpus([(1, long), (2, "common"), (3, "a\nCOMMON \nb")]), min_docs=3)
    found = {r["doc_id"]: r for r in got.collect()}
    assert time.monotonic() - start < 60
    assert found[1]["text"] == "\n".join(f"line {i}" for i in range(n) if i % 1000)
    assert (found[1]["n_lines"], found[1]["n_dropped"]) == (n, n // 1000)
    assert (found[2]["text"], found[3]["text"]) == ("", "a\nb")


def test_one_text_per_labelled_id_reaches_the_fit(spark, corpus, monkeypatch):
    """A labelled id that many rows share counts as one example."""
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(words, 20)) + (" vile" if i % 3 == 0 else "")) for i in range(90)]
    labels = spark.createDataFrame([(i, None, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int")
    held = []
    inner = toxicity.stored

    def spy(df, label):
        kept = inner(df, label)
        held.append((label, kept.count()))
        return kept

    monkeypatch.setattr(toxicity, "stored", spy)
    often = next(i for i in range(0, 90, 3) if fold_of(i, 3) != 1)
    hot = [(often, f"{rows[often][1]} copy {k}") for k in range(300)]
    model = toxicity.train(corpus(rows + hot), labels)
    assert dict(held)["toxic-examples"] == dict(held)["toxic-labels"] == sum(fold_of(i, 3) != 1 for i in range(90))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(corpus(rows), model).collect()}
    assert min(s for i, s in scores.items() if i % 3 == 0) > max(s for i, s in scores.items() if i % 3)


def test_blocks_of_a_large_benchmark_are_stored_between_passes(spark, corpus):
    rng = np.random.default_rng(6)
    items = [(i, " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(12))) for i in range(12)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = [(i, f"before {items[i % 12][1]} after") for i in range(24)] + [(100, "nothing here"), (101, None)]
    one, many = (decontaminate.mark(corpus(docs), benchmark, block_chars=n) for n in (10_000, 100))
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    key = lambda df: sorted((r["doc_id"], sorted(x["item_id"] for x in r["found"])) for r in df.collect())
    assert key(one) == key(many) and dict(key(one))[5] == [5] and dict(key(one))[100] == []
