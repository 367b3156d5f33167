import random

import pyarrow as pa
import pytest

from plainsight.llm import licenses, queries
from corpora import corpus  # noqa: F401

BASE = licenses.PHRASES


def brute(text):
    """Counts and labels of the phrases alone, word by word."""
    words = licenses.split_words(text or "")
    places = [(i, label) for label, p in BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


TEXTS = [
    None, "", "   ", "MIT", "under the MIT license", "UNDER-THE-mit_LICENSE!", "under the mit licensee", "thunder the mit license",
    "Apache License, Version 2.0", "apache license version 20", "cc by nc cc by nc by", "CC-BY-NC 4.0", "é under the mit license ü",
    "under the\nmit\tlicense" * 3, "x" * 300_000 + " under the mit license", "under the mit " * 5000 + "license cc by nc",
    "cc by nc", "apache license version 2 under the mit license cc by nc", "license under the mit", "İ cc by nc",
]


def test_phrases_equal_brute_force(spark, corpus):
    rng = random.Random(3)
    pool = "under the mit license apache version 2 cc by nc license, the-mit licensé".split()
    texts = TEXTS + [" ".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(400)]
    df = corpus(list(enumerate(texts)) + [(4, TEXTS[4]), (None, TEXTS[5])], clash=["N_words", "found"]).repartition(4)
    found = licenses.find(df)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words", "found"]
    got = licenses.digest(found).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = TEXTS[5] if r["doc_id"] is None else texts[r["doc_id"]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(text)
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


NOTICES = {
    "gpl-3": "Foo.\nThis work is licensed under the GNU General Public License, version 3.",
    "gpl-2": "This work is licensed under the GNU General Public License version 2",
    "lgpl-3": "This work is licensed under the GNU Lesser General Public License, version 3",
    "isc": next(t.text for t in licenses.TEMPLATES if t.label == "isc"),
    "bsd-2-clause": "// Redistribution and use in source and binary forms, with or without changes, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "": "This work is licensed to nobody. The general public knows version 3 of the license, and the software is public.",
}


def test_notices_are_found_by_their_rare_words(spark, corpus):
    filler = "and the of to in is that it was this work version general public".split()
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(filler, k=50)) + " | " + notice + " | " + " ".join(rng.choices(filler, k=50))) for i, notice in enumerate(NOTICES.values())]
    rows += [(100 + i, " ".join(rng.choices(filler, k=80))) for i in range(200)]
    got = {r["doc_id"]: r for r in licenses.find(corpus(rows)).collect()}
    for i, label in enumerate(NOTICES):
        assert {x["label"] for x in got[i]["found"]} == ({label} if label else set()), label
        for x in got[i]["found"]:
            assert abs(x["first_word"] - 50) <= 4 and 0.75 <= x["score"] <= 1
    assert all(not got[100 + i]["found"] for i in range(200))


def test_key_phrases_are_mandatory(spark, corpus):
    template = licenses.Template("t", "alpha beta gamma delta epsilon zeta eta theta", ("gamma delta",))
    rows = [(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "alpha beta gamma x delta epsilon zeta eta theta"),
            (3, "gamma delta " + "y " * 40 + "alpha beta gamma x delta epsilon zeta eta theta"), (4, "beta gamma delta epsilon zeta eta"),
            (5, "gamma delta alpha")]
    got = {r["doc_id"]: r["found"] for r in licenses.find(corpus(rows), [], [template], min_share=0.6).collect()}
    assert [len(got[i]) for i in (1, 2, 3, 4, 5)] == [1, 0, 0, 1, 0]
    assert got[4][0]["first_word"] == 0 and got[1][0]["score"] == pytest.approx(1)


def test_postings_are_rare_and_complete():
    vocabulary = licenses.Vocabulary(list("abcdef"))
    index = licenses.Index(vocabulary, licenses.np.array([1.0, 2, 3, 4, 5, 6]), 0.6)
    places = index.rarest(licenses.np.arange(6), 0.6)
    # Any choice of words that weighs 0.6 of the whole has one of the posted places.
    for chosen in range(1 << 6):
        weight = sum(i + 1 for i in range(6) if chosen >> i & 1)
        assert weight < 0.6 * 21 or any(chosen >> int(q) & 1 for q in places)
    assert list(index.rarest(licenses.np.arange(6), 1.0)) == [5]


def test_words_are_compared_byte_by_byte():
    vocabulary = licenses.Vocabulary(["mit", "license", "é"])
    text = pa.array(["MIT mi mitt é É licens license", None, "mit"])
    numbers = vocabulary.numbers(licenses.tokenized(text, licenses._IN_WORD))
    assert [vocabulary.words[n] if n >= 0 else None for n in numbers] == ["mit", None, None, "é", None, None, "license", "mit"]


def test_empty_table_and_registered_query(spark, data, corpus):
    assert licenses.digest(licenses.find(corpus([]))).count() == 0
    df = queries.QUERIES["op11_license_scan"](spark, data)
    assert [f.simpleString() for f in df.schema] == [
        "doc_id:bigint", "n_words:bigint", "n_base:bigint", "first_word:bigint", "last_word:bigint", "base_labels:string", "labels:string", "score:double"]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = df.collect()
    assert len(got) == len(texts)
    assert all((r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(texts[r["doc_id"]]) for r in got)
