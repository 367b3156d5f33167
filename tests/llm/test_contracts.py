"""The registered queries and the pipeline over small whole tables: columns, folds and values."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from plainsight.llm import queries, render, toxicity
from plainsight.llm.rows import fold_of
from plainsight.session import scratch_dir
from test_filters import brute_lines

COLUMNS = {
    "op1_toxicity": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op2_packing": "doc_id:bigint start:bigint length:bigint ids_crc32:bigint doc_tokens:bigint sequence_id:bigint offset:bigint",
    "op3_warc": "page_id:bigint payload_bytes:bigint payload_digest:string record_type:string refers_to:bigint",
    "op4_cap_filters": "vec_id:bigint n_links:bigint component_id:bigint kept:boolean",
    "op6_token_store": "doc_id:bigint start:bigint n_tokens:bigint ids_crc32:bigint",
    "op7_backoff_automaton": "doc_id:bigint held_out:boolean n_tokens:bigint n_known:bigint train_tokens:bigint base_score:double score:double",
    "op8_html_rendering": "page_id:bigint text:string n_chars:bigint n_tables:bigint n_items:bigint",
    "op9_minhash_near_dedup": "doc_id:bigint n_shingles:bigint component_id:bigint kept:boolean",
    "op10_line_dedup": "doc_id:bigint n_lines:bigint n_dropped:bigint kept_sha256:string",
}
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def found(spark, data):
    """Rows of each query, run once."""
    kept = {}

    def rows(name):
        if name not in kept:
            df = queries.QUERIES[name](spark, data)
            assert {f.simpleString() for f in df.schema} >= set(COLUMNS[name].split()), df.schema.simpleString()
            kept[name] = df.collect()
        return kept[name]

    return rows


@pytest.fixture(scope="module")
def texts(spark, data):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def encode():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(found, texts):
    rows = found("op1_toxicity")
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    assert all(r["held_out"] == (fold_of(r["doc_id"], 3) == 1) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)


def test_op2(found, texts, encode):
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in found("op2_packing"):
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids = encode(texts[i]) + [1]
        pieces.sort(key=lambda r: r["start"])
        assert [r["start"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces)])[:-1].tolist()
        assert sum(r["length"] for r in pieces) == len(ids) == pieces[0]["doc_tokens"]
        assert all(r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]]) for r in pieces)
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist() and sum(n for _, n in parts) <= 2048
    total = sum(n for parts in by_sequence.values() for _, n in parts)
    assert len(by_sequence) <= math.ceil(total / 2048) * 1.05 + 1


def test_op6(found, texts, encode):
    start, want = 0, {}
    for i in sorted(texts):
        ids = encode(texts[i]) + [2]
        want[i] = (start, len(ids), crc(ids))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in found("op6_token_store")} == want


def test_op7(found, texts):
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None] for i, t in texts.items()}
    counts = collections.Counter(w for i, own in tokens.items() if fold_of(i, 7) != 2 for w in own)
    n, v = sum(counts.values()), len(counts)
    for r in found("op7_backoff_automaton"):
        own = tokens[r["doc_id"]]
        assert r["held_out"] == (fold_of(r["doc_id"], 7) == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in counts for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
        assert r["score"] < 0


def test_op8(spark, data, found):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    rows = found("op8_html_rendering")
    assert {r["page_id"]: r["text"] for r in rows} == {i: render.rendered(h)[0] for i, h in pages.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def components(sets, numerator, denominator):
    """Smallest id reachable over pairs of sets with at least that similarity."""
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if denominator * min(len(x), len(y)) >= numerator * max(len(x), len(y)):
                both = len(x & y)
                if denominator * both >= numerator * (len(x) + len(y) - both):
                    low, high = sorted((root(a), root(b)))
                    group[high] = low
    return {i: root(i) for i in sets}


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()


def test_op9(found, texts):
    sets = {i: shingles(t, 2) for i, t in texts.items()}
    group = components(sets, 80, 100)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found("op9_minhash_near_dedup")} == {
        i: (len(s), group[i], group[i] == i) for i, s in sets.items()}


@pytest.mark.parametrize("name", ["op3_warc", "op4_cap_filters", "op10_line_dedup"])
def test_columns(found, name):
    assert found(name)


# ---- the pipeline ----


def tables(spark, docs, labels, benchmark):
    folder = scratch_dir(spark, "tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score double").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline_equals_its_stages(spark, encode):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 8))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(words, n))
    passages = [line(30) for _ in range(3)]
    rows = [(i, "\n".join([line(25), "a common line" if i % 3 else line(4), line(15)]) + (" vile" if i % 8 == 0 else "")) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(0, 40, 5)] + [(300 + i, rows[i][1] + " more") for i in range(1, 40, 5)]
    rows += [(400 + i, f"{line(10)} {passages[i % 3]} {line(10)}") for i in range(6)]
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "one"), (504, " ".join(words) * 20), (None, "no id at all"), (505, "twice here"), (505, "twice here")]
    docs = [(i, t, None, None, None if t is None else len(t), 0.5) for i, t in rows]
    labels = [(i, None, int(i % 8 == 0)) for i in range(120)] + [(None, 1, 1), (7, None, None)]
    folder = tables(spark, docs, labels, [(i, p) for i, p in enumerate(passages)] + [(9, None), (10, "")])
    got = corpus_pipeline.run(spark, folder).collect()

    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    kept = toxicity.score(read("documents").drop("score"), toxicity.train(read("documents"), read("labels"))).where("predicted = 0")
    kept = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert not any("vile" in (t or "") for _, t in kept) and len(kept) > 100
    after_lines = [(i, t) for i, t, *_ in brute_lines(kept, 10)]
    sets = [shingles(t, 5) for _, t in after_lines]
    numbered = dict(enumerate(sets))
    group = components(numbered, 80, 100)
    alive = []
    for g in set(group.values()):
        members = [k for k in group if group[k] == g]
        named = [k for k in members if after_lines[k][0] is not None]
        # Rows that repeat an id are one document: all of the smallest id stay. Rows without an id are told apart.
        alive += [k for k in named if after_lines[k][0] == min(after_lines[m][0] for m in named)] if named else members
    passage_words = [" ".join(p.split()) for p in passages]
    expected = collections.Counter()
    for k in alive:
        i, t = after_lines[k]
        if not any(p in " ".join((t or "").split()) for p in passage_words):
            expected[(i, tuple(encode(t)) + (1,))] += 1
    # Pieces of one document follow each other from 0; rows that repeat an id are told apart by their place.
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    assert set(by_doc) == {i for i, _ in expected}
    for i, pieces in by_doc.items():
        want = [ids for (d, ids), n in expected.items() for _ in range(n) if d == i]
        assert sum(r["length"] for r in pieces) == sum(map(len, want))
        if len(want) == 1:
            pieces.sort(key=lambda r: r["start"])
            assert [r["start"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces)])[:-1].tolist()


def test_pipeline_of_empty_tables(spark):
    assert corpus_pipeline.run(spark, tables(spark, [], [], [])).count() == 0


def test_stages_return_the_columns_of_documents(spark):
    folder = tables(spark, [(1, "a b", "en", "s", 3, 0.1), (None, None, None, None, None, None)], [], [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert out.count() == 2, name
