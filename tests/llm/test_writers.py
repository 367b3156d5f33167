import collections
import hashlib
import math
import os
import zlib
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pytest

from plainsight.llm import language_model, packing, render, token_store, warc
from plainsight.llm.rows import fold, fold_of
from plainsight.llm.tokens import Encoder, default_path
from plainsight.session import scratch_dir
from pyspark.sql import functions as F
from corpora import corpus  # noqa: F401
from test_filters import ODD

TEXTS = ODD + [(20, "a  b\n\nc　 d <|endoftext|> e"), (21, "don't, 'tis\x85 so²  "), (22, "\x1c a\x1f b"), (23, "The cat. The cat, the\ncat; \t the cat")]


@pytest.fixture(scope="module")
def tokenizer():
    return Encoder(default_path()).tokenizer


def ids(tokenizer, text, end):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_encoder(tokenizer):
    texts = [t for _, t in TEXTS] + ["", " ", "x", "\ny z", "b\nc d\n"]
    want = [ids(tokenizer, t, 0)[:-1].tobytes() for t in texts]
    assert Encoder(default_path(), max_parts=3).encode(pa.array(texts)) == want


def test_differencing():
    rng = np.random.default_rng(8)
    for k, n in ((1, 5), (3, 0), (4, 60), (7, 5)):
        sizes = rng.integers(1, 300, n)
        window, sums = packing.differencing(sizes, k)
        assert sorted(np.bincount(window, weights=sizes, minlength=k)) == sorted(sums)
    assert np.ptp(packing.differencing(rng.integers(1, 300, 200), 8)[1]) < 20
    window, k = packing.windows(np.array([6, 6, 6]), 10)
    assert k == 3 and len(set(window)) == 3


def test_packing(spark, corpus, tokenizer):
    rows = TEXTS + [(100 + i, "word and some more " * (1 + 37 * i % 900)) for i in range(60)]
    pieces = packing.pack(packing.cut(corpus(rows, ["start", "part"]))).collect()
    by_sequence, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"]
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
        by_doc[p["doc_id"]].append((p["start"], p["doc_tokens"], bytes(p["ids"])))
    for parts in by_sequence.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert ends[-1] <= 2048 and [o for o, _ in sorted(parts)] == [0, *ends[:-1]]
    padding = 1 - sum(p["length"] for p in pieces) / (2048 * len(by_sequence))
    assert padding < 0.03
    for i, text in rows:
        if i != 5:  # twice there
            data = b"".join(x for _, _, x in sorted(by_doc[i]))
            assert data == ids(tokenizer, text, 1).tobytes() and {n for _, n, _ in by_doc[i]} == {len(data) // 4}
    assert packing.pack(packing.cut(corpus([]))).count() == 0


def test_token_store(spark, corpus, tokenizer):
    rows = TEXTS + [(1000 + i, f"text {i} of many " * (i % 7)) for i in range(80)]
    folder = scratch_dir(spark, "store")
    token_store.write(corpus(rows, ["file", "seq"]).repartition(5), folder, max_bytes=300)
    got = token_store.read(spark, folder).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for r, (i, text) in zip(sorted(got, key=lambda r: r["start"]), ordered):
        want = ids(tokenizer, text, 2)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(want), zlib.crc32(want.tobytes()))
        assert bytes(r["ids"]) == want.tobytes()
        start += len(want)
    assert len(got) == len(rows)
    few = {r["doc_id"]: bytes(r["ids"]) for r in token_store.fetch(spark, folder, [23, 1005, 77]).collect()}
    assert few == {23: ids(tokenizer, rows[[i for i, _ in rows].index(23)][1], 2).tobytes(), 1005: ids(tokenizer, "text 5 of many " * 5, 2).tobytes()}
    assert token_store.fetch(spark, folder, []).count() == 0
    path = folder.removeprefix("file:")
    with open(f"{path}/dictionary", "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="another dictionary"):
        token_store.read(spark, folder).collect()
    empty = scratch_dir(spark, "store")
    token_store.write(corpus([]), empty)
    assert token_store.read(spark, empty).count() == 0


def test_warc(spark):
    trap = "<p>" + "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 3 + "</p>"
    fake = warc.record(999, "http://fake", b"y" * 200, "0" * 64, None, "d").decode()
    big = "ü" * 90_000
    pages = [(1, "http://a/\r\nX: y", "<p>short"), (2, None, "<p>short"), (3, "u", trap * 4), (4, "u", trap * 4), (None, "u", trap * 4), (6, "u", None), (7, "u", ""), (8, "u", fake), (9, "u", fake), (10, "u", big), (11, "u", big), (11, "u", big), (None, "u", "z" * 150)]
    folder = scratch_dir(spark, "warc")
    made = warc.write(spark.createDataFrame([(*p, "theirs") for p in pages], "page_id long, url string, html string, digest string"), folder, max_bytes=50_000)
    assert made.agg({"n_records": "sum"}).first()[0] == len(pages)
    got = warc.read(spark, folder, split_bytes=1000).collect()
    seen = collections.defaultdict(list)
    for i, _, html in pages:
        if i is not None and len((html or "").encode()) >= 100:
            seen[html].append(i)
    want = []
    for i, _, html in pages:
        first = min(seen[html]) if seen.get(html) else None
        refers = first if first is not None and i != first else None
        data = (html or "").encode()
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got))) == sorted(map(repr, want))
    assert all(r["intact"] for r in got)
    # A truncated archive ends at its last whole record.
    path = folder.removeprefix("file:")
    name = sorted(f for f in os.listdir(path) if f.endswith(".warc"))[0]
    size = os.path.getsize(f"{path}/{name}")
    os.truncate(f"{path}/{name}", size - 3)
    assert warc.read(spark, folder, split_bytes=1000).count() == len(pages) - 1
    none = scratch_dir(spark, "warc")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), none)
    assert warc.read(spark, none).count() == 0


def test_long_chains_over_many_splits(spark):
    folder = scratch_dir(spark, "warc")
    pages = spark.range(300).selectExpr("id as page_id", "'u' as url", "concat(id, repeat('<p>x', cast(id % 90 as int))) as html").coalesce(1)
    warc.write(pages, folder)
    for split in (300, 5000, 1 << 20):
        got = [r[0] for r in warc.read(spark, folder, split_bytes=split).select("page_id").collect()]
        assert sorted(got) == list(range(300))


def test_long_urls(spark):
    folder = scratch_dir(spark, "warc")
    trap = "\r\n\r\nWARC/1.0\r\nContent-Length: 1\r\nX: " + "x" * 150_000
    pages = [(1, "u", "<p>first"), (2, "http://a/" + "x" * 100_000, "<p>second"), (3, "语" * 30_000, trap), (4, "data:" + "y" * 65_400, ""), (5, "u", "<p>last")]
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), folder)
    assert len([f for f in os.listdir(folder.removeprefix("file:")) if f.endswith(".warc")]) == 1
    for split in (1000, 70_000, 4 << 20):
        got = warc.read(spark, folder, split_bytes=split).select("page_id", "url", "payload", "intact").collect()
        assert sorted((i, unquote(url), bytes(data).decode(), ok) for i, url, data, ok in got) == [(*p, True) for p in pages]


def brute_scores(rows, order, mass):
    words = [(t or "").encode().lower().split() + ["</s>"] for _, t in rows]
    counts, base, texts = collections.Counter(), collections.Counter(), 0
    for (i, _), w in zip(rows, words):
        if fold_of(i, 7) != 2:
            base.update(w)
            texts += 1
            line = ["<s>", *w]
            for k in range(2, order + 1):
                counts.update(tuple(line[j : j + k]) for j in range(len(line) - k + 1))
    n, v = sum(base.values()), len(base)

    def count(gram):
        return (texts if gram == ("<s>",) else base[gram[0]]) if len(gram) == 1 else counts[gram]

    def p(history, w):
        if not history:
            return (base[w] + 1) / (n + v + 1)
        return (count((*history, w)) + mass * p(history[1:], w)) / (count(history) + mass)

    out = []
    for w in words:
        line = ["<s>", *w]
        score = sum(math.log10(p(tuple(line[max(0, j - order + 1) : j]), line[j])) for j in range(1, len(line)))
        out.append((len(w), sum(base[x] > 0 for x in w), n, sum(math.log10((base[x] + 1) / (n + v + 1)) for x in w), score))
    return out


def test_language_model(spark, corpus):
    rng = np.random.default_rng(9)
    rows = TEXTS + [(300 + i, " ".join(rng.choice(["a", "B", "c", "dd", "e"], 30))) for i in range(60)]
    docs = corpus(rows, ["block", "train", "score"])
    for order in (1, 2, 3):
        got = language_model.score(docs, fold("doc_id", 7) != 2, order=order, mass=3.0, block_bytes=400_000 if order == 2 else 2000).collect()
        assert len(got) == len(rows)
        found = sorted(got, key=lambda r: repr((r["doc_id"], r["n_tokens"])))
        want = sorted(zip(rows, brute_scores(rows, order, 3.0)), key=lambda x: repr((x[0][0], x[1][0])))
        for r, ((i, _), w) in zip(found, want):
            assert (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i, *w[:3])
            assert r["base_score"] == pytest.approx(w[3]) and r["score"] == pytest.approx(w[4])
    assert language_model.score(corpus([])).count() == 0
    untrained = language_model.score(docs, fold("doc_id", 7) < 0).first()
    assert untrained["train_tokens"] == 0 and untrained["n_known"] == 0


def test_rows_between_blocks_and_parts_grow_slowly(spark, corpus, monkeypatch):
    """Twice the blocks give at most 2.9 times the rows, not four times."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 400, 300))) for i in range(400)]
    counted = []
    inner = language_model.stored

    def spy(df, label):
        kept = inner(df, label)
        counted.append(kept.count())
        return kept

    monkeypatch.setattr(language_model, "stored", spy)
    for n in (100, 200, 400):
        language_model.score(corpus(rows[:n]), block_bytes=1500)
    assert all(b / a <= 2.9 for a, b in zip(counted, counted[1:])), counted


def test_totals_beyond_32_bits():
    planes = lambda x, kind: language_model._planes(np.array(x, kind))
    keys, counts = [[5, 4], [9], [5, 9]], [[3 << 30, 1], [2], [3 << 30, 0]]
    replies, types, tokens = language_model._totals([planes(k, "<u8") for k in keys], [planes(c, "<u4") for c in counts])
    assert [language_model._unplaned(r, language_model._TOTAL).tolist() for r in replies] == [[6 << 30, 3], [3], [6 << 30, 0]]
    assert (types, tokens) == (2, (6 << 30) + 3)


@pytest.mark.parametrize(
    "html, text",
    [
        ("<h1>T</h1><p>One <b>bold</b>\n two<br>next<p>Three", "T\n\nOne bold two\nnext\n\nThree"),
        ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul>", "- a\n- b\n  3. c\n  4. d\n- e"),
        ("<table><tr><th>Name<th>N<tr><td>Al &amp; B<td>12<tr><td rowspan=2>Long name<td>3<tr><td>4</table>", "Name       N\nAl & B     12\nLong name  3\n           4"),
        ("<table><tr><td colspan=2>wide<td>x<tr><td>1<td>22<td>333</table>", "wide      x\n1     22  333"),
        ("<style>.g,p#i{display:none}</style><p class='a g'>no<p id=i>no<div style='x:y; display : none'>no</div><p hidden>no<p>yes", "yes"),
        ("<title>t</title><script>var a='</p>'</script><!-- c --><noscript>n</noscript>a<details><summary>S</summary>no</details><dialog>no</dialog>", "a\nS"),
        ("<pre> a\n  b</pre>", " a\n  b"),
        ("a<div>b</div>c<span>d</span>e</div></p>f", "a\nb\ncde\nf"),
        ("<div>" * 3000 + "deep" + "<b>er", "deep\ner"),
        ("&lt;p&gt; &nbsp;x &#x41;", "<p> \xa0x A"),
        ("", ""),
        (None, ""),
    ],
)
def test_rendered(html, text):
    assert render.rendered(html)[0] == text


@pytest.mark.parametrize(
    "html, text",
    [
        ("a <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>no</annotation></math> b", "a x=1 2 b"),
        ("<math><mtext>for <b>all</b></mtext><mspace/><mi>n</mi></math>", "for alln"),
        ("<p>a<svg><title>no</title><desc>no</desc><metadata>no</metadata><defs><text>no</text></defs><g>no<path d='x'/><text>one <tspan>two</tspan></text>"
         "<text>three<tspan x=1>four</tspan></text><text display=none>no</text></g></svg>b", "a\none two\nthree four\nb"),
        ("<svg><defs/><text><![CDATA[c]]></text><foreignObject><p>html</p></foreignObject></svg>", "c\nhtml"),
        ("<svg><circle><p>out", "out"),
        ("x<select><option>a<option selected hidden>b c</select>y", "x b c y"),
        ("<select><option disabled>a<optgroup label=g disabled><option>b</optgroup><option label=L>c<option>d</select>", "L"),
        ("<select multiple><optgroup label=G><option>a<option hidden>no</optgroup><option>b</select>z", "G\na\nb\nz"),
        ("<select size=3><option>a<option>b<input type=submit value=go>", "a\nb\ngo"),
        ("x<textarea>\n a &lt; <b>\n  c</textarea>y", "x\n a < <b>\n  c\ny"),
        ("<textarea>not <p>closed &amp;", "not <p>closed &"),
        ("<table><select><option>s</select><tr><td><textarea>t</textarea><td><svg><text>u</text></svg></table>", "s\nt  u"),
    ],
)
def test_rendered_forms_and_drawings(html, text):
    assert render.rendered(html)[0] == text


@pytest.mark.parametrize(
    "html, text",
    [
        ("<div hidden><p>no</p>no</div><p>yes", "yes"),
        ("<table><tr><td>a<td>b<tr><td>cc<td>d</table>", "a   b\ncc  d"),
        ("<ul><li>a<ol><li>b <i>c</i> d</ol></ul>", "- a\n  1. b c d"),
    ],
)
def test_rendered_below_many_elements(html, text):
    for tags in ("<font>" * 300, "<b><a>" * 20_000, "<div>" * 199):
        assert render.rendered(tags + html)[0] == text


def test_rendered_at_any_depth():
    assert render.rendered("<div hidden>" + "<div>" * 3000 + "no")[0] == ""
    for tags, n in (("<div>x", 30_000), ("<ul><li>x", 3000), ("<blockquote>x", 3000), ("<table><tr><td>x", 3000), ("<p><table><td>x<div>", 3000), ("<svg><g>", 3000)):
        assert render.rendered(tags * n)[0].count("x") == n * tags.count("x")
    assert render.rendered("<table><td>a<td>" * 80 + "b")[0] == "a  " * 80 + "b"


def test_archives_of_other_attempts_are_not_read(spark):
    folder = scratch_dir(spark, "warc")
    pages = spark.createDataFrame([(i, "u", "x" * (50 + i)) for i in range(40)], "page_id long, url string, html string").repartition(3)
    named = warc.write(pages, folder, max_bytes=2000)
    assert named.agg(F.sum("n_records")).first()[0] == 40
    assert sorted(r["file"] for r in named.collect()) == sorted(f for f in os.listdir(folder) if f.endswith(".warc"))
    # What a lost attempt leaves: a whole archive, and half of one.
    with open(os.path.join(folder, named.first()["file"]), "rb") as f:
        data = f.read()
    for name, left in (("part-000000-0000-lost.warc", data), ("part-000001-0000-lost.warc", data[: len(data) // 2])):
        with open(os.path.join(folder, name), "wb") as f:
            f.write(left)
    assert sorted(r["page_id"] for r in warc.read(spark, folder).collect()) == list(range(40))
    # Archives from elsewhere have no manifest: all are read.
    other = scratch_dir(spark, "warc")
    os.makedirs(other)
    with open(os.path.join(other, "a.warc"), "wb") as f:
        f.write(data)
    assert warc.read(spark, other).count() == data.count(b"WARC/1.0\r\n")


def test_render(spark):
    pages = spark.createDataFrame([(1, "<table><tr><td>a</table><ul><li>b", "theirs"), (None, None, None), (1, "x" * 200_000, "")], "page_id long, html string, text string")
    got = [tuple(r) for r in render.render(pages).collect()]
    assert got == [(1, "a\n\n- b", 6, 1, 1), (None, "", 0, 0, 0), (1, "x" * 200_000, 200_000, 0, 0)]
    assert render.render(pages.limit(0)).count() == 0


def test_words_before_marks_are_encoded_once(monkeypatch):
    encode = Encoder(default_path())
    seen = []
    together = encode._together
    monkeypatch.setattr(encode, "_together", lambda parts: seen.extend(parts) or together(parts))
    texts = ["Oh wort, wort. wort### wort's wort", "Oh wört.Ωx wort?! ωort, a1, --, it's. x_y: wort%%%%", "Oh wort<|, word"]
    assert encode.encode(pa.array(texts)) == [encode.whole(t) for t in texts]
    assert seen.count(" wort") == 1 and seen.count("Oh") == 1
    assert not {" wort,", " wort.", " wort###", " wort?!", " wort<|,"} & set(seen)


def test_words_around_line_ends_and_indents_are_encoded_once(monkeypatch):
    encode = Encoder(default_path())
    texts = ["Wort.\nWort  wort,\n\n\tWort's (Wort)", "x\nWort\r\n    Wort--wört÷wört  ", "日本\nWort　 Wort \nWort\n\n"]
    want = [encode.whole(t) for t in texts]
    seen, wholes = [], []
    together, whole = encode._together, encode.whole
    monkeypatch.setattr(encode, "_together", lambda parts: seen.extend(parts) or together(parts))
    monkeypatch.setattr(encode, "whole", lambda text: wholes.append(text) or whole(text))
    assert encode.encode(pa.array(texts)) == want
    assert len(seen) == len(set(seen)) and {"Wort", " Wort", " wort", "\n"} <= set(seen)
    assert not [w for w in wholes if "ort" in w and w.isascii()]
    assert encode.encode(pa.array(["", None, *texts]).slice(2)) == want


def test_parts_have_the_ids_they_have_in_the_text():
    encode = Encoder(default_path(), max_parts=50)
    rng = np.random.default_rng(6)
    atoms = np.array([*"aB9é ß×²ΩЖ日.,-('\n\t\r\x1c\x85  　​́ǅȿɐ", *[" "] * 8, *["\n"] * 3, "'s", "'ll", " the", "  "])
    for _ in range(20):
        texts = ["".join(rng.choice(atoms, n)) for n in rng.integers(1, 30, 100)]
        assert encode.encode(pa.array(texts)) == [encode.whole(t) for t in texts]
    long = "x" * 100
    encode.encode(pa.array([f"{long} b"]))
    assert long not in encode.parts and " b" in encode.parts
