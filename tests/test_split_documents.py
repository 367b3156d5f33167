import gzip
import json
import os
import random

import pytest
from conftest import values
from pyspark.sql import functions as F

from plainsight.catalog import scans
from plainsight.operators.nested import rectangle
from plainsight.session import scratch_dir
from plainsight.sources import documents, split_documents
from plainsight.tables import Tables

ITEM = "n long, s string, xs array<struct<v: string>>"
NASTY = ['a{b}', '"', '\\', '\\"', '}]', '{"items": [', "é\n\t", "\\\\\"{", "", '"items": [{', " ", "]}" * 30]


def item(rng, i, size=12):
    return {"n": i, "s": "".join(rng.choice(NASTY) for _ in range(rng.randrange(4))), "xs": [{"v": rng.choice(NASTY)} for _ in range(rng.randrange(size))]}


def write(spark, texts):
    path = scratch_dir(spark, "documents")
    os.makedirs(path)
    for name, text in texts.items():
        with open(os.path.join(path, name), "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())
    return path


@pytest.fixture(params=[150, 1 << 20])
def split_bytes(spark, request):
    """Splits of this many bytes, far smaller than an element or larger than a file."""
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = [spark.conf.get(k) for k in keys]
    spark.conf.set(keys[0], str(request.param))
    spark.conf.set(keys[1], "1")
    yield request.param
    for k, v in zip(keys, old):
        spark.conf.set(k, v)


def found(elements):
    return sorted((os.path.basename(r["file"]), r["n"], r["s"], tuple(x["v"] for x in r["xs"])) for r in elements.collect())


def expected(name, items):
    return [(name, x["n"], x["s"], tuple(v["v"] for v in x["xs"])) for x in items]


def test_elements_equal_a_whole_parse(spark, split_bytes):
    rng = random.Random(split_bytes)
    texts, want = {}, []
    for k in range(2):
        items = [item(rng, i) for i in range(9)]
        parts = [json.dumps(x, indent=k or None, ensure_ascii=k == 1) for x in items]
        odd = ["null", "7", '"{"', "[]", '[{"n": 1}, {"items": [{"n": 2}]}]']
        for x in odd:
            parts.insert(rng.randrange(len(parts) + 1), x)
        other = json.dumps({"items": [item(rng, -1)], "x": [[{"n": -2}]]})
        text = f'  {{ "info": {other}, "others": [{{"n": -3}}], "items" : [ {" , ".join(parts)} ], "last": [{{"n": -4}}], "z": "items" }}\n '
        json.loads(text)
        texts[f"{k}.json"] = text
        want += expected(f"{k}.json", items)
    elements, rejects = split_documents.read_elements(spark, write(spark, texts), "items", ITEM)
    assert elements.columns == ["file", "n", "s", "xs"]
    assert found(elements) == sorted(want)
    assert rejects.count() == 0
    if split_bytes == 150:
        assert split_documents._fragments(spark, write(spark, texts)).select("file", "split").distinct().count() > 20


def test_unreadable_files_and_elements_are_set_aside(spark, split_bytes):
    good = json.dumps({"items": [{"n": 1, "s": "a", "xs": []}, {"n": "text", "s": "b", "xs": []}, {"n": 3, "s": "{", "xs": []}]})
    texts = {
        "good.json": good, "none.json": "", "blank.json": " \n ", "array.json": "[" + good + "]", "two.json": good + good, "tail.json": good + " x",
        "head.json": "x" + good, "cut.json": good[:-1], "cut2.json": good[:40], "string.json": good[:-1] + ', "a": "', "close.json": good + "}",
        "without.json": '{"a": [{"n": 1}], "b": {"items": [{"n": 2}]}}', "empty.json": '{"items": []}', "plain.json": "no json", "object.json": "{}",
    }
    elements, rejects = split_documents.read_elements(spark, write(spark, texts), "items", ITEM)
    assert found(elements) == [("good.json", 1, "a", ()), ("good.json", 3, "{", ())]
    got = {os.path.basename(r["file"]): (r["value"], r["reason"]) for r in rejects.collect()}
    assert got.pop("good.json")[0] == '{"n": "text", "s": "b", "xs": []}'
    assert {k: v[1] for k, v in got.items()} == {
        "none.json": "no bytes", "blank.json": "not one document", "array.json": "text outside the document", "two.json": "not one document",
        "tail.json": "text outside the document", "head.json": "text outside the document", "cut.json": "brackets do not match",
        "cut2.json": "brackets do not match" if good[:40].count('"') % 2 == 0 else "ends inside a string", "string.json": "ends inside a string",
        "close.json": "brackets do not match", "plain.json": "text outside the document",
    }


def test_one_large_document_is_read_by_many_tasks(spark):
    rng = random.Random(5)
    items = [item(rng, i, 40) for i in range(6_000)]
    lines = [json.dumps(x) for x in items]
    text = '{"info": {"slice": "0-999"}, "items": [' + ", ".join(lines) + "]}"
    path = write(spark, {"0.json": text})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 18))
    try:
        fragments = split_documents._fragments(spark, path)
        per_task = [r[0] for r in fragments.groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("value"))).select("sum(octet_length(value))").collect()]
        assert len(per_task) > 8 and max(per_task) < len(text) / 4
        elements, _ = split_documents.read_elements(spark, path, "items", ITEM)
        again = spark.createDataFrame([(x,) for x in lines], "value string").select(F.from_json("value", ITEM).alias("e")).select("e.*")
        sides = [rectangle(df.select(F.array(F.struct("n", "s", "xs")).alias("items")), "items", ["n", "s"], "xs") for df in (elements, again)]
        assert sides[0].exceptAll(sides[1]).count() == 0 and sides[1].exceptAll(sides[0]).count() == 0 and sides[0].count() > 100_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_large_tables_of_splits_are_joined(spark, split_bytes, monkeypatch):
    monkeypatch.setattr(split_documents, "_BROADCAST_BYTES", 0)
    rng = random.Random(9)
    items = [item(rng, i) for i in range(9)]
    path = write(spark, {"0.json": json.dumps({"items": items})})
    elements, rejects = split_documents.read_elements(spark, path, "items", ITEM)
    assert found(elements) == sorted(expected("0.json", items)) and rejects.count() == 0


def test_text_after_the_object_is_no_record(spark):
    path = scratch_dir(spark, "lines")
    bad = ['{"a": 1} x', '{"a": 1}{"a": 2}', '{"a": 1}}', '{"a": 1}, "end": 5}', '{"a": 1},', '{"a": 1}]', '{"a": "}" } y']
    good = ['{"a": 1}', ' {"a": 2}  ', '{"a": 3, "b": "{"}', '{"a": 4, "b": "x} y"}']
    spark.createDataFrame([(x,) for x in bad + good], "value string").write.text(path)
    records, rejected = documents.read_lines(spark, path, "a int")
    assert sorted(values(records)) == [(1,), (2,), (3,), (4,)]
    assert sorted(v for _, v in values(rejected)) == sorted(bad)


def test_files_of_no_bytes_are_set_aside(spark):
    path = write(spark, {"a.txt": '{"a": 1}', "b.txt": "", "c.txt": '{"a": 2} z'})
    good, bad = documents.read_documents(spark, path, "a int")
    assert values(good) == [(1,)]
    assert sorted((f[-5:], v) for f, v in values(bad)) == [("b.txt", ""), ("c.txt", '{"a": 2} z')]
    nothing = documents.read_documents(spark, write(spark, {"b.txt": ""}), "a int")
    assert nothing[0].count() == 0 and nothing[1].count() == 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fragments_are_narrow_and_elements_parsed_once(spark, split_bytes):
    path = write(spark, {"a b.json": '{"items": [{"n": 1, "s": "x"}, {"n": "no"}, {"n": 2}]}', "b.json": '{"items": [{"n": 3}]} x', "c.json": ""})
    fragments = split_documents._fragments(spark, path)
    assert dict(fragments.dtypes)["file"] == "bigint"
    elements, rejects = split_documents.read_elements(spark, path, "items", ITEM)
    assert sorted(r.n for r in elements.collect()) == [1, 2]
    assert plan_of(elements.select("n", "s")).count("from_json") == 1
    got = sorted((os.path.basename(r.file), r.value or "", r.reason) for r in rejects.collect())
    assert [g[0].replace("%20", " ") for g in got] == ["a b.json", "b.json", "c.json"]
    assert [g[1:] for g in got] == [('{"n": "no"}', "element does not fit the schema"), ("", "text outside the document"), ("", "no bytes")]


def test_empty_files_are_found_without_reading(spark):
    path = write(spark, {"a.json": "{}", "b.json": ""})
    found = documents.empty_files(spark, path)
    assert "FileScan text" not in plan_of(found) and "content" not in plan_of(found).split("ReadSchema")[-1]
    assert [os.path.basename(r.file) for r in found.collect()] == ["b.json"]


def test_names_of_one_hash_are_refused(spark, monkeypatch):
    monkeypatch.setattr(split_documents, "_file_key", lambda file: F.length(file).cast("long"))
    with pytest.raises(ValueError, match="one hash"):
        split_documents.read_elements(spark, write(spark, {"a.json": "{}", "b.json": "{}"}), "items", ITEM)


def test_parts_of_a_file_make_the_whole(tmp_path):
    rng = random.Random(3)
    for size in (0, 1, 7, 400, 200_000):
        text = "".join(rng.choice(['{"a": 1}', "{", "x", "é", "[1, 2]", " " * 40, "y" * 300]) for _ in range(size)).encode() or b"x"
        (tmp_path / "a b%.json").write_bytes(text)
        for step in (1 + len(text) // 50, 1 + len(text) // 3, len(text) + 5):
            for max_bytes in (10, 1 << 20):
                starts = range(0, len(text), step)
                parts = [list(split_documents._part(f"file:{tmp_path}/a b%.json", a, min(a + step, len(text)), max_bytes)) for a in starts]
                assert b"".join(x for p in parts for x in p) == text
                assert all(x.startswith(b"{") for p in parts[1:] for x in p) and parts[0]
                assert all(len(x) < max(1 << 17, 2 * max_bytes) for p in parts for x in p)
    (tmp_path / "b.json").write_bytes(b"\xef\xbb\xbf{}")
    assert list(split_documents._part(f"file:{tmp_path}/b.json", 0, 5, 1 << 20)) == [b"{}"]


def test_brackets_equal_a_walk_over_the_text():
    rng = random.Random(4)
    pattern = split_documents.re.compile(rb'"it"\s*:\s*\[')
    for _ in range(3_000):
        text = "".join(rng.choice(['"', "\\", "{", "}", "[", "]", '"it": [', "a", '\\"it":[', "\\\\"]) for _ in range(rng.randrange(20))).encode()
        quotes, brackets, slashes = [], [], 0
        for i, c in enumerate(text.decode()):
            if c == '"' and slashes % 2 == 0:
                quotes.append(i)
            elif c in "{}[]":
                brackets.append((i, 1 if c in "{[" else -1, len(quotes) % 2))
            slashes = slashes + 1 if c == "\\" else 0
        named = {m.end() - 1 for m in pattern.finditer(text) if m.start() in quotes}
        got = split_documents.Brackets(text, pattern)
        assert got.quotes.tolist() == quotes
        assert list(zip(got.at.tolist(), got.step.tolist(), got.odd.tolist())) == brackets
        assert got.names.tolist() == [i in named for i, _, _ in brackets]


def test_packed_files_and_other_stores_are_read_by_spark(spark, split_bytes, monkeypatch):
    items = [item(random.Random(6), i) for i in range(9)]
    text = json.dumps({"items": items})
    packed = write(spark, {"a.json.gz": gzip.compress(text.encode()), "b.json": text})
    assert not split_documents._in_reach(spark, split_documents._files(spark, packed))
    elements, rejects = split_documents.read_elements(spark, packed, "items", ITEM)
    assert found(elements) == sorted(expected("a.json.gz", items) + expected("b.json", items)) and rejects.count() == 0

    plain = write(spark, {"a.json": text, "b.json": text + "]"})
    assert split_documents._in_reach(spark, split_documents._files(spark, plain))
    direct = [sorted(map(str, df.collect())) for df in split_documents.read_elements(spark, plain, "items", ITEM)]
    monkeypatch.setattr(split_documents, "_opened", lambda name: (_ for _ in ()).throw(OSError("no such store")))
    assert [sorted(map(str, df.collect())) for df in split_documents.read_elements(spark, plain, "items", ITEM)] == direct


def test_documents_of_a_large_table_lie_on_disk_in_turns(spark, tmp_path, monkeypatch):
    rows = [(i, " ".join(rng_words(i)), "en", f"s{i % 3}", i * 7) for i in range(60)] + [(3, None, "en", "s", 1), (5, "", "en", None, None), (7, "a", "en", "s", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(scans, "_TURN_BYTES", 1)
    monkeypatch.setattr(scans, "_TURNS", 3)
    paths, landed, real = [], [], split_documents.read_elements

    def watched(session, path, *args):
        paths.append(path)
        landed.append(sum(len(os.listdir(p)) - 2 for p in paths if os.path.isdir(p)))  # besides _SUCCESS and its checksum
        return real(session, path, *args)

    monkeypatch.setattr(split_documents, "read_elements", watched)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = scans.json_split_documents(Tables(spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(paths) == 3 and sorted(landed) == [2, 2, 3] and not any(os.path.isdir(p) for p in paths)
    want = [(s, i, n, w, k) for i, t, _, s, n in rows if t is not None for k, w in enumerate(t.split(" "), 1)]
    assert sorted(map(str, values(got))) == sorted(map(str, want))


def rng_words(i):
    rng = random.Random(i)
    return [rng.choice(["a", "{b", '"', "\\", "]}", "é", ""]) for _ in range(rng.randrange(1, 30))]
