import os

import pytest
from conftest import values
from pyspark.sql import functions as F

from plainsight.session import scratch_dir
from plainsight.sources import paged
from plainsight.streaming import landing

ROW = "id bigint, s string"


def write(path, texts):
    os.makedirs(path, exist_ok=True)
    for name, text in texts.items():
        file = os.path.join(path, name)
        os.makedirs(os.path.dirname(file), exist_ok=True)
        with open(file, "w") as f:
            f.write(text)
    return path


def page(first, n):
    return "".join(f'{{"id": {i}, "s": "{i}"}}\n' for i in range(first, first + n))


@pytest.mark.parametrize(
    "pages, ids, report",
    [
        ({0: 4, 4: 4, 8: 2}, range(10), [(0, 4, "full"), (4, 4, "full"), (8, 2, "last")]),
        ({0: 4, 4: 0}, range(4), [(0, 4, "full"), (4, 0, "last")]),
        ({0: 0}, [], [(0, 0, "last")]),
        ({0: 4, 8: 4, 12: 1}, [*range(4), *range(8, 13)], [(0, 4, "full"), (4, 0, "missing"), (8, 4, "full"), (12, 1, "last")]),
        ({0: 4, 4: 3, 8: 4, 16: 0}, range(7), [(0, 4, "full"), (4, 3, "last"), (8, 4, "beyond the end"), (16, 0, "beyond the end")]),
        ({0: 4, 4: 4}, range(8), [(0, 4, "full"), (4, 4, "full")]),
        ({0: 5, 2: 4, 4: 1}, range(5), [(0, 5, "too long"), (2, 4, "off the grid"), (4, 1, "last")]),
    ],
)
def test_pages_up_to_a_short_one(spark, pages, ids, report):
    path = write(scratch_dir(spark, "offsets"), {f"offset={o}/part.json": page(o, n) + "\n" * (o == 0 and n > 0) for o, n in pages.items()})
    rows, told = paged.read_until_short(spark, path, ROW, 4)
    assert sorted({r["id"] for r in rows.collect()}) == list(ids)
    assert all(r["offset"] in pages and r["s"] == str(r["id"]) for r in rows.collect())
    assert sorted(values(told)) == report


def test_landed_by_offset(spark):
    rows = spark.range(103).select("id", F.col("id").cast("string").alias("s")).repartition(5)
    path = paged.land_pages_by_offset(rows, scratch_dir(spark, "offsets"), F.desc("id"), page_rows=20)
    back, report = paged.read_until_short(spark, path, ROW, 20)
    assert sorted(values(back)) == sorted(((102 - i) // 20 * 20, i, str(i)) for i in range(103))
    assert sorted(values(report)) == [(0, 20, "full"), (20, 20, "full"), (40, 20, "full"), (60, 20, "full"), (80, 20, "full"), (100, 3, "last")]


def test_a_killed_run_is_repeated_without_a_trace(spark, monkeypatch):
    source = write(scratch_dir(spark, "landing"), {"a.json": page(0, 5) + '{"id": 5\n', "b.json": page(6, 4), "c.json": "no json\n" + page(10, 2)})
    target, checkpoint = scratch_dir(spark, "target"), scratch_dir(spark, "progress")
    # The run dies after its second batch is written and before it is committed.
    inner, calls = landing.judged, []

    def dying(lines, *rest, **options):
        good, bad = inner(lines, *rest, **options)
        calls.append(1)
        if len(calls) == 2:
            good.drop("_text").write.mode("overwrite").parquet(f"{target}/rows/batch=1")
            raise RuntimeError("killed")
        return good, bad

    monkeypatch.setattr(landing, "judged", dying)
    with pytest.raises(Exception, match="killed"):
        landing.ingest(spark, source, ROW, target, checkpoint, files_per_batch=1)
    rows, rejects = landing.ingest(spark, source, ROW, target, checkpoint, files_per_batch=1)
    assert sorted(r["id"] for r in rows.collect()) == [*range(5), *range(6, 12)]
    assert sorted(r["value"] for r in rejects.collect()) == ["no json", '{"id": 5']
    # Nothing new has landed.
    again, _ = landing.ingest(spark, source, ROW, target, checkpoint, files_per_batch=1)
    assert again.count() == 11


def test_repeated_pages_and_new_columns(spark):
    source = write(scratch_dir(spark, "landing"), {"a.json": page(0, 3) + '{"s": "none"}\n'})
    target, checkpoint = scratch_dir(spark, "target"), scratch_dir(spark, "progress")
    landing.ingest(spark, source, ROW, target, checkpoint, ["id"])
    write(source, {"again.json": page(1, 4) + '{"id": 4, "s": "0"}\n{"s": "none"}\n', "new.json": '{"id": 9, "s": "x", "extra": 1.5}\n'})
    rows, rejects = landing.ingest(spark, source, ROW + ", extra double", target, checkpoint, ["id"])
    assert sorted(((r["id"], r["s"], r["extra"]) for r in rows.collect()), key=str) == sorted(
        [(0, "0", None), (1, "1", None), (2, "2", None), (3, "3", None), (4, "0", None), (9, "x", 1.5), (None, "none", None), (None, "none", None)], key=str)
    assert rejects.count() == 0


def test_nothing_landed(spark):
    source = write(scratch_dir(spark, "landing"), {})
    rows, rejects = landing.ingest(spark, source, ROW, scratch_dir(spark, "target"), scratch_dir(spark, "progress"))
    assert (rows.count(), rows.columns, rejects.count()) == (0, ["id", "s"], 0)
