import os

import pytest
from conftest import values
from pyspark.sql import functions as F

from plainsight.functions import text
from plainsight.plans import election, jobs, payroll, playlist, transit
from plainsight.session import scratch_dir
from plainsight.sources import delimited, dimensions, documents, fanout, html, paged
from plainsight.streaming.landing import drain


def test_csv_round_trip(spark):
    rows = spark.createDataFrame([(1, 'say "hi", ok', None), (2, "", 2.5), (3, None, -1.0)], "i int, s string, d double")
    path = delimited.write_csv(rows, scratch_dir(spark, "csv"))
    back = delimited.read_csv(spark, path, rows.schema)
    assert sorted(values(back)) == sorted(values(rows))


def test_quarantine(spark):
    path = scratch_dir(spark, "lines")
    odd = ['[{"a": 2}, {"a": 3}]', "null", "7"]
    lines = ['{"a": 1}', '{"a": 2', "", "no json", '{"a": null}', *odd]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    good, bad = documents.read_lines(spark, path, "a int")
    assert sorted(values(good), key=str) == [(1,), (None,)]
    assert {v for _, v in values(bad)} == {"no json", '{"a": 2', *odd} and bad.count() == 5


def test_unreadable_files(spark):
    path = scratch_dir(spark, "documents")
    texts = ['{\n"a": 1\n}', '{\n"a":', " ", "[]", ""]
    os.makedirs(path)
    for i, x in enumerate(texts):
        with open(os.path.join(path, f"{i}.txt"), "w") as f:
            f.write(x)
    good, bad = documents.read_documents(spark, path, "a int")
    assert values(good) == [(1,)]
    assert {f[-5:]: v for f, v in values(bad)} == {"1.txt": '{\n"a":', "2.txt": " ", "3.txt": "[]", "4.txt": ""}


def test_row_spans():
    spanned = """<table><thead><tr><th rowspan=2>c</th><th>x</th></tr><tr><th>y</th></tr></thead>
    <tbody><tr><td rowspan="2">A</td><td>1</td></tr><tr><td>3</td></tr><tr><td colspan=2 rowspan=9>w</td><td>5</td></tr></tbody>
    <tbody><tr><td rowspan=0>z</td><td>6</td></tr><tr><td>7</td></tr><tr></tr></tbody></table>"""
    (table,) = html._tables_of(spanned)
    assert table["header"] == ["c", "x", None]
    assert table["cells"] == [
        ["c", "y", None], ["A", "1", None], ["A", "3", None], ["w", "w", "5"], ["z", "6", None], ["z", "7", None], ["z", None, None],
    ]


def test_pages_fill_missing(spark):
    rows = spark.range(25).select("id", F.col("id").cast("string").alias("s"))
    first = paged.land_pages(rows, scratch_dir(spark, "pages"), page_rows=4)
    second = paged.land_pages(rows.drop("s"), scratch_dir(spark, "pages"))
    sizes = [sum(1 for _ in open(os.path.join(first, f))) for f in os.listdir(first) if f.startswith("part")]
    assert max(sizes) <= 4 and sum(sizes) == 25
    back = paged.read_pages(spark, [first, second], "id bigint, s string")
    assert back.count() == 50 and back.where("s is null").count() == 25


def test_only_new(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert values(paged.only_new(rows, spark.createDataFrame([(2,), (2,)], "k int"), ["k"])) == [(1,), (None,)]


def test_drain_takes_new_pages_only(spark):
    landing, target, progress = (scratch_dir(spark, x) for x in ("landing", "target", "progress"))
    rows = spark.range(10).select("id")
    rows.write.json(landing)
    assert drain(spark, landing, "id bigint", target, progress, files_per_batch=1).count() == 10
    rows.select(F.col("id") + 100).toDF("id").write.mode("append").json(landing)
    assert drain(spark, landing, "id bigint", target, progress).count() == 20
    assert drain(spark, landing, "id bigint", target, progress).count() == 20


PAGE = """
<table><tr><th>Name</th></tr><tr><td>x</td></tr></table><script>var t = "<table>";</script>
<TABLE class=a><thead><tr><th>County<br>name</th><th> Total &amp; all</th><th>Margin</th></tr></thead>
<tr><td>A<b>b</b></td><td>1,000<td>2%</tr><tr><td colspan=2>wide</td></tr><tr></tr>
<tr><td>nested <table><tr><td>in</td></tr></table></td></tr></TABLE><table><tr><td>unclosed
"""


def test_html_tables(spark):
    rows = spark.createDataFrame([(1, PAGE), (2, "<p>none</p>"), (3, None)], "i int, page string")
    tables = rows.select("i", html.html_tables("page").alias("t"))
    assert values(tables.where("t is not null").select("i", F.size("t"))) == [(1, 4), (2, 0)]
    assert values(tables.select(html.first_table("t")["header"]))[0] == (["Name"],)
    picked = tables.select("i", html.pick_table("t", "county|parish").alias("tbl"))
    got = values(html.table_rows(picked, "tbl", {"County name": "c", "Total & all": "t", "Margin": "m", "Absent": "x"}))
    assert got[:2] == [(1, 1, "Ab", "1,000", "2%", None), (1, 2, "wide", "wide", None, None)]
    clean = picked.select(html.with_clean_header("tbl").alias("tbl")).where("tbl is not null")
    assert values(clean.select("tbl.header")) == [(["county_name", "total_all", "margin"],)]


def test_fan_out_isolates_failures(spark):
    rows = spark.createDataFrame([(1, "3"), (2, "x"), (3, None)], "k int, p string")
    got = {r.k: r for r in fanout.fan_out(rows, "k", "p", lambda p: str(int(p) * 2)).collect()}
    assert got[1].result == "6" and got[1].error is None
    assert got[2].result is None and got[2].error.startswith("ValueError")
    assert got[3].error.startswith("TypeError")


def test_dimensions(spark):
    states = dimensions.states(spark)
    assert states.count() == 50 and values(states.where("abbreviation = 'WV'"), "state") == [("West Virginia",)]
    assert len(dimensions.FUELS) == 13 and len(dimensions.TRANSIT_MODES) == 18


def test_payroll_from_csv(spark):
    path = scratch_dir(spark, "payroll")
    names = [c.strip().split()[0] for c in payroll.SCHEMA.split(",")]
    def row(**given):
        return tuple(given.get(c) for c in names)
    rows = [
        row(fiscal_year=2020, agency_name="FIRE DEPT", title_description="MAYOR", first_name="A", base_salary=100.0, regular_gross_paid=1.0, total_ot_paid=0.0, pay_basis="per Annum", ot_hours=0.0),
        row(fiscal_year=2020, agency_name="FIRE-DEPT", title_description="CHIEF", first_name="B", last_name="C", base_salary=150.0, regular_gross_paid=1.0, total_ot_paid=5.0, pay_basis="per Annum", ot_hours=2.0),
        row(fiscal_year=2020, agency_name="X", title_description="CHIEF", base_salary=900.0, regular_gross_paid=-1.0, total_ot_paid=5.0),
    ]
    delimited.write_csv(spark.createDataFrame(rows, payroll.SCHEMA), path)
    pay = payroll.load(spark, path)
    assert sorted(values(pay, "agency_name")) == [("Fire Dept",), ("Fire-Dept",)]
    assert values(payroll.above_limit(pay)) == [(2020, "B", None, "C", 155.0)]
    assert values(payroll.cap_savings(pay)) == [(2020, 50.0)]
    assert values(payroll.policy_savings(pay)) == [(2020, "Fire-Dept", 290.0)]
    assert values(payroll.above_limit_detail(pay, n=None)) == [("Fire-Dept", "Chief", 2020, 155.0, 100.0)]


def test_playlists_from_json(spark, tmp_path):
    (tmp_path / "slice.json").write_text(
        '{"info": {},\n "playlists": [{"name": "P", "pid": 7, "num_followers": 3, "tracks": ['
        '{"pos": 0, "track_name": "T", "track_uri": "s:track:t1", "artist_uri": "s:artist:a1", "artist_name": "A", "duration_ms": 60000},\n'
        '{"pos": 1, "track_name": "U", "track_uri": "s:track:t2", "artist_name": "B", "duration_ms": 120000}]},'
        '{"name": "empty", "pid": 8, "tracks": []}, {"name": "none", "pid": 9}]}'
    )
    plays = playlist.load_plays(spark, str(tmp_path))
    assert values(plays, "playlist_name", "playlist_position", "track_id", "artist_id") == [("P", 1, "t1", "a1"), ("P", 2, "t2", None)]
    songs = playlist.songs(spark.createDataFrame([("t1", "['A', 'Z']", 1999, 80.0)], "id string, artists string, year int, popularity double"))
    assert sorted(values(songs, "track_id", "artist")) == [("t1", "A"), ("t1", "Z")]
    assert values(playlist.popularity_groups(songs, plays)) == [("t1", "T", 2, 80.0, "High")]
    assert values(playlist.by_decade(songs, plays)) == [(1990, 2)]
    assert values(playlist.top_unmatched(plays, songs)) == [("U", "B", 1)]
    assert values(playlist.longest_playlist(plays)) == [("P", 90000.0, 2.0)]


def test_energy_sheet(spark):
    names = ["NTD ID", "Agency Name", "Mode", "TOS", "Reporter Type", "Reporting Module", "Other Fuel", "Other Fuel Description", "Diesel Fuel", "Gasoline"]
    rows = [
        ("1", "A", "MB", "DO", "F", "U", "-", "-", "10", "-"),
        ("1", "A", "MB", "PT", "F", "U", "-", "-", "5", "2.5"),
        ("1", "A", "ZZ", "PT", "F", "U", "-", "-", "-", "-"),
    ]
    sheet = transit.read_energy(spark.createDataFrame(rows, names))
    clean = transit.energy(sheet)
    assert values(clean, "ntd_id", "mode", "diesel_fuel", "gasoline") == [(1.0, "MB", 15.0, 2.5)]
    assert values(transit.modes(clean)) == [("MB", "Motorbus")]


def test_election_from_pages(spark):
    def page(*cells):
        body = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in cells)
        return (
            "<table><tr><th>Poll</th></tr></table><table><tr><th>County</th><th>Donald Trump Republican</th><th>Kamala Harris Democratic</th>"
            f"<th>Various candidates Other parties</th><th>Margin</th><th>Total</th></tr><tr><td>County</td><td>#</td></tr>{body}</table>"
        )
    pages = spark.createDataFrame([("Ohio", page(["Ash", "1,000", "900", "5", "100", "1,905"])), ("Utah", "<p>no table</p>")], "state string, page string")
    got = election.results(pages, election.COLUMNS_2024)
    assert values(got) == [("Ash", "Ohio", "1,000", "900", "5", "100", "1,905")]
    assert values(spark.range(1).select(election.page_name(F.lit("Washington"), 2024))) == [
        ("2024_United_States_presidential_election_in_Washington_(state)",)
    ]


def test_first_matches_are_a_part_of_all(spark):
    a = spark.createDataFrame([("cook", "50%", 3), ("cook", "40%", 9), ("clerk", None, 1)], "job_title string, ai_impact string, tasks int")
    b = spark.createDataFrame([("cooks", "none"), ("cooker", "some"), ("clerks", None)], "job_title string, education_level string")
    every = set(values(jobs.match(a, b), "job_title", "ai_impact", "tasks", "education_level"))
    first = values(jobs.first_matches(a, b), "job_title", "ai_impact", "tasks", "education_level")
    assert set(first) <= every and sorted(r[0] for r in first) == ["Clerk", "Cook"]
    # "clerks" is similar to both, and the first similar title in order.
    assert ("Cook", "40%", 9, None) in first
    assert text.clean_name("Job titiles") == "job_titiles"


def test_unshared_scratch_is_refused(spark, monkeypatch):
    from plainsight import session

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.scratch_root(Session())


def test_rows_of_entities_with_a_deadline(spark):
    def work(text):
        for i, part in enumerate(text.split(",")):
            if part == "hang":
                while True:
                    pass
            if part == "fail":
                raise ValueError("failed")
            yield i, ("no number" if part == "odd" else float(part))

    texts = {1: "1,2,3", 2: "4,fail", 3: "5,hang", 4: "6,odd", 5: "7", 6: None, 7: "8,9"}
    rows = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(2)
    found = fanout.fan_out_rows(rows, "id", "text", work, "place int, number double", deadline=0.5)
    assert found.columns == ["id", "place", "number", "error"]
    got = sorted(values(found), key=str)
    assert [r for r in got if r[3] is None] == [(1, 0, 1.0, None), (1, 1, 2.0, None), (1, 2, 3.0, None), (5, 0, 7.0, None), (7, 0, 8.0, None), (7, 1, 9.0, None)]
    failed = {r[0]: r[3] for r in got if r[3] is not None}
    assert failed[2] == "ValueError: failed" and failed[3] == "TimeoutError: no result within 0.5 s"
    assert set(failed) == {2, 3, 4, 6} and all(r[1:3] == (None, None) for r in got if r[3])
    none = fanout.fan_out_rows(rows, "id", "text", lambda text: [], "place int")
    assert none.count() == 0
    many = fanout.fan_out_rows(rows, "id", "text", lambda text: ((i,) for i in range(5000)), "place int", held=1000)
    assert many.count() == 7 * 5000
