"""Sources, sinks and ingest."""

import time

from pyspark.sql import functions as F

from ..operators.nested import rectangle
from ..operators.ranking import top_n
from ..operators.reshape import stack
from ..session import remove_dir, scratch_dir
from ..sources import delimited, documents, fanout, html, manifest, paged, split_documents
from ..streaming.landing import drain, ingest
from .registry import query

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@query("csv_roundtrip", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def csv_roundtrip(t):
    customer = t.customer
    path = delimited.write_csv(customer, scratch_dir(t.spark, "csv"))
    return delimited.read_csv(t.spark, path, customer.schema)


@query(
    "json_doc_rectangle",
    """
    with d as (select source as name, doc_id as pid, n_chars as num_followers, string_split(text, ' ') as w from documents)
    select name, pid, num_followers, unnest(w) as track_name,
           cast(generate_subscripts(w, 1) as bigint) as position
    from d
    """,
)
def json_doc_rectangle(t):
    words = F.split("text", " ")
    tracks = F.transform(words, lambda w, i: F.struct(i.alias("pos"), w.alias("track_name")))
    playlist = F.struct(
        F.col("source").alias("name"), F.col("doc_id").alias("pid"), F.col("n_chars").alias("num_followers"), tracks.alias("tracks")
    )
    packed = t.documents.select(F.to_json(F.struct(F.array(playlist).alias("playlists"))).alias("doc"))
    docs = documents.parse_documents(packed, "doc", documents.PLAYLIST_DOCUMENT)
    rows = rectangle(docs, "playlists", ["name", "pid", "num_followers"], "tracks")
    return rows.select("name", "pid", "num_followers", "track_name", F.col("position").cast("long").alias("position"))


@query(
    "json_split_documents",
    """
    with d as (select source as name, doc_id as pid, n_chars as num_followers, string_split(text, ' ') as w from documents)
    select name, pid, num_followers, unnest(w) as track_name,
           cast(generate_subscripts(w, 1) as bigint) as position
    from d
    """,
)
def json_split_documents(t):
    """The same rows through one large document per slice, which many tasks read.

    The documents are many times as large as the table. Of a large table the slices are
    landed in turns, and a turn's documents are removed once their elements are kept.
    """
    n = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    table_bytes = int(str(t.documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    turns = min(n, _TURNS, 1 + table_bytes // _TURN_BYTES)
    found = []
    for turn in range(turns):
        path = _land_slices(t, n, turn, turns)
        elements, _ = split_documents.read_elements(t.spark, path, "playlists", documents.PLAYLIST)
        found.append(elements)
        remove_dir(t.spark, path)
    docs = stack(*found).select(F.array(F.struct("name", "pid", "num_followers", "tracks")).alias("playlists"))
    rows = rectangle(docs, "playlists", ["name", "pid", "num_followers"], "tracks")
    return rows.select("name", "pid", "num_followers", "track_name", F.col("position").cast("long").alias("position"))


# Turns in which slices are landed: one for each of so many bytes of the table, and so many at most.
_TURNS, _TURN_BYTES = 8, 32 << 20


def _land_slices(t, n, turn, turns):
    """Every ``turns``-th of the ``n`` slices as a document each; rows are brought together as they are and become JSON after that."""
    words = F.split("text", " ")
    tracks = F.transform(words, lambda w, i: F.struct(i.alias("pos"), w.alias("track_name")))
    playlist = F.struct("name", "pid", "num_followers", tracks.alias("tracks"))
    slices = t.spark.range(turn, n, turns).select(F.col("id").cast("int").alias("slice"))
    slice_ = F.pmod("doc_id", F.lit(n)).cast("int")
    rows = t.documents.select(
        slice_.alias("slice"), F.lit(1).alias("part"), F.col("source").alias("name"), F.col("doc_id").alias("pid"), F.col("n_chars").alias("num_followers"), "text"
    ).where(F.coalesce("slice", F.lit(0)) % turns == turn)
    lines = stack(slices.withColumn("part", F.lit(0)), rows, slices.withColumn("part", F.lit(2)))
    lines = lines.repartitionById(len(range(turn, n, turns)), F.coalesce(F.expr(f"slice div {turns}").cast("int"), F.lit(0))).sortWithinPartitions("slice", "part")
    value = (
        F.when(F.col("part") == 0, '{"info": {"slice": "[{"}, "playlists": [null').when(F.col("part") == 2, "]}")
        .otherwise(F.concat(F.lit(", "), F.to_json(playlist)))
    )
    path = scratch_dir(t.spark, "slices")
    lines.select("slice", value.alias("value")).write.partitionBy("slice").text(path)
    return path


@query(
    "json_quarantine",
    """
    with lines as (
      select event_id, event_type, cast(json_extract(props, '$.k') as bigint) as k,
             '{"event_id": ' || event_id || ', "props": ' || props as line
      from events)
    select 'good' as status, event_id, k, cast(null as varchar) as line from lines where event_type <> 'error'
    union all
    select 'quarantined', null, null, line from lines where event_type = 'error'
    """,
)
def json_quarantine(t):
    body = F.concat(F.lit('{"event_id": '), F.col("event_id"), F.lit(', "props": '), F.col("props"))
    closed = F.when(F.col("event_type") == "error", body).otherwise(F.concat(body, F.lit("}")))
    path = scratch_dir(t.spark, "lines")
    t.events.select(closed.alias("value")).write.text(path)
    good, bad = documents.read_lines(t.spark, path, "event_id bigint, props struct<k: bigint>")
    return stack(
        good.select(F.lit("good").alias("status"), "event_id", F.col("props.k").alias("k")),
        bad.select(F.lit("quarantined").alias("status"), F.col("value").alias("line")),
    )


@query(
    "paged_union",
    """
    select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, user_id, event_type, value,
           case when event_type = 'purchase' then props end as props
    from events
    """,
)
def paged_union(t):
    full = t.events.where(F.col("event_type") == "purchase")
    bare = t.events.where(F.col("event_type") != "purchase").drop("props")
    paths = [paged.land_pages(batch, scratch_dir(t.spark, "pages")) for batch in (full, bare)]
    pages = paged.read_pages(t.spark, paths, EVENTS)
    return pages.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


# Rows of a page in the queries below; no table has a multiple of it, so the last page is short.
_PAGE = 2_499


def _landed(t):
    path = scratch_dir(t.spark, "offsets")
    paged.land_pages_by_offset(t.events, path, F.asc("event_id"), page_rows=_PAGE)
    # A page that a longer export left behind.
    stale = t.events.limit(3).withColumn("offset", F.lit(1_000_000 * _PAGE).cast("long"))
    stale.write.mode("append").partitionBy("offset").json(path)
    return paged.read_until_short(t.spark, path, EVENTS, _PAGE)


@query(
    "paged_until_short",
    """
    select (row_number() over (order by event_id) - 1) // 2499 * 2499 as "offset",
           event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, user_id, event_type, value, props
    from events
    """,
)
def paged_until_short(t):
    rows, _ = _landed(t)
    return rows.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "paged_report",
    """
    with p as (select (row_number() over (order by event_id) - 1) // 2499 * 2499 as "offset" from events),
    n as (select "offset", count(*) as n_rows from p group by 1),
    last as (select max("offset") as x from n)
    select "offset", n_rows, case when "offset" = x then 'last' else 'full' end as status from n, last
    union all
    select 2499000000, 3, 'beyond the end'
    """,
)
def paged_report(t):
    return _landed(t)[1]


def _escaped(c):
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _row(*cells):
    return F.concat(F.lit("<tr>"), *[x for c in cells for x in (F.lit("<td> "), c, F.lit("</td>"))], F.lit("</tr>"))


def _key_value_table():
    size = F.length("html")
    return F.concat(
        F.lit("<table class='sep'><tr><th>Item</th><th><b>Value</b></th><th>Rank</th></tr>"),
        _row(F.lit("Address"), _escaped(F.col("url")), F.lit("1")),
        _row(F.lit("Net generation"), F.format_number(size * 1000, 0), F.col("page_id").cast("string")),
        F.lit("<tr><td>Short row</td></tr></table>"),
    )


@query(
    "html_first_table",
    """
    select page_id, 1 as row_no, 'Address' as item, url as value, '1' as rank from pages
    union all
    select page_id, 2, 'Net generation', format('{:,}', length(html) * 1000), cast(page_id as varchar) from pages
    union all
    select page_id, 3, 'Short row', null, null from pages
    """,
)
def html_first_table(t):
    pages = t.pages.select("page_id", F.concat(_key_value_table(), "html").alias("page"))
    found = pages.select("page_id", html.first_table(html.html_tables("page")).alias("tbl"))
    return html.table_rows(found, "tbl", {"Item": "item", "Value": "value", "Rank": "rank"})


@query(
    "html_pick_table",
    """
    select page_id, 1 as row_no, 'North' as county, format('{:,}', length(html)) as total, '10%' as margin from pages
    union all
    select page_id, 2, 'South', cast(page_id as varchar), null from pages
    """,
)
def html_pick_table(t):
    counties = F.concat(
        F.lit("<table><thead><tr><th>COUNTY</th><th>Total</th><th>Margin</th></tr></thead><tbody>"),
        _row(F.lit("North"), F.format_number(F.length("html"), 0), F.lit("10%")),
        _row(F.lit("South"), F.col("page_id").cast("string")),
        F.lit("</tbody></table>"),
    )
    pages = t.pages.select("page_id", F.concat(_key_value_table(), counties, "html").alias("page"))
    picked = html.pick_table(html.html_tables("page"), "County|Parish|Borough|Area|Region|District")
    found = pages.select("page_id", picked.alias("tbl"))
    return html.table_rows(found, "tbl", {"COUNTY": "county", "Total": "total", "Margin": "margin"})


def page_title(page: str) -> str:
    start = page.index("<title>") + len("<title>")
    title = page[start : page.index("</title>", start)]
    if "&" in title:
        raise ValueError("entity in title")
    return title


@query(
    "fanout_isolate",
    """
    with x as (select page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as title from pages)
    select page_id, case when title not like '%&%' then title end as result,
           case when title like '%&%' then 'ValueError: entity in title' end as error
    from x
    """,
)
def fanout_isolate(t):
    return fanout.fan_out(t.pages, "page_id", "html", page_title)


def title_words(page: str):
    """The words of a page's title with their places; a title with an entity never comes to an end."""
    title = page[page.index("<title>") + len("<title>") : page.index("</title>")]
    for i, word in enumerate(title.split(" ")):
        while "&" in word:
            time.sleep(0.01)
        yield i, word


@query(
    "fanout_rows",
    """
    with x as (select page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as title from pages),
    w as (select page_id, title, string_split(title, ' ') as w from x where title not like '%&%')
    select page_id, cast(generate_subscripts(w, 1) - 1 as integer) as place, unnest(w) as word, null as error from w
    union all
    select page_id, null, null, 'TimeoutError: no result within 0.05 s' from x where title like '%&%'
    """,
)
def fanout_rows(t):
    return fanout.fan_out_rows(t.pages, "page_id", "html", title_words, "place int, word string", deadline=0.05)


@query(
    "ingest_new_only",
    """
    select o_orderkey, o_custkey, o_totalprice from orders
    where o_orderkey not in (select o_orderkey from orders where o_orderdate < timestamp '1999-01-01')
    """,
)
def ingest_new_only(t):
    stored = t.orders.where(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    return paged.only_new(t.orders, stored, ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "ingest_once_runs",
    """
    select o_orderkey, o_custkey, o_totalprice,
           case when o_orderdate < timestamp '1997-01-01' then 1 when o_orderdate < timestamp '1999-01-01' then 2 else 3 end as run
    from orders
    """,
)
def ingest_once_runs(t):
    """Three runs that overlap, each storing the orders that none before it did."""
    seen = manifest.Manifest(t.spark, scratch_dir(t.spark, "manifest"), {"o_orderkey": "bigint"}, buckets=8)
    runs = []
    for run, end in enumerate(["1997-01-01", "1999-01-01", "9999-01-01"], start=1):
        landed = t.orders.where(F.col("o_orderdate") < F.lit(end).cast("timestamp_ntz")).select("o_orderkey", "o_custkey", "o_totalprice")
        fresh = manifest.fetch_once(seen, landed, scratch_dir(t.spark, "fetched"), F.asc("o_custkey"))
        runs.append(fresh.withColumn("run", F.lit(run)))
    return stack(*runs)


@query("preview_n", "select o_orderkey, o_custkey, o_totalprice from orders order by o_orderkey limit 10")
def preview_n(t):
    return top_n(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), 10, F.asc("o_orderkey"))


@query(
    "stream_available_now",
    "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, user_id, event_type, value, props from events",
)
def stream_available_now(t):
    spark = t.spark
    landing = paged.land_pages(t.events, scratch_dir(spark, "landing"))
    stored = drain(spark, landing, EVENTS, scratch_dir(spark, "stored"), scratch_dir(spark, "progress"))
    return stored.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def _ingested(t):
    """Events landed as lines, every tenth cut off, a share of them landed twice; in two runs of several batches."""
    spark = t.spark
    source, target, checkpoint = (scratch_dir(spark, x) for x in ("landing", "ingested", "progress"))
    line = F.to_json(F.struct("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), "user_id", "event_type", "value", "props"))
    cut = F.when(F.col("event_id") % 10 == 3, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    lines = t.events.select("event_id", cut.alias("value"))
    lines.select("value").write.text(source)
    ingest(spark, source, EVENTS, target, checkpoint, ["event_id"])
    lines.where("event_id % 7 = 0").select("value").write.mode("append").text(source)
    return ingest(spark, source, EVENTS, target, checkpoint, ["event_id"])


@query(
    "stream_ingest_once",
    """
    select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, user_id, event_type, value, props from events where event_id % 10 <> 3
    """,
)
def stream_ingest_once(t):
    return _ingested(t)[0].withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "stream_rejects",
    """
    select substr(x, 1, 30) as head, count(*) as n from (
      select '{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as x from events where event_id % 10 = 3
      union all
      select '{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') from events where event_id % 10 = 3 and event_id % 7 = 0)
    group by 1
    """,
)
def stream_rejects(t):
    return _ingested(t)[1].groupBy(F.substring("value", 1, 30).alias("head")).agg(F.count("*").alias("n"))
