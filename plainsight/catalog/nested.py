"""Delimited lists, arrays, nested fields, geometry."""

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import missing as M
from ..operators import nested as X
from ..operators.ranking import top_n
from .registry import query


@query("explode_delim", "select p_partkey, unnest(string_split(p_name, ' ')) as word from part")
def explode_delim(t):
    return X.explode_delimited(t.part.select("p_partkey", "p_name"), "p_name", " ", "word").select("p_partkey", "word")


@query(
    "explode_clean",
    """
    select o_orderkey, o_orderpriority as name from orders
    union all select o_orderkey, o_orderstatus from orders
    union all select o_orderkey, 'O' || o_custkey from orders
    """,
)
def explode_clean(t):
    names = F.concat(
        F.lit("['"), F.col("o_orderpriority"), F.lit("', '"), F.col("o_orderstatus"), F.lit("', 'O'"), F.col("o_custkey"), F.lit("']")
    )
    return X.explode_names(t.orders.select("o_orderkey", names.alias("names")), "names", "name")


@query(
    "array_contains",
    """
    select o_orderkey, year(o_orderdate) as year from orders where year(o_orderdate) in
      (select distinct year(o_orderdate) from orders where o_totalprice > (select max(o_totalprice) * 0.999 from orders))
    """,
)
def array_contains(t):
    rows = t.orders.select("o_orderkey", F.year("o_orderdate").alias("year"), "o_totalprice")
    edge = rows.agg((F.max("o_totalprice") * 0.999).alias("edge")).scalar()
    years = rows.where(F.col("o_totalprice") > edge).agg(F.collect_set("year").alias("years")).scalar()
    return rows.where(X.contains(years, "year")).select("o_orderkey", "year")


@query(
    "json_field",
    """
    select event_id, cast(json_extract(props, '$.k') as bigint) as k, cast(json_extract(props, '$.k') as bigint) || '|' || user_id as both
    from events
    """,
)
def json_field(t):
    k = F.get_json_object("props", "$.k").cast("long")
    items = F.array(F.struct(k.alias("v")), F.struct(F.col("user_id").alias("v")))
    return t.events.select("event_id", k.alias("k"), F.array_join(X.fields(items, "v").cast("array<string>"), "|").alias("both"))


def _squares(t):
    x, y, side = F.col("p_partkey") % 100, F.col("p_size"), F.col("p_size") + 1
    return t.part.select("p_partkey", "p_type", "p_size", "p_retailprice", G.square(x, y, side).alias("rings"))


@query(
    "geo_affine",
    """
    with s as (select p_partkey, p_partkey % 100 as x, p_size as y, p_size + 1 as side,
                      case p_type when 'PROMO' then 0.35 when 'LARGE' then 0.35 else 1 end as k,
                      case p_type when 'PROMO' then 40 when 'LARGE' then 55 else 0 end as dx,
                      case p_type when 'PROMO' then -15 when 'LARGE' then -15 else 0 end as dy from part)
    select p_partkey, round(x * k + dx, 6) as x1, round(y * k + dy, 6) as y1, round((x + side) * k + dx, 6) as x2, round((y + side) * k + dy, 6) as y2 from s
    """,
)
def geo_affine(t):
    moved = move(_squares(t), "p_type", {"PROMO": (0.35, 40, -15), "LARGE": (0.35, 55, -15)})
    low, high = F.col("rings")[0][0], F.col("rings")[0][2]
    return moved.select(
        "p_partkey", *[F.round(p[axis], 6).alias(f"{axis}{i}") for i, p in ((1, low), (2, high)) for axis in ("x", "y")]
    )


def move(df, key, moves):
    from ..plans.election import reposition

    return reposition(df, key, "rings", moves)


@query(
    "geo_centroid",
    """
    select p_partkey, round(p_partkey % 100 + (p_size + 1) / 2, 6) as lon, round(p_size + (p_size + 1) / 2, 6) as lat from part
    """,
)
def geo_centroid(t):
    c = G.centroid("rings")
    return _squares(t).select("p_partkey", F.round(c["x"], 6).alias("lon"), F.round(c["y"], 6).alias("lat"))


@query(
    "geo_arrow",
    """
    with c as (select p_partkey, p_partkey % 100 + (p_size + 1) / 2 as lon, p_size + (p_size + 1) / 2 as lat,
                      case when p_size > 5 then p_size / 50 - 0.5 end as shift from part)
    select p_partkey, round(lon, 6) as lon, round(lat, 6) as lat, round(lon + shift * 5, 6) as xend, round(lat, 6) as yend
    from c where shift is not null
    """,
)
def geo_arrow(t):
    from ..plans.election import arrows

    shift = F.when(F.col("p_size") > 5, F.col("p_size") / 50 - 0.5)
    rows = arrows(_squares(t).withColumn("shift", shift), "rings")
    return rows.select("p_partkey", *[F.round(c, 6).alias(c) for c in ("lon", "lat", "xend", "yend")])


@query(
    "density_top1",
    """
    select p_type, round(sum(p_retailprice) / (sum(p_size * 1e6) / 2.59e6), 6) as density from part
    group by 1 having sum(p_size) > 0 order by density desc, p_type limit 1
    """,
)
def density_top1(t):
    from ..functions.numbers import square_miles

    areas = t.part.groupBy("p_type").agg(F.sum("p_retailprice").alias("votes"), square_miles(F.sum(F.col("p_size") * 1e6)).alias("area"))
    dense = areas.where(F.col("area") > 0).select("p_type", M.ratio("votes", "area").alias("density"))
    return top_n(dense, 1, M.desc("density"), F.asc("p_type")).withColumn("density", F.round("density", 6))
