"""Joins: equi-joins in which NULL keys match, thresholds, lookups, bands, similarity."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from ..functions.missing import as_col
from ..functions.once import once
from ..functions.similarity import jaro_once
from ..session import checkpointed, stored

_RIGHT = "_r_"
BROADCAST_BYTES = 16 << 20


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(and_, conditions)


def _size(df: DataFrame) -> Column:
    """The bytes of all rows: eight for a number, the length of a text, that of its JSON form for what is nested."""
    widths = [F.lit(8)]
    for field in df.schema:
        c = F.col("`" + field.name.replace("`", "``") + "`")
        if isinstance(field.dataType, (StringType, BinaryType)):
            widths.append(F.octet_length(c) + 8)
        elif isinstance(field.dataType, (ArrayType, MapType, StructType)):
            widths.append(F.octet_length(F.to_json(F.struct(c.alias("x")))))
        else:
            widths.append(F.lit(8))
    return F.sum(sum((F.coalesce(w, F.lit(8)).cast("long") for w in widths[1:]), widths[0].cast("long")))


def small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Keep a derived table and mark it for broadcast if it has few bytes.

    Spark cannot see that an aggregate is small and would shuffle the large side
    of a join with it. The table is checkpointed, measured, and broadcast only
    below the limit; a larger one is left to an ordinary join.
    """
    kept = checkpointed(df)
    return F.broadcast(kept) if (kept.agg(_size(kept)).first()[0] or 0) <= max_bytes else kept


def join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] | dict[str, str],
    how: str = "left",
    null_matches: bool = True,
    few: bool = False,
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Equi-join that keeps the left keys and suffixes other shared names.

    ``keys`` are shared names or a left-to-right mapping. NULL keys match each
    other unless ``null_matches`` is off. Catalyst and AQE choose the strategy
    from measured sizes, and split skewed keys.

    AQE cannot split the right side of an outer join, so a left join runs as an
    inner join, which it can, plus the left rows without a match. ``few`` says
    that the right side has only few rows per key and needs no splitting.
    """
    pairs = dict(keys) if isinstance(keys, dict) else {k: k for k in keys}
    one_sided = how in ("left_semi", "left_anti")
    if one_sided:
        # One row per key: a key that fills the right side must not fill a task.
        right = right.select(*pairs.values()).distinct()
    right_keys = {rk: f"{_RIGHT}{rk}" for rk in pairs.values()}
    right = right.withColumnsRenamed(right_keys)
    same = _all(
        [
            F.col(lk).eqNullSafe(F.col(right_keys[rk])) if null_matches else F.col(lk) == F.col(right_keys[rk])
            for lk, rk in pairs.items()
        ]
    )
    if one_sided:
        return left.join(right, same, how)
    clash = [c for c in left.columns if c in right.columns and c not in pairs]
    if clash:
        left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
        right = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    if how == "left" and not few:
        found = left.join(right, same, "inner").drop(*right_keys.values())
        absent = left.join(right.select(*right_keys.values()).distinct(), same, "left_anti")
        return found.unionByName(absent, allowMissingColumns=True)
    return left.join(right, same, how).drop(*right_keys.values())


def semi(left: DataFrame, right: DataFrame, keys, null_matches: bool = True) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``."""
    return join(left, right, keys, "left_semi", null_matches)


def anti(left: DataFrame, right: DataFrame, keys, null_matches: bool = True) -> DataFrame:
    """Rows of ``left`` whose key does not occur in ``right``."""
    return join(left, right, keys, "left_anti", null_matches)


def lookup_first(df: DataFrame, dim: DataFrame, key: dict[str, str], value: str, order: str) -> DataFrame:
    """Left join that takes the first match only, by ``order`` in the lookup table."""
    (left_key, dim_key), = key.items()
    first = dim.groupBy(dim_key).agg(F.min_by(value, order).alias(value))
    return join(df, small(first), {left_key: dim_key}, "left", few=True)


def at_least(df: DataFrame, limits: DataFrame, keys: Sequence[str], value: Column | str, limit: str) -> DataFrame:
    """Join each row to the limit of its group and keep rows that reach it.

    ``limits`` holds one row per key, so the join cannot multiply rows.
    """
    return join(df, small(limits), keys, "inner").where(as_col(value) >= F.col(limit))


def cooccurrence(members: DataFrame, anchors: DataFrame, container: str, item: str, labels: Sequence[str]) -> DataFrame:
    """How often other items share a container with an anchor.

    A container that holds an anchor twice, or two anchors, counts twice. The
    count is carried as a weight per container, so no pair of items is emitted.
    """
    ids = small(anchors.select(item).distinct())
    weights = small(semi(members, ids, [item]).groupBy(container).agg(F.count("*").alias("_weight")))
    others = join(anti(members, ids, [item]).select(container, *labels), weights, [container], "inner")
    return others.groupBy(*labels).agg(F.sum("_weight").alias("n"))


def _half_band(c: Column, width: float) -> Column:
    return F.floor(c / F.lit(width / 2)).cast("long")


def semi_band(df: DataFrame, value: str, anchors: DataFrame, anchor: str, width: float) -> DataFrame:
    """Rows whose value lies within ``width`` of any anchor.

    Anchors shrink to the lowest and highest value of each half-width bucket.
    A row then needs at most one summary row: the nearest anchor from below,
    the nearest from above, and whether its own bucket holds one.
    """
    reach = 3
    buckets = (
        anchors.select(F.col(anchor).cast("double").alias("_v"))
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .groupBy(_half_band(F.col("_v"), width).alias("_b"))
        .agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    )
    step = F.explode(F.array(*[F.lit(d) for d in range(-reach, reach + 1)]))
    summary = (
        buckets.select("*", step.alias("_d"))
        .groupBy((F.col("_b") + F.col("_d")).alias("_bucket"))
        .agg(
            F.max(F.when(F.col("_d") > 0, F.col("_hi"))).alias("_under"),
            F.min(F.when(F.col("_d") < 0, F.col("_lo"))).alias("_over"),
            F.max(F.col("_d") == 0).alias("_inside"),
        )
    )
    x = F.col(value).cast("double")
    near = F.col("_inside") | (F.abs(x - F.col("_under")) <= width) | (F.abs(x - F.col("_over")) <= width)
    summary = small(summary)
    return df.join(summary, (_half_band(x, width) == F.col("_bucket")) & F.coalesce(near, F.lit(False)), "left_semi")


def band_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, width: float) -> DataFrame:
    """All pairs whose values differ by at most ``width``.

    Both sides meet in buckets of that width: the right side, the smaller one, is
    copied to the neighbouring buckets, the exact difference is checked afterwards.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    near = small(right).withColumn("_bucket", F.explode(F.array(*[bucket(right_value) + d for d in (-2, -1, 0, 1, 2)])))
    pairs = left.withColumn("_band", bucket(left_value)).join(near, F.col("_band") == F.col("_bucket"))
    return pairs.where(F.abs(F.col(left_value) - F.col(right_value)) <= width).drop("_band", "_bucket")


def _letters(c: Column) -> Column:
    """The letters of a text as unique numbers, rare ones first.

    A number holds how often the letter occurred so far, and the letter. Later
    occurrences are rarer than first ones, so they lead the order. An empty text
    gets a number of its own, to meet other empty texts.
    """

    def numbered(chars: Column) -> Column:
        def number(ch: Column, i: Column) -> Column:
            seen = F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda other: other == ch))
            return seen.cast("long") * F.lit(1 << 21) + F.ascii(ch)

        return F.sort_array(F.transform(chars, number), asc=False)

    return F.when(F.length(c) == 0, F.array(F.lit(0).cast("long"))).otherwise(once(F.split(c, ""), numbered))


def _shared_at_least(la: Column, lb: Column, similarity: float) -> Column:
    """Fewest shared letters two texts of these lengths need to reach the similarity.

    Jaro is at most (c/la + c/lb + 1)/3 for c shared letters.
    """
    need = F.ceil((3 * similarity - 1) * la * lb / (la + lb) - F.lit(1e-9))
    return F.greatest(F.coalesce(need, F.lit(1)), F.lit(1)).cast("int")


def fuzzy_pairs(left: DataFrame, right: DataFrame, max_dist: float, salts: int = 4) -> DataFrame:
    """Pairs of distinct texts (``left_text``, ``right_text``) within a Jaro distance.

    Exact, without comparing all pairs: two texts of known lengths that share
    at least k letters must share a token among the first ``length - k + 1`` of
    each. Texts meet on (lengths, token); only their first shared token
    counts, so each pair is scored once. Common tokens are salted.
    """
    similarity = 1.0 - max_dist
    if 3 * similarity - 1 <= 0:
        raise ValueError("a distance of 2/3 or more prunes nothing")

    def texts(df: DataFrame, side: str) -> DataFrame:
        one = df.select(F.col(df.columns[0]).alias(f"{side}_text")).where(F.col(f"{side}_text").isNotNull()).distinct()
        tokens = _letters(F.col(f"{side}_text"))
        # Few bytes become many pairs: without a fixed number of partitions AQE
        # would merge them into one task. Kept, as lengths and signatures read them.
        spread = one.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), f"{side}_text")
        return stored(spread.select("*", tokens.alias(f"{side}_tokens"), F.size(tokens).alias(f"{side}_len")), "texts")

    a, b = texts(left, "left"), texts(right, "right")

    def signatures(df: DataFrame, side: str, own: str, other: str, partner: DataFrame, salt: Column) -> DataFrame:
        # One short array of the other side's lengths, read as a scalar.
        other_len = "right_len" if side == "left" else "left_len"
        lengths = partner.agg(F.collect_set(other_len)).scalar()
        spread = df.withColumn(own, F.col(f"{side}_len")).withColumn(other, F.explode(lengths))
        need = _shared_at_least(F.col("_la"), F.col("_lb"), similarity)
        spread = spread.withColumn("_need", need).where((F.col("_need") <= F.col("_la")) & (F.col("_need") <= F.col("_lb")))
        prefix = F.slice(F.col(f"{side}_tokens"), F.lit(1), F.col(own) - F.col("_need") + 1)
        return spread.withColumn("_salt", salt).withColumn("_token", F.explode(prefix)).drop(f"{side}_len")

    sig_a = signatures(a, "left", "_la", "_lb", b, F.pmod(F.xxhash64("left_text"), F.lit(salts)).cast("int"))
    sig_b = signatures(b, "right", "_lb", "_la", a, F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    # A merge join: signatures are many more than the texts whose size Spark knows.
    met = sig_a.join(sig_b.drop("_need").hint("merge"), ["_la", "_lb", "_token", "_salt"])
    # Both token lists are in one order, so the first common one is in both prefixes.
    common = F.array_intersect("left_tokens", "right_tokens")
    candidates = met.withColumn("_common", common).where(
        (F.col("_token") == F.try_element_at("_common", F.lit(1))) & (F.size("_common") >= F.col("_need"))
    )
    scored = candidates.select("left_text", "right_text", jaro_once("left_text", "right_text").alias("similarity"))
    return scored.where(F.round("similarity", 9) >= F.lit(round(similarity, 9)))


def fuzzy_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, max_dist: float, salts: int = 4) -> DataFrame:
    """Inner join on text similarity, scored on distinct texts and joined back."""
    pairs = fuzzy_pairs(left.select(left_key), right.select(right_key), max_dist, salts)
    out = left.join(pairs, F.col(left_key) == F.col("left_text")).drop("left_text")
    clash = {c: f"{c}_y" for c in right.columns if c in left.columns}
    out = out.withColumnsRenamed({c: f"{c}_x" for c in clash})
    right = right.withColumnsRenamed(clash)
    return out.join(right, F.col("right_text") == F.col(clash.get(right_key, right_key))).drop("right_text")
