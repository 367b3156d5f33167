"""Playlists: exploration, five ways to find songs like some anchors, a final list.

``songs`` has one row per track and artist: ``track_id, artist, year,
popularity, danceability, acousticness, energy, valence, instrumentalness,
tempo, key``. ``plays`` has one row per place in a playlist: ``playlist_name,
playlist_id, playlist_followers, playlist_position, track_name, track_id,
artist_name, artist_id, album_name, album_id, duration``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import missing as M
from ..functions.conditions import cut_right, if_else
from ..functions.numbers import decade, ms_to_minutes
from ..functions.text import last_uri_part
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import nested as X
from ..operators import ranking as R
from ..operators.reshape import stack
from ..sources.delimited import read_csv
from ..session import stored
from ..sources.documents import PLAYLIST_DOCUMENT, read_documents

# The published songs table and the analysis' settings.
SONG_SCHEMA = (
    "id string, name string, artists string, year int, popularity double, danceability double, acousticness double, "
    "energy double, valence double, instrumentalness double, tempo double, key int"
)
POPULARITY_BREAKS = [0, 25, 75, 100]
POPULARITY_GROUPS = ["Low", "Medium", "High"]
POPULAR_FROM = 60
QUOTA = {"Not Popular": 4, "Popular": 6}
FEATURES = ["key", "tempo", "year", "popularity", "acousticness", "danceability", "valence", "instrumentalness", "energy"]


def songs(raw: DataFrame) -> DataFrame:
    """One row per artist of each song."""
    return X.explode_names(raw, "artists", "artist").withColumnRenamed("id", "track_id")


def load_songs(spark: SparkSession, path: str) -> DataFrame:
    return songs(read_csv(spark, path, SONG_SCHEMA))


def plays(docs: DataFrame) -> DataFrame:
    """Rows out of playlist documents, with bare identifiers."""
    rows = X.rectangle(docs, "playlists", ["name", "pid", "num_followers"], "tracks", "playlist_position")
    return rows.select(
        F.col("name").alias("playlist_name"),
        F.col("pid").alias("playlist_id"),
        F.col("num_followers").alias("playlist_followers"),
        "playlist_position",
        "track_name",
        last_uri_part("track_uri").alias("track_id"),
        "artist_name",
        last_uri_part("artist_uri").alias("artist_id"),
        "album_name",
        last_uri_part("album_uri").alias("album_id"),
        F.col("duration_ms").alias("duration"),
    )


def load_plays(spark: SparkSession, path: str) -> DataFrame:
    """Plays of all readable documents."""
    return plays(read_documents(spark, path, PLAYLIST_DOCUMENT)[0])


# -- exploration ------------------------------------------------------------


def distinct_counts(p: DataFrame) -> DataFrame:
    artists = A.count_values(p, "artist_id").withColumnRenamed("n", "artists")
    return artists.withColumn("tracks", A.count_values(p, "track_id").scalar())


def top_tracks(p: DataFrame, n: int = 5) -> DataFrame:
    counts = p.groupBy("track_name").agg(F.count("*").alias("appearances"))
    return R.top_n(counts, n, F.desc("appearances"), F.asc("track_name"))


def top_unmatched(p: DataFrame, s: DataFrame) -> DataFrame:
    """Most frequent tracks without features. Appearances are counted before the anti-join."""
    counts = p.groupBy("track_id", "track_name", "artist_name").agg(F.count("*").alias("_n"))
    absent = J.anti(counts, s, ["track_id"])
    sums = absent.groupBy("track_name", "artist_name").agg(F.sum("_n").alias("appearances"))
    return R.top_n_ties(sums, "appearances", 1)


def most_danceable(s: DataFrame, p: DataFrame) -> DataFrame:
    """Only songs with the highest danceability are joined to their places."""
    best = s.where(F.col("danceability") == s.agg(F.max("danceability")).scalar())
    rows = J.join(best, p, ["track_id"]).select("track_name", "artist_name", "danceability", "playlist_name")
    return R.top_n(rows, 1, *[M.asc(c) for c in ("track_name", "artist_name", "playlist_name")])


def longest_playlist(p: DataFrame) -> DataFrame:
    means = p.groupBy("playlist_name").agg(M.mean_strict("duration").alias("mean_ms"))
    top = R.top_n(means, 1, M.desc("mean_ms"), F.asc("playlist_name"))
    return top.withColumn("mean_minutes", F.bround(ms_to_minutes("mean_ms"), 0))


def most_followed(p: DataFrame) -> DataFrame:
    lists = p.select("playlist_id", "playlist_name", "playlist_followers").distinct()
    return R.top_n_ties(lists, "playlist_followers", 1)


def matched(s: DataFrame, p: DataFrame) -> DataFrame:
    """Songs joined to their places; a song repeats once per artist and place."""
    return J.join(s, p, ["track_id"], "inner")


def appearances(s: DataFrame, p: DataFrame) -> DataFrame:
    """Songs with the number of their places as ``n``, counted before the join."""
    return J.join(s, p.groupBy("track_id").agg(F.count("*").alias("n")), ["track_id"], "inner")


def _mean(c: str) -> Column:
    """Mean over places of a column of counted songs."""
    known = F.when(F.col(c).isNotNull(), F.col("n"))
    return F.try_divide(F.sum(F.col(c) * F.col("n")), F.sum(known))


def popularity_groups(s: DataFrame, p: DataFrame) -> DataFrame:
    """Appearances and mean popularity per track, in right-closed groups."""
    titles = p.groupBy("track_id", "track_name").agg(F.count("*").alias("_places"))
    ratings = s.groupBy("track_id").agg(F.count("*").alias("_rows"), M.mean_strict("popularity").alias("mean_popularity"))
    rows = J.join(titles, ratings, ["track_id"], "inner")
    return rows.select(
        "track_id",
        "track_name",
        (F.col("_places") * F.col("_rows")).alias("playlists"),
        "mean_popularity",
        cut_right("mean_popularity", POPULARITY_BREAKS, POPULARITY_GROUPS).alias("popularity_group"),
    )


def by_year(s: DataFrame, p: DataFrame, feature: str) -> DataFrame:
    means = appearances(s, p).groupBy("year").agg(_mean(feature).alias("mean"))
    return means.orderBy(M.desc("mean"), "year")


def best_year(s: DataFrame, p: DataFrame, feature: str) -> DataFrame:
    return R.top_n_ties(by_year(s, p, feature), "mean", 1)


def by_decade(s: DataFrame, p: DataFrame) -> DataFrame:
    counts = appearances(s, p).groupBy(decade("year").alias("decade")).agg(F.sum("n").alias("songs"))
    return counts.orderBy(F.desc("songs"), "decade")


def by_key(s: DataFrame, p: DataFrame) -> DataFrame:
    return appearances(s, p).groupBy("key").agg(F.sum("n").alias("songs")).orderBy(F.desc("songs"), "key")


def lengths(s: DataFrame, p: DataFrame) -> DataFrame:
    known = s.groupBy("track_id").agg(F.count("*").alias("_rows"))
    rows = J.join(p.select("track_id", "duration"), known, ["track_id"], "inner")
    each = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_rows"))))
    return each.select("track_id", ms_to_minutes("duration").alias("track_length"))


def length_stats(s: DataFrame, p: DataFrame) -> DataFrame:
    return A.summary(lengths(s, p), "track_length")


def length_histogram(s: DataFrame, p: DataFrame, width: float = 0.6) -> DataFrame:
    return A.histogram_width(lengths(s, p), "track_length", width, 0, 10)


# -- songs like the anchors; ``titles`` comes from ``titled`` -------------------------------------------------


def titled(s: DataFrame, p: DataFrame) -> DataFrame:
    """Songs with each title and artist they have in playlists, once. Kept, as all searches read it."""
    titles = p.select("track_id", "track_name", "artist_name").distinct()
    return stored(J.join(s, titles, ["track_id"], "inner"), "titles")


def anchors(titles: DataFrame, names: Sequence[str]) -> DataFrame:
    """The anchor songs with their features."""
    rows = titles.where(F.col("track_name").isin(list(names)))
    return rows.select("track_id", "track_name", "artist_name", *FEATURES).distinct()


def cooccurring(p: DataFrame, a: DataFrame, n: int = 20) -> DataFrame:
    """Tracks that most often share a playlist with an anchor."""
    counts = J.cooccurrence(p, a.select("track_id").distinct(), "playlist_id", "track_id", ["track_name", "artist_name"])
    return R.top_n_ties(counts, "n", n)


def same_key_tempo(titles: DataFrame, a: DataFrame, width: float = 5.0, n: int = 15) -> DataFrame:
    """Tracks in the key of some anchor and within a tempo band of some anchor."""
    near = J.semi_band(J.semi(titles, J.small(a.select("key").distinct()), ["key"]), "tempo", a, "tempo", width)
    rows = near.select("track_id", "track_name", "artist_name", "tempo", "key").distinct()
    return R.top_n_ties(rows, "tempo", n)


def same_artist(titles: DataFrame, a: DataFrame) -> DataFrame:
    theirs = J.semi(titles, J.small(a.select("artist_name").distinct()), ["artist_name"])
    return theirs.select("track_id", "track_name", "artist_name").distinct()


def _within(a: DataFrame, feature: str, margin: float) -> Column:
    edges = a.agg((F.min(feature) - margin).alias("lo"), (F.max(feature) + margin).alias("hi"))
    return (F.col(feature) >= edges.select("lo").scalar()) & (F.col(feature) <= edges.select("hi").scalar())


def same_vibe(titles: DataFrame, a: DataFrame, margin: float = 0.1) -> DataFrame:
    """Tracks of an anchor's year, close to the anchors in two features."""
    years = a.agg(F.collect_set("year")).scalar()
    near = titles.where(X.contains(years, "year") & _within(a, "acousticness", margin) & _within(a, "danceability", margin))
    return near.select("track_id", "track_name", "artist_name", "year").distinct()


def same_mood(titles: DataFrame, a: DataFrame, margin: float = 0.001) -> DataFrame:
    near = titles.where(_within(a, "valence", margin))
    return near.select("track_id", "track_name", "artist_name", "valence").distinct()


# -- the final list ---------------------------------------------------------


def final_playlist(titles: DataFrame, p: DataFrame, a: DataFrame, quota: dict[str, int] = QUOTA) -> DataFrame:
    """A quota of popular and other candidates, then the anchors, one row per track.

    Candidates come from co-occurrence, key and tempo, vibe and mood; songs of
    the anchors' artists are left out. Co-occurring tracks have no identifier,
    so at most one of them stays.
    """
    who = ["track_id", "track_name", "artist_name"]
    pool = stack(cooccurring(p, a).drop("n"), *[f.select(who) for f in (same_key_tempo(titles, a), same_vibe(titles, a), same_mood(titles, a))])
    pool = J.anti(pool.select(who), a, ["artist_name"]).distinct()
    rated = ["popularity", "valence", "energy", "danceability"]
    features = titles.select("track_name", "artist_name", *rated).distinct()
    found = J.join(pool, features, ["track_name", "artist_name"], "inner").distinct()
    found = found.withColumn("label", if_else(F.col("popularity") >= POPULAR_FROM, "Popular", "Not Popular"))
    order = [M.asc(c) for c in ("track_name", "artist_name", "track_id", *rated)]
    chosen = A.quota_per_class(found, "label", quota, order)
    place = F.when(F.col("label") == "Not Popular", 0).otherwise(1)
    rows = stack(chosen.withColumn("_place", place), a.select(*who, *rated).withColumn("_place", F.lit(2)))
    return R.first_per_key(rows, ["track_id"], F.asc("_place"), *order).drop("_place")


def ordered(final: DataFrame) -> DataFrame:
    """Numbered by mood and energy, lowest first."""
    mood = M.asc(F.col("valence") + F.col("energy"))
    return R.number_rows(final, mood, M.asc("track_name"), M.asc("artist_name"), M.asc("track_id"), name="order")
