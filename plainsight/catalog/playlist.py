"""Playlist study."""

from pyspark.sql import functions as F

from ..plans import bindings as B
from ..plans import playlist as P
from .registry import query

ANCHORS = ["red ring LARGE", "blue bolt SMALL"]

_SONGS = """
    with song0 as (
      select case when p_type = 'PROMO' then 'promo-' || p_partkey else cast(p_partkey as varchar) end as track_id, p_brand as artist, p_size + 1950 as year, p_size * 2.0::double as popularity,
             p_size / 50.0::double as danceability, (p_partkey % 97) / 97.0::double as acousticness, (p_partkey % 89) / 89.0::double as energy,
             (p_partkey % 83) / 83.0::double as valence, (p_partkey % 7) / 7.0::double as instrumentalness, p_retailprice as tempo,
             p_type as key, p_size
      from part),
    songs as (select * exclude (p_size) from song0 union all select * exclude (p_size) replace ('Guest' as artist) from song0 where p_size > 45),
    plays as (
      select 'List ' || o_custkey as playlist_name, o_orderkey as playlist_id, o_totalprice as playlist_followers,
             p_name || ' ' || p_type as track_name, cast(l_partkey as varchar) as track_id, p_brand as artist_name, p_brand as artist_id,
             l_quantity * 10000 as duration
      from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey),
    matched as (select * from songs join plays using (track_id))
    """
_ANCHORS = (
    _SONGS
    + """
    , anchors as (select distinct track_id, track_name, artist_name, key, tempo, year, popularity, acousticness, danceability, valence,
                         instrumentalness, energy from matched where track_name in ('red ring LARGE', 'blue bolt SMALL')),
    h1 as (
      select track_name, artist_name, count(*) as n from
        (select playlist_id from plays where track_id in (select track_id from anchors)) join plays using (playlist_id)
      where track_id not in (select track_id from anchors) group by 1, 2 qualify rank() over (order by count(*) desc) <= 20),
    h2 as (
      select distinct track_id, track_name, artist_name, tempo, key from matched m
      where key in (select key from anchors) and exists (select 1 from anchors a where abs(m.tempo - a.tempo) <= 5)),
    h2top as (select * from h2 qualify rank() over (order by tempo desc) <= 15),
    bounds as (select min(acousticness) - 0.1 as alo, max(acousticness) + 0.1 as ahi, min(danceability) - 0.1 as dlo, max(danceability) + 0.1 as dhi,
                      min(valence) - 0.001 as vlo, max(valence) + 0.001 as vhi from anchors),
    h4 as (select distinct track_id, track_name, artist_name, year from matched, bounds where year in (select year from anchors)
             and acousticness >= alo and acousticness <= ahi and danceability >= dlo and danceability <= dhi),
    h5 as (select distinct track_id, track_name, artist_name, valence from matched, bounds where valence >= vlo and valence <= vhi)
    """
)
_FINAL = (
    _ANCHORS
    + """
    , pool as (
      select distinct track_id, track_name, artist_name from (
        select null as track_id, track_name, artist_name from h1 union all select track_id, track_name, artist_name from h2top
        union all select track_id, track_name, artist_name from h4 union all select track_id, track_name, artist_name from h5)
      where artist_name not in (select artist_name from anchors)),
    found as (
      select distinct track_id, track_name, artist_name, m.popularity, m.valence, m.energy, m.danceability,
             case when m.popularity >= 60 then 'Popular' else 'Not Popular' end as label
      from pool join (select track_name, artist_name, popularity, valence, energy, danceability from matched) m using (track_name, artist_name)),
    chosen as (select * from found qualify row_number() over (partition by label order by track_name, artist_name, track_id nulls last, popularity, valence,
                 energy, danceability) <= case label when 'Popular' then 6 else 4 end),
    everything as (
      select track_id, track_name, artist_name, popularity, valence, energy, danceability, label, case label when 'Popular' then 1 else 0 end as place from chosen
      union all select track_id, track_name, artist_name, popularity, valence, energy, danceability, null, 2 from anchors),
    final as (
      select * exclude (place) from everything qualify row_number() over (partition by track_id order by place, track_name, artist_name, track_id nulls last,
        popularity, valence, energy, danceability) = 1)
    """
)


def _songs(t):
    return P.songs(B.songs_raw(t))


def _both(t):
    return _songs(t), B.plays(t)


def _searched(t):
    """Titles, plays and anchors."""
    s, p = _both(t)
    titles = P.titled(s, p)
    return titles, p, P.anchors(titles, ANCHORS)


@query("pl_songs", _SONGS + "select track_id, artist, year, tempo, key from songs")
def pl_songs(t):
    return _songs(t).select("track_id", "artist", "year", "tempo", "key")


@query(
    "pl_distinct",
    _SONGS + "select count(distinct artist_id) as artists, count(distinct track_id) as tracks from plays",
)
def pl_distinct(t):
    return P.distinct_counts(B.plays(t))


@query("pl_top5", _SONGS + "select track_name, count(*) as appearances from plays group by 1 order by 2 desc, 1 limit 5")
def pl_top5(t):
    return P.top_tracks(B.plays(t))


@query(
    "pl_top_unmatched",
    _SONGS
    + """
    select track_name, artist_name, count(*) as appearances from plays where track_id not in (select track_id from songs)
    group by 1, 2 qualify rank() over (order by count(*) desc) <= 1
    """,
)
def pl_top_unmatched(t):
    s, p = _both(t)
    return P.top_unmatched(p, s)


@query(
    "pl_most_danceable",
    _SONGS
    + """
    select track_name, artist_name, danceability, playlist_name from songs left join plays using (track_id)
    order by danceability desc, track_name nulls last, artist_name nulls last, playlist_name nulls last limit 1
    """,
)
def pl_most_danceable(t):
    return P.most_danceable(_songs(t), B.plays(t, lists=True))


@query(
    "pl_longest",
    _SONGS
    + """
    select playlist_name, round(avg(duration), 4) as mean_ms, round_even(avg(duration) / 60000, 0)::double as mean_minutes
    from plays group by 1 order by avg(duration) desc, 1 limit 1
    """,
)
def pl_longest(t):
    return P.longest_playlist(B.plays(t, lists=True)).withColumn("mean_ms", F.round("mean_ms", 4))


@query(
    "pl_most_followed",
    _SONGS
    + """
    select distinct playlist_id, playlist_name, playlist_followers from plays where playlist_followers = (select max(playlist_followers) from plays)
    """,
)
def pl_most_followed(t):
    return P.most_followed(B.plays(t, lists=True))


@query(
    "pl_popularity_groups",
    _SONGS
    + """
    select track_id, track_name, count(*) as playlists, avg(popularity) as mean_popularity,
           case when avg(popularity) <= 25 then 'Low' when avg(popularity) <= 75 then 'Medium' when avg(popularity) <= 100 then 'High' end as popularity_group
    from matched group by 1, 2
    """,
)
def pl_popularity_groups(t):
    return P.popularity_groups(*_both(t))


@query("pl_year_popularity", _SONGS + "select year, round(avg(popularity), 6) as mean from matched group by 1")
def pl_year_popularity(t):
    return P.by_year(*_both(t), "popularity").withColumn("mean", F.round("mean", 6))


@query(
    "pl_year_dance",
    _SONGS + "select year, round(avg(danceability), 6) as mean from matched group by 1 order by avg(danceability) desc limit 1",
)
def pl_year_dance(t):
    return P.best_year(*_both(t), "danceability").withColumn("mean", F.round("mean", 6))


@query("pl_year_dance_all", _SONGS + "select year, round(avg(danceability), 6) as mean from matched group by 1")
def pl_year_dance_all(t):
    return P.by_year(*_both(t), "danceability").withColumn("mean", F.round("mean", 6))


@query("pl_decade", _SONGS + "select cast(floor(year / 10) * 10 as bigint) as decade, count(*) as songs from matched group by 1")
def pl_decade(t):
    return P.by_decade(*_both(t))


@query("pl_keys", _SONGS + "select key, count(*) as songs from matched group by 1")
def pl_keys(t):
    return P.by_key(*_both(t))


@query(
    "pl_length_stats",
    _SONGS
    + """
    select round(avg(duration / 60000), 6) as mean, round(min(duration / 60000), 6) as min, round(max(duration / 60000), 6) as max,
           round(median(duration / 60000), 6) as median from matched
    """,
)
def pl_length_stats(t):
    stats = P.length_stats(*_both(t))
    return stats.select(*[F.round(c, 6).alias(c) for c in stats.columns])


@query(
    "pl_length_hist",
    _SONGS + "select cast(ceil(round((duration / 60000 - 0.3) / 0.6, 9)) as bigint) as bin, count(*) as n from matched where duration / 60000 <= 10 group by 1",
)
def pl_length_hist(t):
    return P.length_histogram(*_both(t))


@query("pl_anchors", _ANCHORS + "select * from anchors")
def pl_anchors(t):
    return _searched(t)[2]


@query("h1_cooccur", _ANCHORS + "select * from h1")
def h1_cooccur(t):
    _, p, a = _searched(t)
    return P.cooccurring(p, a)


@query("h2_key_tempo", _ANCHORS + "select * from h2top")
def h2_key_tempo(t):
    titles, _, a = _searched(t)
    return P.same_key_tempo(titles, a)


@query(
    "h3_same_artist",
    _ANCHORS + "select distinct track_id, track_name, artist_name from matched where artist_name in (select artist_name from anchors)",
)
def h3_same_artist(t):
    titles, _, a = _searched(t)
    return P.same_artist(titles, a)


@query("h4_vibe", _ANCHORS + "select * from h4")
def h4_vibe(t):
    titles, _, a = _searched(t)
    return P.same_vibe(titles, a)


@query("h5_valence", _ANCHORS + "select * from h5")
def h5_valence(t):
    titles, _, a = _searched(t)
    return P.same_mood(titles, a)


@query("pl_final", _FINAL + "select * from final")
def pl_final(t):
    return P.final_playlist(*_searched(t))


@query(
    "pl_ordered",
    _FINAL
    + """
    select track_id, track_name, valence, energy,
           row_number() over (order by valence + energy, track_name, artist_name, track_id nulls last) as order from final
    """.replace(" as order ", ' as "order" '),
)
def pl_ordered(t):
    rows = P.ordered(P.final_playlist(*_searched(t)))
    return rows.select("track_id", "track_name", "valence", "energy", "order")
