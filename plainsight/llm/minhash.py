"""Near-duplicate documents by SuperMinHash, banding, verification and grouping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .cells import cells, compare
from .graph import components, forest
from .rows import fields, quoted, with_arrays
from .words import mix, shingle_sets

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
# Text that is cut into shingles at a time: a worker needs some fifty times as much for it.
_TEXT_BYTES = 1 << 20


def superminhash(elements: np.ndarray, starts: np.ndarray, m: int, chunk: int = 200_000) -> np.ndarray:
    """Signatures of ``m`` numbers for the sets ``elements[starts[i]:starts[i + 1]]``.

    Element e has a random permutation of the m slots and a rank j + r_j in the j-th
    slot of it; a slot keeps its lowest rank. Ranks of one element are thus spread over
    the slots, which makes estimates less variable than independent hashes. All
    elements take step j together. Once a set has all slots filled, later steps rank
    higher and cannot change them, so that set stops.
    """
    n_sets = len(starts) - 1
    owner = np.repeat(np.arange(n_sets), np.diff(starts))
    out = np.full((n_sets, m), _EMPTY, np.uint64)
    for a in range(0, len(elements), chunk):
        # The lowest ranks of a set are the lowest of its parts.
        own = owner[a : a + chunk]
        part = out[own[0] : own[-1] + 1]
        np.minimum(part, _lowest_ranks(elements[a : a + chunk], own - own[0], len(part), m), out=part)
    return out


def _lowest_ranks(elements: np.ndarray, owner: np.ndarray, n_sets: int, m: int) -> np.ndarray:
    out = np.full(n_sets * m, _EMPTY, np.uint64)
    active = np.arange(len(elements))
    slots = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(elements), 1))
    for j in range(m):
        if not len(active):
            break
        with np.errstate(over="ignore"):
            random = mix(elements[active] + np.uint64(j + 1) * _GOLD)
        k = j + (((random & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
        slot = slots[active, k].astype(np.int64)
        slots[active, k] = slots[active, j]
        np.minimum.at(out, owner[active] * m + slot, (np.uint64(j) << np.uint64(32)) | (random >> np.uint64(32)))
        unfilled = (out.reshape(n_sets, m) == _EMPTY).any(axis=1)
        active = active[unfilled[owner[active]]]
    return out.reshape(n_sets, m)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One number per band of ``rows`` slots; equal slots in a band give equal numbers."""
    n, m = signatures.shape
    grouped = signatures.reshape(n, m // rows, rows)
    key = np.broadcast_to(mix(np.arange(m // rows, dtype=np.uint64)), (n, m // rows))
    for r in range(rows):
        key = mix(key * _GOLD + grouped[:, :, r])
    return key.astype(np.int64)


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values.view(np.int64)))


def _sketch(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    def f(text: pa.Array) -> list:
        h, starts = shingle_sets(text, size)
        keys = superminhash(h, starts, bands * rows)
        total = lambda x: np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])
        sums = [total(mix(h ^ np.uint64(seed))) for seed in (0x5BD1E995, 0x27D4EB2F)]
        f1, f2 = [(s[starts[1:]] - s[starts[:-1]]).view(np.int64) for s in sums]
        flat = band_keys(keys, rows)
        low = (keys & np.uint64(0xFF)).astype(np.uint8)
        return [
            pa.array(np.diff(starts).astype(np.int64)), pa.array(f1), pa.array(f2),
            _lists(flat.reshape(-1), np.arange(len(flat) + 1) * bands),
            pa.array([x.tobytes() for x in low], pa.binary()),
        ]

    added = fields("n_shingles long, f1 long, f2 long, bands array<long>, low binary")
    return with_arrays(docs, ["_text"], added, lambda: f, drop=["_text"], max_bytes=_TEXT_BYTES)


def _sets(docs: DataFrame, ids: DataFrame, size: int, few: int = 200_000) -> DataFrame:
    """``_id`` and the whole set of the documents with these ids, which are distinct and stored.

    Up to ``few`` ids, of eight bytes each, are broadcast; beyond, the texts are shuffled.
    """
    ids = F.broadcast(ids) if ids.count() <= few else ids

    def f(text: pa.Array) -> list:
        return [_lists(*shingle_sets(text, size))]

    wanted = docs.join(ids, "_id", "left_semi")
    sets = with_arrays(wanted, ["_text"], fields("shingles array<long>"), lambda: f, drop=["_text"], max_bytes=_TEXT_BYTES)
    return stored(sets, "sets")


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal numbers start and end."""
    edges = np.flatnonzero(np.diff(x, prepend=-1, append=-1)) if len(x) else np.zeros(1, int)
    return edges[:-1], edges[1:]


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (``a``, ``b``) of ids whose whole sets are similar enough."""
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    similar = 100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)
    return both.where(similar).select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Group documents whose sets of ``size``-word shingles have a Jaccard similarity of ``percent``.

    Returns one row per row of ``docs``: the id, ``n_shingles`` (size of the set),
    ``component_id`` (smallest id that links lead to, its own included) and ``kept``
    (``id = component_id``).

    Documents with equal sets are one from the start. The others meet in buckets of
    equal bands; with 32 bands of 4 slots a pair at the limit is missed with a
    probability of 5e-8. First each document is verified against the smallest one of all
    its buckets, which joins most groups without comparing all pairs. Then, in buckets that
    still hold more than one component, all pairs across components are compared by
    signature, in blocks; those that may reach the limit connect families, and all
    pairs of a family across components are verified, again in blocks. A task passes on
    a spanning forest, not pairs. Links are confirmed on whole sets.

    Words are runs of non-white-space with A-Z lowered. With fewer than ``size`` words
    the whole text is one shingle. A text without words is linked with nothing. Rows
    without an id are kept and have no component; rows with one id are one document
    that has several texts.
    """
    m = bands * rows
    texts = docs.select(F.col(quoted(id_col)).cast("long").alias("_id"), F.col(quoted(text_col)).alias("_text"))
    named = texts.where("_id is not null")
    sketches = stored(_sketch(texts, size, bands, rows), "sketches")
    members = sketches.where("_id is not null and n_shingles > 0").select("_id", "f1", "f2", "n_shingles")
    # Any value will do: bands and low bytes depend on the set alone.
    classes = (
        sketches.where("_id is not null and n_shingles > 0")
        .groupBy("f1", "f2", "n_shingles")
        .agg(F.min("_id").alias("id"), F.any_value("bands").alias("bands"), F.any_value("low").alias("low"))
    )
    classes = stored(classes, "classes")
    banded = classes.select("id", F.col("n_shingles").alias("n"), "low", F.explode("bands").alias("key"))
    centres = banded.groupBy("key").agg(F.min(F.struct("id", "n")).alias("c"), F.count("*").alias("size"))
    centres = stored(centres.where("size > 1").select("key", "c", "size"), "centres")
    close = F.least("n", "c.n") * 100 >= F.greatest("n", "c.n") * percent
    # Sets of whatever shares a bucket, once: the texts are shuffled for it, the sets are not kept for others.
    met = banded.drop("low").join(centres, "key")
    sets = _sets(named, stored(met.select(F.col("id").alias("_id")).distinct(), "wanted"), size)
    first = met.where(close & (F.col("id") != F.col("c.id")))
    first = first.groupBy(F.col("id").alias("a")).agg(F.min("c.id").alias("b"))
    links = stored(_verified(first, sets, percent), "links")
    # An id with several texts holds their classes together.
    several = members.groupBy("_id").agg(F.min(F.struct("f1", "f2")).alias("x"), F.max(F.struct("f1", "f2")).alias("y"))
    several = several.where("x <> y").select("_id")
    same = members.join(several, "_id", "left_semi").join(classes, ["f1", "f2", "n_shingles"]).select(F.col("_id").alias("a"), F.col("id").alias("b"))
    links = stored(links.unionByName(same).distinct(), "links")
    groups = components(links)

    # Buckets of two as well: their pair was not verified where a member has a smaller centre elsewhere.
    open_ = banded.drop("low").join(centres.select("key"), "key")
    open_ = open_.join(groups, F.col("id") == F.col("node"), "left").withColumn("group", F.coalesce("component", "id")).drop("node", "component")
    open_ = stored(open_, "open")
    mixed = open_.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("key")
    mixed = open_.join(stored(mixed, "mixed"), "key").join(classes.select("id", "low"), "id")
    least = int(0.62 * m)

    def alike(table: pa.Table, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs, those of two components that may reach the limit by size and signature."""
        group, n = table["group"].to_numpy(), table["n"].to_numpy()
        ok = group[left] != group[right]
        ok &= np.minimum(n[left], n[right]) * 100 >= np.maximum(n[left], n[right]) * percent
        left, right = left[ok], right[ok]
        low = np.frombuffer(b"".join(table["low"].to_pylist()), np.uint8).reshape(len(n), m)
        hits = [(low[left[i : i + 20000]] == low[right[i : i + 20000]]).sum(axis=1) for i in range(0, len(left), 20000)]
        ok = np.concatenate(hits) >= least if hits else np.zeros(0, bool)
        return left[ok], right[ok]

    def edges(table: pa.Table, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
        ids = table["id"].to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(ids[left]), pa.array(ids[right])], names=["a", "b"])

    def maybe(table: pa.Table, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
        return edges(table, *alike(table, left, right))

    def similar(table: pa.Table, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
        left, right = alike(table, left, right)
        sets = table["shingles"].combine_chunks()
        starts = sets.offsets.to_numpy()
        # Sets as numbers of the shingles in this table, so that a flag per shingle tells what is shared.
        names, values = np.unique(sets.values.to_numpy()[starts[0] : starts[-1]], return_inverse=True)
        starts = starts - starts[0]
        flag = np.zeros(len(names), np.int64)
        ok = np.zeros(len(left), bool)
        for a, b in zip(*_runs(left)):
            own = values[starts[left[a]] : starts[left[a] + 1]]
            n = starts[right[a:b] + 1] - starts[right[a:b]]
            at = np.arange(n.sum()) + np.repeat(starts[right[a:b]] - (np.cumsum(n) - n), n)
            flag[own] = 1
            shared = np.add.reduceat(flag[values[at]], np.cumsum(n) - n)
            flag[own] = 0
            ok[a:b] = 100 * shared >= percent * (len(own) + n - shared)
        return edges(table, left[ok], right[ok])

    # Families: what such pairs connect. All pairs of a family across components are verified
    # where its sets are, so that neither pairs nor sets are sent around once per bucket.
    families = compare(cells(mixed, ["key"], "id"), ["key"], "a long, b long", maybe, combine=forest)
    families = components(stored(families, "maybe"))
    families = stored(families.unionByName(families.select(F.col("component").alias("node"), "component").distinct()), "families")
    rows_ = families.withColumnsRenamed({"node": "id", "component": "family"}).join(classes.select("id", F.col("n_shingles").alias("n"), "low"), "id")
    rows_ = rows_.join(groups, F.col("id") == F.col("node"), "left").withColumn("group", F.coalesce("component", "id")).drop("node", "component")
    rows_ = rows_.join(sets.toDF("id", "shingles"), "id").where(F.size("shingles") == F.col("n"))
    more = compare(cells(rows_, ["family"], "id", block=1024), ["family"], "a long, b long", similar, combine=forest)
    more = stored(more, "links")
    groups = components(links.unionByName(more)) if not more.isEmpty() else groups
    groups = classes.select("f1", "f2", "n_shingles", "id").join(groups, F.col("id") == F.col("node"), "left")
    groups = stored(groups.select("f1", "f2", "n_shingles", F.coalesce("component", "id").alias("component_id")), "groups")
    result = sketches.select("_id", "f1", "f2", "n_shingles").join(groups, ["f1", "f2", "n_shingles"], "left")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id"))
    return result.select(
        F.col("_id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` but for near-duplicates of a row with a smaller id."""
    id_col = options.get("id_col", "doc_id")
    found = near_duplicates(docs, **options)
    gone = stored(found.where("not kept").select(F.col(quoted(id_col)).alias("_gone")).distinct(), "duplicates")
    return docs.join(gone, F.col(quoted(id_col)) == F.col("_gone"), "left_anti")
