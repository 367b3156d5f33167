"""Near-duplicate vectors by spherical-cap filters of a structured random code."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .cells import cells, compare
from .graph import components, union_find
from .rows import fields, quoted, with_arrays


class CapCode:
    """Filter directions ``(c_i, c_j) / sqrt(2)`` of a random product code.

    Vectors are rotated at random and cut in two halves; each half has ``words`` random
    unit vectors, so ``words ** 2`` directions are known from ``2 * words`` products.
    """

    def __init__(self, dim: int, words: int, listed: int, seed: int = 7):
        rng = np.random.default_rng((seed, dim))
        width = dim + dim % 2
        self.rotation = np.linalg.qr(rng.normal(size=(width, width)))[0][:dim]
        books = rng.normal(size=(2, words, width // 2))
        self.books = books / np.linalg.norm(books, axis=2, keepdims=True)
        self.words, self.listed = words, min(listed, words * words)
        # Products with random directions are about normal with variance 1 / dim.
        self.cap = NormalDist().inv_cdf(1 - self.listed / (words * words + 1)) / np.sqrt(width) * np.sqrt(2)
        ranks = [(i, j) for i in range(words) for j in range(self.listed // (i + 1)) if j < words]
        self.first_ranks = np.array(ranks).T

    def decode(self, vectors: np.ndarray) -> list[np.ndarray]:
        """For each unit vector the directions whose product exceeds the cap, ``listed`` at least.

        Halves' products are sorted; a direction's product is a sum of one of each, so
        only the leading ones of either need be looked at.
        """
        width = self.books.shape[2]
        turned = vectors @ self.rotation
        a, b = turned[:, :width] @ self.books[0].T, turned[:, width:] @ self.books[1].T
        order_a, order_b = np.argsort(-a, axis=1), np.argsort(-b, axis=1)
        out = []
        for x, y, ox, oy in zip(a, b, order_a, order_b):
            x, y = x[ox], y[oy]
            sums = x[self.first_ranks[0]] + y[self.first_ranks[1]]
            limit = min(self.cap, np.partition(sums, len(sums) - self.listed)[len(sums) - self.listed])
            n = np.searchsorted(-y, x[x + y[0] >= limit] - limit, "right")
            i = np.repeat(np.arange(len(n)), n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            out.append(np.sort(ox[i] * self.words + oy[j]))
        return out


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(
    vectors: DataFrame,
    min_cosine: float = 0.98,
    listed: int = 24,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Link vectors of one label whose cosine is ``min_cosine`` or more, and group them.

    Returns one row per row of ``vectors``: the id, ``n_links`` (other rows it is linked
    with), ``component_id`` (smallest id that links lead to, its own included), ``kept``
    (``id = component_id``).

    Equal vectors of a label are one from the start. Each other vector is decoded to the
    list of all filter directions whose cap it lies in, the ``listed`` nearest at least;
    vectors meet on (label, direction). There are about as many directions as vectors,
    so lists per direction stay short as the table grows. A pair's cosine is computed in
    double precision, and counts at the first direction that both lists have. Members of
    a crowded direction meet in blocks; counts and a spanning forest leave a task, not
    pairs. The vectors of a pair at the limit nearly always share most of their nearest
    directions; recall is measured in the tests.

    Vectors that are missing, empty, zero, or have missing or non-finite components,
    those without a label or an id, and vectors of another dimension, link with nothing.
    Rows with one id count one by one; rows without an id have no component and are kept.
    """
    vector = F.col(quoted(vector_col))
    rows = vectors.select(
        F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(label_col)).alias("label"),
        F.when(_usable(vector), vector.cast("array<double>")).alias("vector"),
    )
    usable = F.col("vector").isNotNull() & F.col("label").isNotNull() & F.col("id").isNotNull()
    h1, h2 = F.xxhash64("label", "vector"), F.xxhash64(F.lit(1), F.col("label"), F.col("vector"))
    ids = rows.select("id", F.when(usable, h1).alias("h1"), F.when(usable, h2).alias("h2"))
    classes = (
        rows.where(usable)
        .groupBy(h1.alias("h1"), h2.alias("h2"))
        .agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.any_value("label").alias("label"), F.any_value("vector").alias("vector"))
    )
    classes = stored(classes.withColumn("group", F.xxhash64("label", F.size("vector"))), "vectors")
    n = classes.count()
    words = int(min(4096, max(16, 2 ** np.ceil(np.log2(max(n, 1)) / 2))))

    def decode():
        codes: dict[int, CapCode] = {}

        def f(values: pa.Array) -> list:
            out = []
            for v in values.to_numpy(zero_copy_only=False):
                if len(v) not in codes:
                    codes[len(v)] = CapCode(len(v), words, listed)
                out.append(codes[len(v)].decode((v / np.linalg.norm(v / np.abs(v).max()) / np.abs(v).max())[None])[0])
            return [out]

        return f

    lists = with_arrays(classes.select("id", "copies", "group", "vector"), ["vector"], fields("directions array<int>"), decode, max_bytes=1 << 20)
    met = stored(lists, "directions").withColumn("direction", F.explode("directions"))

    def links(table: pa.Table, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
        chunk = table["vector"].chunk(0)
        x = chunk.flatten().to_numpy(zero_copy_only=False)
        starts = chunk.offsets.to_numpy() - chunk.offsets[0].as_py()
        # Cells hold one dimension, neighbouring cells maybe another.
        size = np.diff(starts)
        dots = np.zeros(len(left))
        norms = np.sqrt(np.add.reduceat(x * x, starts[:-1]))
        for d in np.unique(size[left]):
            whole = np.zeros((len(size), d))
            whole[size == d] = x[np.repeat(size == d, size)].reshape(-1, d)
            at = np.flatnonzero(size[left] == d)
            for part in np.array_split(at, -(-len(at) // 20_000)):
                dots[part] = np.einsum("ij,ij->i", whole[left[part]], whole[right[part]])
        near = dots / (norms[left] * norms[right]) >= min_cosine
        left, right = left[near], right[near]
        # A pair counts where its first common direction is.
        chunk = table["directions"].chunk(0)
        listed_ = chunk.flatten().to_numpy()
        at = chunk.offsets.to_numpy() - chunk.offsets[0].as_py()
        here = table["direction"].to_numpy()
        own = np.zeros(len(left), bool)
        span = np.int64(words * words)
        for part in np.array_split(np.arange(len(left)), max(1, len(left) // 20_000)):
            keys = []
            for side in (left[part], right[part]):
                n_ = np.diff(at)[side]
                where = np.arange(n_.sum()) - np.repeat(np.cumsum(n_) - n_, n_) + np.repeat(at[:-1][side], n_)
                keys.append(np.repeat(np.arange(len(part)), n_) * span + listed_[where])
            common = np.intersect1d(*keys, assume_unique=True)
            pair, first = np.unique(common // span, return_index=True)
            own[part[pair]] = common[first] % span == here[left[part[pair]]]
        left, right = left[own], right[own]
        id_, copies = table["id"].to_numpy(), table["copies"].to_numpy()
        members = np.concatenate([left, right])
        node, back = np.unique(id_[members], return_inverse=True)
        counts = np.bincount(back, weights=copies[np.concatenate([right, left])], minlength=len(node)).astype(np.int64)
        v, u = union_find(id_[left], id_[right])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([node, v]), pa.int64()), pa.array(np.concatenate([counts, np.zeros(len(v), np.int64)]), pa.int64()),
             pa.array(np.concatenate([node, u]), pa.int64())],
            names=["id", "n", "to"],
        )

    keys = ["group", "direction"]
    found = stored(compare(cells(met, keys, "id"), keys, "id long, n long, to long", links), "vector-links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    groups = components(found.where("id <> to").select("id", "to"))
    classes = classes.select("h1", "h2", "id", "copies").join(counts, "id", "left").join(groups, F.col("id") == F.col("node"), "left")
    per_class = classes.select(
        F.col("h1").alias("k1"), F.col("h2").alias("k2"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
        F.coalesce("component", "id").alias("component"),
    )
    per_class = stored(per_class, "vector-groups")
    joined = ids.join(per_class, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    component = F.coalesce("component", "id")
    return joined.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
