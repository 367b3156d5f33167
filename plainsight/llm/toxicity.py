"""Toxicity scores from confirmed examples and unlabelled text (non-negative PU learning)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .rows import fields, fold, others, quoted, with_arrays

_WORD = re.compile(r"[^\W\d_]+")
# Lengths of word beginnings that are features beside the whole words: stems in inflected languages.
_STEMS = range(3, 7)


def _features(word: str) -> list[int]:
    parts = {"=" + word, *(word[:n] for n in _STEMS if n <= len(word))}
    return [xxhash.xxh3_64_intdigest(p.encode("utf-8", "replace")) - (1 << 63) for p in parts]


def text_features(text: str | None) -> list[int]:
    """64-bit hashes of the distinct words of a whole text, and of their beginnings."""
    words = set(_WORD.findall(text.lower())) if text else ()
    return sorted({f for w in words for f in _features(w)})


@dataclass(frozen=True)
class Model:
    """Averaged linear classifiers over the presence of words and word beginnings."""

    weights: dict[int, np.ndarray]
    bias: np.ndarray

    def scorer(self, max_words: int = 150_000) -> Callable[[str | None], float]:
        """A function from a text to its probability of toxicity; 0 from a model without classifiers.

        It remembers up to ``max_words`` words and which features of the model they have.
        """
        known: dict[str, tuple[int, ...]] = {}

        def score(text: str | None) -> float:
            if not len(self.bias):
                return 0.0
            if len(known) > max_words:
                known.clear()
            found: set[int] = set()
            for word in set(_WORD.findall(text.lower())) if text else ():
                features = known.get(word)
                if features is None:
                    features = known[word] = tuple(f for f in _features(word) if f in self.weights)
                found.update(features)
            z = self.bias + sum((self.weights[f] for f in sorted(found)), np.zeros(len(self.bias)))
            return float(1.0 / (1.0 + np.exp(-np.clip(z.mean(), -30, 30))))

        return score


def fit_nnpu(
    starts: np.ndarray,
    features: np.ndarray,
    positive: np.ndarray,
    unlabelled: np.ndarray,
    prior: float,
    n_features: int,
    seed: int,
    steps: int = 1000,
    batch: int = 4096,
    rate: float = 0.05,
    decay: float = 1e-5,
) -> np.ndarray:
    """Weights and bias (last) of one linear classifier.

    Example i has the features ``features[starts[i]:starts[i + 1]]``. Minimises the
    risk ``prior * R_p+ + max(0, R_u- - prior * R_p-)`` under the logistic loss with
    Adam; where the second part is negative in a batch, its gradient is followed
    upwards, so that a flexible classifier cannot drive it below zero.
    """
    rng = np.random.default_rng(seed)
    w, m, v = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    lengths = np.diff(starts)

    def gather(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = lengths[rows]
        owner = np.repeat(np.arange(len(rows)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[rows], n)
        return owner, features[at]

    sigmoid = lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
    step = 0
    n_batches = max(1, -(-max(len(positive), len(unlabelled)) // batch))
    for _ in range(-(-steps // n_batches)):
        p_order, u_order = rng.permutation(positive), rng.permutation(unlabelled)
        for p, u in zip(np.array_split(p_order, n_batches), np.array_split(u_order, n_batches)):
            if not len(p) or not len(u):
                p = rng.choice(positive, min(batch, len(positive)))
                u = rng.choice(unlabelled, min(batch, len(unlabelled)))
            rows = np.concatenate([p, u])
            owner, cols = gather(rows)
            z = np.bincount(owner, weights=w[cols], minlength=len(rows)) + w[-1]
            s, n_p = sigmoid(z), len(p)
            # Loss log(1 + exp(-z)) as positive, log(1 + exp(z)) as negative.
            negative_risk = np.logaddexp(0, z[n_p:]).mean() - prior * np.logaddexp(0, z[:n_p]).mean()
            g = np.empty(len(rows))
            if negative_risk >= 0:
                g[:n_p] = prior * (s[:n_p] - 1 - s[:n_p]) / n_p
                g[n_p:] = s[n_p:] / len(u)
            else:
                g[:n_p] = prior * s[:n_p] / n_p
                g[n_p:] = -s[n_p:] / len(u)
            grad = np.bincount(cols, weights=g[owner], minlength=n_features + 1)
            grad[-1] = g.sum()
            grad[:-1] += decay * w[:-1]
            step += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def train(
    docs: DataFrame,
    labels: DataFrame,
    folds: int = 3,
    held_out: int | None = 1,
    max_positive: int = 6000,
    max_unlabelled: int = 12000,
    max_features: int = 4096,
    min_z: float = 4.0,
    members: int = 3,
    prior: float | None = None,
) -> Model:
    """Train on a bounded sample of labelled rows.

    Labels of the fold ``held_out`` are not read. Confirmed examples are rows
    labelled toxic; the unlabelled ones are drawn from all other training rows and
    confirmed ones alike, without looking at their label. Both samples are the
    lowest hashes of the ids, at most ``max_positive`` and ``max_unlabelled`` ids, so
    they do not depend on partitioning. ``prior`` is the share of toxic rows: given,
    or the share among all labels of the training folds.

    Features are words and word beginnings whose share differs between the samples by ``min_z``
    standard errors, the ``max_features`` strongest. ``members`` classifiers are
    trained and averaged. Labels other than 0 and 1, or without an id, are left out;
    an id that is labelled twice counts as toxic if any label says so. Of the texts that
    an id has in ``docs`` the one with the smallest hash is used. Without a confirmed or
    an unlabelled example, as with an empty table, the model scores every text 0.
    """
    empty = Model({}, np.zeros(0))
    seen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    if held_out is not None:
        seen = seen.where(fold("doc_id", folds) != held_out)
    seen = seen.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    seen = stored(seen.select("doc_id", "toxic", F.xxhash64("doc_id").alias("h")), "toxic-labels")
    n, toxic = seen.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not toxic:
        return empty
    share = prior if prior is not None else toxic / n
    confirmed = seen.where("toxic = 1").orderBy("h", "doc_id").limit(max_positive).select("doc_id", F.lit(1).alias("p"), F.lit(0).alias("u"))
    drawn = seen.orderBy("h", "doc_id").limit(max_unlabelled).select("doc_id", F.lit(0).alias("p"), F.lit(1).alias("u"))
    chosen = confirmed.unionByName(drawn).groupBy("doc_id").agg(F.max("p").alias("p"), F.max("u").alias("u"))
    # At most max_positive + max_unlabelled rows of three numbers.
    # One text of each, so that an id that many rows of ``docs`` share brings no more than another.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    texts = texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).join(F.broadcast(chosen), "doc_id")
    hashed = with_arrays(
        texts.select("doc_id", "p", "u", "text"),
        ["text"],
        fields("words array<long>"),
        lambda: lambda text: [[text_features(t) for t in text.to_pylist()]],
        drop=["text"],
    )
    hashed = stored(hashed, "toxic-examples")
    n_p, n_u = hashed.agg(F.sum("p"), F.sum("u")).first()
    if not n_p or not n_u:
        return empty
    a, b = F.col("np") / n_p, F.col("nu") / n_u
    pooled = (F.col("np") + F.col("nu") + 1) / (n_p + n_u + 2)
    z = (a - b) / F.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u))
    features = (
        hashed.select(F.explode("words").alias("word"), "p", "u")
        .groupBy("word")
        .agg(F.sum("p").alias("np"), F.sum("u").alias("nu"))
        .select("word", F.abs(z).alias("z"))
        .where(F.col("z") >= min_z)
        .orderBy(F.desc("z"), "word")
        .limit(max_features)
        .select("word")
    )
    words = np.array(sorted(r[0] for r in features.collect()), dtype=np.int64)
    if not len(words):
        return empty

    def make():
        return lambda found: [[[int(x) for x in np.intersect1d(f, words)] for f in found.to_pylist()]]

    rows = with_arrays(hashed, ["words"], fields("words array<long>"), make).toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    starts = np.concatenate([[0], np.cumsum([len(x) for x in rows["words"]])]).astype(np.int64)
    flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in rows["words"]]) if starts[-1] else np.zeros(0, np.int64)
    columns = np.searchsorted(words, flat)
    is_p, is_u = np.flatnonzero(rows["p"].to_numpy() == 1), np.flatnonzero(rows["u"].to_numpy() == 1)
    fits = np.stack([fit_nnpu(starts, columns, is_p, is_u, share, len(words), seed) for seed in range(members)])
    return Model({int(word): fits[:, i] for i, word in enumerate(words)}, fits[:, -1])


def score(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from the threshold up).

    Every whole text is read, in one pass without a shuffle. A missing text is scored
    like an empty one. Columns of these names are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most max_features weights per member

    def make():
        fitted = shared.value.scorer()
        return lambda text: [[fitted(t) for t in text.to_pylist()]]

    scored = with_arrays(docs, [text_col], fields("score double"), make)
    keep = [F.col(quoted(c)) for c in others(scored, ["score", "predicted"])]
    return scored.select(*keep, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """The rows of ``docs`` that the trained model does not reject, with their columns.

    Repeated rows and texts without an id are each scored; an empty table stays empty,
    and without labels all rows stay.
    """
    # Numbered columns cannot clash with the score, and each is sent to Python once.
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    scored = score(numbered, train(docs, labels, **options), threshold, text_col=f"c{docs.columns.index('text')}")
    return scored.where("predicted = 0").select(*numbered.columns).toDF(*docs.columns)
