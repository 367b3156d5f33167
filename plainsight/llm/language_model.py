"""Score texts with an n-gram model, as a weighted automaton with failure arcs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import stored
from .rows import fields, fold, quoted
from .words import hashed_words, mix

_BASE = np.uint64(0x9E3779B97F4A7C55)
# Hashes that stand for the beginning and the end of a text.
_BEGIN, _END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
# Key spaces: tokens are counted for the vocabulary, other grams are not.
_TOKENS, _GRAMS = 0, 1
# A block counts less than 2 ** 32 of a key, all blocks together maybe more.
_COUNT, _TOTAL = "<u4", "<u8"


def _planes(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes: those above the data are zero, and compress."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplaned(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def _totals(keys: list[bytes], counts: list[bytes]) -> tuple[list[bytes], int, int]:
    """For the keys of each block what all blocks counted, and how many keys occur, and how often."""
    keys_ = [np.cumsum(_unplaned(k, "<u8"), dtype=np.uint64) for k in keys]
    _, back = np.unique(np.concatenate(keys_), return_inverse=True)
    total = np.bincount(back, weights=np.concatenate([_unplaned(c, _COUNT) for c in counts])).astype(_TOTAL)
    replies = np.split(total[back], np.cumsum([len(k) for k in keys_])[:-1])
    return [_planes(r) for r in replies], int((total > 0).sum()), int(total.sum(dtype=np.int64))


class Grams:
    """The n-grams of some texts: distinct keys of both kinds, and which one ends at each token.

    A gram of k tokens that starts a text counts the beginning as a token. ``index[k]``
    holds for each token the row of the gram of k + 1 tokens that ends there, -1 where
    the text is too short for it. The beginning itself is a row without tokens.
    """

    def __init__(self, texts: pa.Array, order: int):
        words, at = hashed_words(texts)
        n = np.diff(at)
        self.starts = np.concatenate([[0], np.cumsum(n + 1)])
        tokens = np.full(self.starts[-1], _END, np.uint64)
        inside = np.ones(len(tokens), bool)
        inside[self.starts[1:] - 1] = False
        tokens[inside] = words
        self.doc = np.repeat(np.arange(len(n)), n + 1)
        place = np.arange(len(tokens)) - self.starts[self.doc]
        begin, keys = mix(np.array([_BEGIN])), [mix(tokens)]
        for k in range(2, order + 1):
            # A gram is its first k - 1 tokens and the last one.
            before = np.empty_like(keys[-1])
            before[1:] = keys[-1][:-1]
            if k == 2:
                before[self.starts[:-1]] = begin[0]
            keys.append(mix(before * _BASE + tokens + np.uint64(k)))
        self.present = [place + 2 >= k if k > 1 else np.ones(len(tokens), bool) for k in range(1, order + 1)]
        own, back = np.unique(keys[0], return_inverse=True)
        self.tokens = own
        self.index = [back]
        higher = np.concatenate([begin, *[k[p] for k, p in zip(keys[1:], self.present[1:])]])
        self.grams, back = np.unique(higher, return_inverse=True)
        back += len(own)
        self.begin, at = int(back[0]), 1
        for p in self.present[1:]:
            rows = np.full(len(tokens), -1)
            rows[p] = back[at : at + int(p.sum())]
            at += int(p.sum())
            self.index.append(rows)

    def counts(self, counted: np.ndarray) -> np.ndarray:
        """How often each row occurs in the texts that are ``counted``."""
        n = len(self.tokens) + len(self.grams)
        weight = counted[self.doc].astype(float)
        total = sum(np.bincount(i[p], weights=weight[p], minlength=n) for i, p in zip(self.index, self.present))
        total[self.begin] = counted.sum()
        return total.astype(np.int64)


class Automaton:
    """States are grams seen in training; arcs carry log10 probabilities.

    The probability of a token after a context h is ``(c(h, w) + mass * lower) / (c(h) + mass)``,
    where ``lower`` is that after the context without its first token, and at the root
    ``(c(w) + 1) / (N + V + 1)``. A gram that was seen is an arc of that weight; for
    others the failure arc leads from h to the shorter context, for ``mass / (c(h) + mass)``.
    """

    def __init__(self, grams: Grams, counts: np.ndarray, tokens: int, types: int, mass: float):
        self.grams, self.counts, order = grams, counts, len(grams.index)
        n = len(counts)
        share = np.zeros(n)
        share[: len(grams.tokens)] = (counts[: len(grams.tokens)] + 1) / (tokens + types + 1)
        self.failure = np.full(n, -1)
        self.length = np.zeros(n, np.int64)
        self.length[: len(grams.tokens)] = 1
        self.length[grams.begin] = 1
        for k in range(1, order):
            rows, p = grams.index[k], grams.present[k]
            lower = grams.index[k - 1]
            # The context ends one token earlier; at a text's start it is the beginning.
            context = np.concatenate([[-1], lower[:-1]])
            if k == 1:
                context[grams.starts[:-1]] = grams.begin
            row, first = np.unique(rows[p], return_index=True)
            at = np.flatnonzero(p)[first]
            self.failure[row], self.length[row] = lower[at], k + 1
            c = counts[context[at]]
            share[row] = (counts[row] + mass * share[lower[at]]) / (c + mass)
        with np.errstate(divide="ignore"):
            self.arc = np.log10(share)
        self.back_off = np.log10(mass / (counts + mass))

    def scores(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log10 probability of each text, that under the root alone, and its known tokens.

        One pass from left to right, all texts abreast: each carries its state, takes
        failure arcs until the next token has an arc, and moves on.
        """
        g, order = self.grams, len(self.grams.index)
        starts, n = g.starts[:-1], np.diff(g.starts)
        total = np.zeros(len(n))
        by_length = np.argsort(-n, kind="stable")
        state = np.full(len(n), g.begin if order > 1 else -1)
        ended = len(n)
        index = np.stack(g.index)
        for t in range(int(n.max(initial=0))):
            while ended and n[by_length[ended - 1]] <= t:
                ended -= 1
            docs = by_length[:ended]
            at, s, sum_ = starts[docs] + t, state[docs], np.zeros(ended)
            arc = index[np.where(s < 0, 0, self.length[s]), at]
            missing = (s >= 0) & (self.counts[arc] == 0)
            while missing.any():
                sum_ += np.where(missing, self.back_off[s], 0.0)
                s = np.where(missing, self.failure[s], s)
                arc = index[np.where(s < 0, 0, self.length[s]), at]
                missing = (s >= 0) & (self.counts[arc] == 0)
            total[docs] += sum_ + self.arc[arc]
            s = np.where(self.length[arc] >= order, self.failure[arc], arc)
            state[docs] = np.where(self.counts[arc] > 0, s, -1)
        token = g.index[0]
        base = np.bincount(g.doc, weights=self.arc[token], minlength=len(n))
        known = np.bincount(g.doc, weights=self.counts[token] > 0, minlength=len(n)).astype(np.int64)
        return total, base, known


def score(
    docs: DataFrame, train: Column | None = None, order: int = 2, mass: float = 500.0, block_bytes: int = 5 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Learn an n-gram model from the rows where ``train`` holds, and score every text.

    Returns the id, ``n_tokens`` (words and the end), ``n_known`` (those seen in
    training), ``train_tokens``, ``base_score`` (log10 probability by smoothed token
    counts) and ``score`` (that of the model).

    Documents are dealt by hash to blocks of about ``block_bytes``. A block emits the
    distinct grams of its texts, as sorted keys, to parts by key; a part adds up what
    all blocks counted and sends each block the totals of the grams it has. With those
    the block builds the part of the automaton that its texts can reach and walks it
    once. So no task holds the model; a frequent gram has one entry per block, whatever
    its count. What is shuffled grows with the distinct grams of the blocks, in rows whose
    number grows with the power 1.5 of the blocks: there are sixteen times the root of
    the blocks as many parts, and a part adds up slice by slice. All grams are counted, none
    is pruned, as the smoothing needs them all.

    A missing text is empty and has the end token alone. Without training text every
    token is unknown. Rows with one id are texts of their own. An empty table gives none.
    """
    train = F.lit(True) if train is None else F.coalesce(train, F.lit(False))
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    rows = docs.select(F.col(quoted(id_col)).alias("id"), text.alias("text"), train.alias("train"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    # Keys of a part come from a slice of the key space, and are added up in slices as small as half a block. As parts
    # grow with the root of the blocks, rows between blocks and parts grow less than with the square of the blocks.
    n_parts = min(2 * n, math.ceil(16 * math.sqrt(n)))
    n_slices = -(-2 * n // n_parts)
    parts = np.uint64(n_parts * n_slices)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int"))

    def emit(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        grams = Grams(table["text"].chunk(0), order)
        counts = grams.counts(table["train"].to_numpy()).astype(_COUNT)
        out = []
        for kind, keys, own in ((_TOKENS, grams.tokens, counts[: len(grams.tokens)]), (_GRAMS, grams.grams, counts[len(grams.tokens) :])):
            edges = np.searchsorted((keys >> np.uint64(32)) * parts >> np.uint64(32), np.arange(int(parts) + 1))
            for part in range(n_parts):
                cuts = edges[part * n_slices : (part + 1) * n_slices + 1].tolist()
                if cuts[0] < cuts[-1]:
                    steps = [_planes(np.diff(keys[a:b], prepend=np.uint64(0)).astype("<u8")) for a, b in zip(cuts, cuts[1:])]
                    out.append((kind, part, table["block"][0].as_py(), steps, [_planes(own[a:b]) for a, b in zip(cuts, cuts[1:])]))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["kind", "part", "block", "keys", "counts"])

    def add_up(table: pa.Table) -> pa.Table:
        m, types, tokens_ = table.num_rows, 0, 0
        replies: list[list[bytes]] = [[] for _ in range(m)]
        keys, counts = table["keys"].combine_chunks(), table["counts"].combine_chunks()
        for i in range(n_slices):
            found, n_types, n_tokens = _totals(pc.list_element(keys, i).to_pylist(), pc.list_element(counts, i).to_pylist())
            types, tokens_ = types + n_types, tokens_ + n_tokens
            for own, reply in zip(replies, found):
                own.append(reply)
        # Once per part: its types and tokens.
        once = [pa.array([x] + [0] * (m - 1), pa.int64()) for x in (types, tokens_)]
        columns = [table["kind"].combine_chunks(), table["part"].combine_chunks(), table["block"].combine_chunks(), pa.array(replies, pa.list_(pa.binary())), *once]
        return pa.Table.from_arrays(columns, names=["kind", "part", "block", "totals", "types", "tokens"])

    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.binary())]
    emitted = rows.groupBy("block").applyInArrow(emit, "kind int, part long, block int, keys array<binary>, counts array<binary>")
    replies = emitted.groupBy("kind", "part").applyInArrow(add_up, "kind int, part long, block int, totals array<binary>, types long, tokens long")
    replies = stored(replies, "gram-counts")
    types, tokens = replies.where(F.col("kind") == _TOKENS).agg(F.sum("types"), F.sum("tokens")).first()
    types, tokens = types or 0, tokens or 0

    def walk(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows:
            return empty
        table = table.combine_chunks()
        grams = Grams(table["text"].chunk(0), order)
        reply = reply.sort_by([("kind", "ascending"), ("part", "ascending")])
        counts = np.concatenate([_unplaned(t, _TOTAL) for own in reply["totals"].to_pylist() for t in own]).astype(np.int64)
        total, base, known = Automaton(grams, counts, tokens, types, mass).scores()
        columns = [table["id"].combine_chunks(), pa.array(np.diff(grams.starts)), pa.array(known), pa.array(np.full(len(total), tokens, np.int64)), pa.array(base), pa.array(total)]
        return pa.Table.from_arrays(columns, names=names)

    schema = fields("n_tokens long, n_known long, train_tokens long, base_score double, score double")
    schema = StructType([rows.schema["id"], *schema.fields])
    names = schema.fieldNames()
    empty = to_arrow_schema(schema).empty_table()
    scored = rows.select("id", "text", "block").groupBy("block").cogroup(replies.select("block", "kind", "part", "totals").groupBy("block")).applyInArrow(walk, schema)
    return scored.withColumnRenamed("id", id_col)
