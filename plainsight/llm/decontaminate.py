"""Find benchmark passages in documents, also with a few edits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import stored
from .rows import fields, give_back, others, slices

_BASE = np.uint64(0x9E3779B97F4A7C55)
_SPACE = 0x20
# Lower-case forms of the first code points that are one code point long.
_LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(0x600)], np.uint32)
_IS_SPACE = np.array([chr(c).isspace() for c in range(0x600)])


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case with runs of white space as one space, and where each stood."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    low = codes < 0x600
    codes = np.where(low, _LOWER[np.where(low, codes, 0)], codes)
    space = (low & _IS_SPACE[np.where(low, codes, 0)]) | (codes == 0x3000) | ((codes >= 0x2000) & (codes <= 0x200A))
    codes = np.where(space, _SPACE, codes)
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    at = np.flatnonzero(keep)
    return codes[at], at


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    n = len(codes) - q + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(q if n > 0 else 0):
        h = h * _BASE + codes[k : k + n].astype(np.uint64) + np.uint64(1)
    return h ^ (h >> np.uint64(29))


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """Fewest edits that turn ``item`` into a part of ``text``, with where it starts and ends.

    Only alignments on diagonals (text position minus item position) from ``low`` to
    ``high`` are looked at. Ties go to the leftmost end. None beyond the budget.
    """
    one = np.int64(1) << np.int64(32)
    far = (np.int64(len(item) + 2)) * one
    width = high - low + 1
    steps = np.arange(width, dtype=np.int64) * one
    # Cell d of row i is item[:i] against text ending at i + low + d: edits, then start.
    ends = low + np.arange(width)
    row = np.where((ends >= 0) & (ends <= len(text)), ends, far)
    for i, code in enumerate(item):
        at = i + ends
        inside = (at >= 0) & (at < len(text))
        cost = np.where(inside, text[np.clip(at, 0, max(len(text) - 1, 0))] != code, True) * one
        new = np.where(inside, row + cost, far)
        new[:-1] = np.minimum(new[:-1], row[1:] + one)
        new = np.where((at + 1 >= 0) & (at + 1 <= len(text)), new, far)
        new = np.minimum.accumulate(new - steps) + steps
        row = np.minimum(new, far)
    best = row >> np.int64(32)
    d = int(np.argmin(best))
    if best[d] > budget:
        return None
    return int(best[d]), int(row[d] & (one - 1)), int(len(item) + low + d)


class PassageIndex:
    """Items of one block, by the q-grams of their normalised text."""

    def __init__(self, ids: list, texts: list[str], q: int, error_rate: float):
        self.q, self.ids, self.codes, self.budget, self.least = q, [], [], [], []
        grams, owner, place = [], [], []
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for id_, text in zip(ids, texts):
            codes, _ = normalised(text.strip())
            m = len(codes)
            if not m:
                continue
            # Each edit destroys q of the m - q + 1 q-grams at most; one must be left.
            budget = min(math.floor(error_rate * m), m - 1)
            if m >= q and budget <= (m - q) // q:
                grams.append(_grams(codes, q))
                owner.append(np.full(m - q + 1, len(self.ids)))
                place.append(np.arange(m - q + 1))
            else:
                # Too short for that: of one piece more than there are edits, one is left whole.
                cuts = [m * j // (budget + 1) for j in range(budget + 2)]
                for a, b in zip(cuts, cuts[1:]):
                    pieces.setdefault(b - a, []).append((int(_grams(codes[a:b], b - a)[0]), len(self.ids), a))
            self.ids.append(id_)
            self.codes.append(codes)
            self.budget.append(budget)
            self.least.append(m - q + 1 - budget * q)
        self.budget, self.least = np.array(self.budget, np.int64), np.array(self.least, np.int64)
        self.pieces = {}
        for size, found in pieces.items():
            found.sort()
            keys = np.array([k for k, _, _ in found], np.uint64)
            self.pieces[size] = (*np.unique(keys, return_index=True, return_counts=True), *np.array([x[1:] for x in found], np.int64).T)
        self.grams = np.zeros(0, np.uint64)
        if not grams:
            return
        all_, owner, place = np.concatenate(grams), np.concatenate(owner), np.concatenate(place)
        order = np.argsort(all_, kind="stable")
        self.grams, first, self.count = np.unique(all_[order], return_index=True, return_counts=True)
        self.owner, self.place, self.first = owner[order], place[order], first
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.grams >> np.uint64(44)).astype(np.int64)] = True

    def find(self, texts: list[str]) -> list[list[tuple]]:
        """For each text the passages in it: item id, start, end, edits, in order."""
        out: list[list[tuple]] = [[] for _ in texts]
        if not self.ids:
            return out
        parts = [normalised(t) for t in texts]
        codes = np.concatenate([x for c, _ in parts for x in (c, np.zeros(1, np.uint32))]) if parts else np.zeros(0, np.uint32)
        begin = np.concatenate([[0], np.cumsum([len(c) + 1 for c, _ in parts])]).astype(np.int64)
        self._find_short(out, parts, codes, begin)
        if not len(self.grams):
            return self._sorted(out)
        h = _grams(codes, self.q)
        at = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        known = self.grams[k] == h[at]
        at, k = at[known], k[known]
        n = self.count[k]
        where = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[k], n)
        item = self.owner[where]
        diagonal = np.repeat(at, n) - self.place[where]
        # Matches of one passage drift by the budget at most. A band is two steps of
        # that width and the next band starts a step on, so one holds any of them whole.
        step = self.budget[item] + 1
        cell = diagonal // step
        low = int(cell.min(initial=0))
        span = int(cell.max(initial=0)) - low + 2
        cells, counts = np.unique(item * span + cell - low, return_counts=True)
        if not len(cells):
            return self._sorted(out)
        after = np.minimum(np.searchsorted(cells, cells + 1), len(cells) - 1)
        counts = counts + np.where(cells[after] == cells + 1, counts[after], 0)
        hot = cells[counts >= self.least[cells // span]]
        for run in np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1) if len(hot) else []:
            i = int(run[0] // span)
            budget = int(self.budget[i])
            first, last = (int(run[0] % span) + low) * (budget + 1), (int(run[-1] % span) + low + 2) * (budget + 1)
            self._add(out, parts, begin, i, first, last)
        return self._sorted(out)

    @staticmethod
    def _sorted(out: list[list[tuple]]) -> list[list[tuple]]:
        return [sorted(set(x), key=lambda r: (r[1], r[2], r[0] is None, r[0])) for x in out]

    def _find_short(self, out: list[list[tuple]], parts: list, codes: np.ndarray, begin: np.ndarray) -> None:
        """Passages of the items too short for the lemma, wherever one of their pieces stands."""
        items, diagonals = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size, (keys, first, count, owner, place) in self.pieces.items():
            h = _grams(codes, size)
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            at = np.flatnonzero(keys[k] == h)
            n = count[k[at]]
            where = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[k[at]], n)
            items.append(owner[where])
            diagonals.append(np.repeat(at, n) - place[where])
        item, diagonal = np.concatenate(items), np.concatenate(diagonals)
        order = np.lexsort((diagonal, item))
        item, diagonal = item[order], diagonal[order]
        # Matches of one passage drift by the budget at most.
        apart = (np.diff(item) != 0) | (np.diff(diagonal) > np.maximum(self.budget[item[1:]], 1))
        edges = np.concatenate([[0], np.flatnonzero(apart) + 1, [len(item)]]) if len(item) else np.zeros(1, np.int64)
        for a, b in zip(edges, edges[1:]):
            self._add(out, parts, begin, int(item[a]), int(diagonal[a]), int(diagonal[b - 1]))

    def _add(self, out: list[list[tuple]], parts: list, begin: np.ndarray, i: int, first: int, last: int) -> None:
        """Verify an item on the diagonals from ``first`` to ``last``, in each text that they reach."""
        # Diagonals are counted over all texts in a row; a passage lies in one.
        budget = int(self.budget[i])
        one = max(0, int(np.searchsorted(begin, first - budget, "right")) - 1)
        two = min(len(parts) - 1, int(np.searchsorted(begin, last + budget, "right")) - 1)
        for doc in range(one, two + 1):
            found = self._verify(i, parts[doc], first - int(begin[doc]), last - int(begin[doc]))
            if found is not None:
                out[doc].append((self.ids[i], *found))

    def _verify(self, i: int, part: tuple[np.ndarray, np.ndarray], first: int, last: int) -> tuple[int, int, int] | None:
        codes, places = part
        item, budget = self.codes[i], int(self.budget[i])
        low, high = first - budget, last + budget
        a, b = max(0, low), min(len(codes), high + len(item) + budget)
        if b <= a:
            return None
        text = codes[a:b]
        exact = text.tobytes().find(item.tobytes())
        if exact >= 0 and exact % 4 == 0:
            edits, start, end = 0, exact // 4, exact // 4 + len(item)
        else:
            best = align(item, text, low - a, high - a, budget)
            if best is None:
                return None
            edits, start, end = best
        return int(places[a + start]), int(places[a + end - 1]) + 1, edits


def _blocks(benchmark: DataFrame, q: int, error_rate: float, block_chars: int) -> Iterator[PassageIndex]:
    items = benchmark.where("text is not null").select("item_id", "text").distinct()
    chars = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = max(1, -(-chars // block_chars))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))) if n > 1 else items.withColumn("block", F.lit(0))
    items = stored(items, "benchmark")
    for k in range(n):
        rows = items.where(F.col("block") == k).orderBy("item_id", "text").collect()
        yield PassageIndex([r["item_id"] for r in rows], [r["text"] for r in rows], q, error_rate)


_FOUND = "found array<struct<item_id: long, start: long, end: long, edits: long>>"


def mark(docs: DataFrame, benchmark: DataFrame, q: int = 8, error_rate: float = 0.08, block_chars: int = 4_000_000, text_col: str = "text") -> DataFrame:
    """Add ``found``: the benchmark passages in each text, with position and edits.

    A passage is a whole item with at most ``error_rate`` edits per character (letters
    in lower case, white space as one space). By the q-gram lemma a region with so few
    edits shares a least number of q-grams with the item, on diagonals as far apart as
    there are edits. Shared q-grams are counted in overlapping bands of diagonals, and
    bands that reach the number are verified by an alignment within the band. Items too
    short for that are looked for by pieces, also inside words. ``start`` and ``end`` are character positions in the text as given.

    Items go to the tasks in blocks of about ``block_chars`` characters, and each block
    is one pass over the documents, without a shuffle: benchmarks do not grow with the
    corpus, and a large one takes more passes, of which each is stored, not more memory.
    A missing text holds nothing; items that are missing or empty are not looked for;
    equal items under two ids are found under both. Texts are read whole, some megabytes
    at a time, of one row at least. Repeated rows are each marked; an empty table stays
    empty, and without items nothing is found. A column named ``found`` is replaced.
    """
    added = fields(_FOUND)
    kept = others(docs, added.fieldNames())
    schema = StructType([docs.schema[c] for c in kept] + added.fields)
    at = docs.columns.index(text_col)
    positions = [docs.columns.index(c) for c in kept]
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("item_id", "start", "end", "edits")]))
    out = None
    for index in _blocks(benchmark, q, error_rate, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index)  # at most block_chars long

        def run(batches: Iterator[pa.RecordBatch], shared=shared, again=out is not None) -> Iterator[pa.RecordBatch]:
            find = shared.value.find
            for whole in batches:
                for part in slices(whole, 1 << 20):
                    found = find([t or "" for t in part.column(at).to_pylist()])
                    rows = [[dict(zip(("item_id", "start", "end", "edits"), r)) for r in x] for x in found]
                    if again:
                        rows = [a + b for a, b in zip(part.column(part.num_columns - 1).to_pylist(), rows)]
                    arrays = [part.column(i) for i in (range(len(kept)) if again else positions)]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(rows, kind)], names=schema.fieldNames())
            give_back()

        if out is None:
            out = docs.mapInArrow(run, schema)
            at = kept.index(text_col)
        else:
            # Stored between passes: chained, a task would hold the items of all blocks.
            out = stored(out, "marked").mapInArrow(run, schema)
    return out


def passages(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per passage found: doc_id, item_id, start, end, edits."""
    found = mark(docs.select("doc_id", "text"), benchmark, **options)
    return found.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a benchmark passage, with their columns."""
    # Numbered columns cannot clash with what is found, and each is sent to Python once.
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    marked = mark(numbered, benchmark, **options, text_col=f"c{docs.columns.index('text')}")
    return marked.where(F.size("found") == 0).select(*numbered.columns).toDF(*docs.columns)
