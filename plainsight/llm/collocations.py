"""Phrases whose words belong together, by best-first branch-and-bound growth from rare words."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .rows import fields, give_back, quoted, slices, with_arrays
from .words import byte_class, mix, tokenized

# What ends a piece, and what else separates words.
_ENDS = byte_class((0x0A, 0x0D), *[(ord(c), ord(c)) for c in ".,;:!?"])
_IN_WORD = byte_class((0x09, 0x0D), (0x20, 0x20), *[(ord(c), ord(c)) for c in ".,;:!?"], inside=False)
_BASE = np.uint64(0x9E3779B97F4A7C55)
# Languages that are missing.
_UNKNOWN = "und"
# One language's rows are spread over this many tasks before its first ones are chosen.
_SALTS = 64


def longer_key(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """The key of a phrase from those of its parts without the last and without the first word."""
    return mix(mix(prefix) * _BASE + suffix)


class Windows:
    """The words of some texts, as keys that differ between languages, and which of them share a piece."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        self.words = words = tokenized(texts, _IN_WORD)
        coded = langs.cast(pa.string()).fill_null(_UNKNOWN).dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        salt = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in self.langs], np.uint64)
        self.lang = np.repeat(coded.indices.to_numpy(), np.diff(words.at))
        self.keys = [mix(words.hashes + salt[self.lang])] if len(self.lang) else [np.zeros(0, np.uint64)]
        # Words of one piece have passed as many piece ends, of one text.
        owner = np.repeat(np.arange(len(texts)), np.diff(words.at))
        passed = np.cumsum(_ENDS[words.data])[words.starts] if len(words.starts) else np.zeros(0, np.int64)
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (passed[1:] != passed[:-1])
        self.piece = np.cumsum(new)

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all phrases of ``size`` words, and the keys of ``size`` words from every word on (some without meaning)."""
        while len(self.keys) < size:
            last = self.keys[-1]
            self.keys.append(longer_key(last[:-1], last[1:]) if len(last) else last)
        n = max(len(self.piece) - size + 1, 0)
        return np.flatnonzero(self.piece[:n] == self.piece[size - 1 :][:n]), self.keys[size - 1]

    def phrase(self, start: int, size: int) -> str:
        w = self.words
        return b" ".join(w.data[w.starts[i] : w.ends[i]].tobytes() for i in range(start, start + size)).decode()

    def texts(self, places: np.ndarray) -> pa.Array:
        """The words at these places."""
        w = self.words
        size = w.ends[places] - w.starts[places]
        ends = np.cumsum(size)
        data = w.data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(w.starts[places] - ends + size, size)]
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


class Filter:
    """A table of bits: keys put in are found again, a few others too."""

    def __init__(self, table: np.ndarray):
        self.table, self.mask = table, np.uint64(len(table) * 8 - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys & self.mask
        return (self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def filter_of(keys: DataFrame, most_bits: int) -> Filter:
    """A filter of the keys in the first column: tasks build its pieces of 4 KB, the driver puts those together.

    Sixteen bits a key, up to ``2 ** most_bits`` whatever the number of keys: beyond that
    more other keys are found.
    """
    bits = min(most_bits, max(15, (16 * keys.count()).bit_length()))
    place = F.col(keys.columns[0]).bitwiseAND(F.lit((1 << bits) - 1)) + 1
    pieces = keys.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    table = np.zeros((1 << bits) // 8, np.uint8)
    for at, piece in pieces.collect():  # at most 2 ** most_bits / 32,768 rows
        table[(at - 1) * 4096 : at * 4096] = np.frombuffer(piece, np.uint8)
    return Filter(table)


def _signed(keys: np.ndarray) -> pa.Array:
    return pa.array(keys.view(np.int64))


def _each_task(texts: DataFrame, schema: str, f: Callable[[], tuple[Callable, Callable]], max_bytes: int = 4 << 20) -> DataFrame:
    """Run ``take(windows)`` on some ``max_bytes`` of text at a time and ``end()`` last; both yield batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take, end = f()
        for batch in batches:
            for part in slices(batch, max_bytes):
                yield from take(Windows(part.column(0), part.column(1)))
        yield from end()
        del take, end
        give_back()

    return texts.mapInArrow(run, schema)


def word_counts(texts: DataFrame, held: int = 1 << 19) -> DataFrame:
    """How often each word occurs in each language: (``lang``, ``key``, ``n``, ``word``), and with a null key all its words.

    A task emits each word once for some ``held`` distinct words of its texts.
    """
    names = ["lang", "key", "n", "word"]

    def begin():
        chunks: dict[str, list[tuple[np.ndarray, np.ndarray, pa.Array]]] = {}

        def flush():
            for lang, own in chunks.items():
                keys, n, words = zip(*own)
                keys, at, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
                n = np.bincount(back, weights=np.concatenate(n), minlength=len(keys)).astype(np.int64)
                key = pa.concat_arrays([_signed(keys), pa.nulls(1, pa.int64())])
                word = pa.concat_arrays([pa.concat_arrays(words).take(pa.array(at)), pa.nulls(1, pa.large_string())]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), key, pa.array(np.append(n, n.sum())), word], names=names)
            chunks.clear()

        def take(windows: Windows):
            for i, lang in enumerate(windows.langs):
                own = np.flatnonzero(windows.lang == i)
                if len(own):
                    keys, at, n = np.unique(windows.keys[0][own], return_index=True, return_counts=True)
                    chunks.setdefault(lang, []).append((keys, n, windows.texts(own[at])))
            if sum(len(k) for own in chunks.values() for k, _, _ in own) > held:
                yield from flush()

        return take, flush

    counts = _each_task(texts, "lang string, key long, n long, word string", begin)
    return counts.groupBy("lang", "key").agg(F.sum("n").alias("n"), F.min("word").alias("word"))


def phrase_counts(texts: DataFrame, size: int, ends: Broadcast, words: Broadcast, shorter: Broadcast, min_count: int, held: int = 1 << 20) -> DataFrame:
    """Phrases of ``size`` words that occur ``min_count`` times or more and start or end with a word in ``ends``.

    A phrase can be that frequent only where both phrases of one word less are. Those
    that ``ends`` let in were counted before and are in ``shorter``, and its first and
    last words are in ``words``; windows without are not emitted. A task emits each
    phrase once for some ``held`` windows.
    """
    # The last word's key goes with a phrase, from three words on: of two, the parts are the words.
    names = ["p", "s", "n", "w"][: 3 if size == 2 else 4]

    def begin():
        chunks: list[tuple[np.ndarray, ...]] = []

        def flush():
            if chunks:
                p, s, *w = (np.concatenate(c) for c in zip(*chunks))
                _, at, n = np.unique(longer_key(p, s), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(p[at]), _signed(s[at]), pa.array(n), *(_signed(x[at]) for x in w)], names=names)
            chunks.clear()

        def take(windows: Windows):
            start, _ = windows.of(size)
            parts = windows.of(size - 1)[1]
            word = windows.keys[0]
            if not len(start):
                return
            # Per word once, then by place.
            end, known = ends.value.has(word), words.value.has(word)
            first, last = end[start], end[start + size - 1]
            keep = (first | last) & known[start] & known[start + size - 1]
            start, first, last = start[keep], first[keep], last[keep]
            if size > 2:
                # A part was counted where one of its own ends let it in.
                inner, from_second = end[start + size - 2], end[start + 1]
                p, s = parts[start], parts[start + 1]
                keep = (~(first | inner) | shorter.value.has(p)) & (~(last | from_second) | shorter.value.has(s))
                start = start[keep]
            chunks.append((parts[start], parts[start + 1], *([word[start + size - 1]] if size > 2 else [])))
            if sum(len(c[0]) for c in chunks) > held:
                yield from flush()

        return take, flush

    each = _each_task(texts, ", ".join(f"{c} long" for c in names), begin)
    last_word = F.any_value("w") if size > 2 else F.any_value("s")
    counts = each.groupBy("p", "s").agg(F.sum("n").alias("n"), last_word.alias("w")).where(F.col("n") >= min_count)
    return stored(with_arrays(counts, ["p", "s"], fields("key long"), lambda: _keys), f"phrases-{size}")


def _keys(p: pa.Array, s: pa.Array) -> list[pa.Array]:
    return [_signed(longer_key(p.to_numpy().view(np.uint64), s.to_numpy().view(np.uint64)))]


def named(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """The phrases with their text, from the texts of their words."""
    each = phrases.select("p", "s", F.posexplode("words").alias("at", "key")).join(words.select("key", "word"), "key")
    texts = each.groupBy("p", "s").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("own"))
    return phrases.drop("words").join(texts.select("p", "s", F.array_join("own.word", " ").alias("phrase")), ["p", "s"])


def first_rows(df: DataFrame, group: str, n: int, order: Sequence[Column]) -> DataFrame:
    """The first ``n`` rows of each group with their ``rank``: chosen in parts of a group first, then among those."""
    salt = F.pmod(F.xxhash64("key"), F.lit(_SALTS))
    in_part = F.row_number().over(Window.partitionBy(group, salt).orderBy(*order))
    part = df.withColumn("rank", in_part).where(F.col("rank") <= n)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("rank") <= n)


def _scored(levels: dict[int, DataFrame], words: DataFrame, max_words: int) -> DataFrame:
    """Surviving phrases whose first and last words are of the frontier, with their lowest-scoring cut.

    ``words`` are the frontier's and all other frequent words. ``before[k]`` and
    ``after[k]`` are the counts of the parts that the cuts make, taken over from the
    phrases without the last and without the first word. A phrase that starts in the
    frontier has all its beginnings counted, and its ``words`` come from them and its
    last word; one that ends there has all its ends.
    """
    none = F.array().cast("array<long>")
    shorter = words.select("key", "n", "lang", "total", F.col("inside").alias("first"), F.col("inside").alias("last"), none.alias("before"), none.alias("after"), F.array("key").alias("words"))
    out = None
    for size in range(2, max_words + 1):
        p = shorter.select(F.col("key").alias("p"), F.col("n").alias("p_n"), F.col("lang").alias("p_lang"), F.col("total").alias("p_total"), "first", "before", F.col("words").alias("p_words"))
        s = shorter.select(F.col("key").alias("s"), F.col("n").alias("s_n"), F.col("lang").alias("s_lang"), F.col("total").alias("s_total"), "last", "after")
        rows = levels[size].join(p, "p", "left").join(s, "s", "left").select(
            "key", "p", "s", "n", F.coalesce("p_lang", "s_lang").alias("lang"), F.coalesce("p_total", "s_total").alias("total"),
            F.coalesce("first", F.lit(False)).alias("first"), F.coalesce("last", F.lit(False)).alias("last"),
            F.concat("before", F.array("p_n")).alias("before"), F.concat(F.array("s_n"), "after").alias("after"),
            F.concat("p_words", F.array("w")).alias("words"),
        )
        shorter = stored(rows, f"parts-{size}")
        alive = shorter.where("first and last")
        if size < max_words:
            longer = levels[size + 1]
            same = longer.select(F.col("p").alias("key"), "n").union(longer.select(F.col("s").alias("key"), "n"))
            alive = alive.join(same, ["key", "n"], "left_anti")
        out = alive if out is None else out.unionByName(alive)
    exact = "cast({} as decimal(38,0))"
    cut = (
        f"array_min(transform(sequence(0, size(before) - 1), k -> named_struct("
        f"'score', {exact.format('n')} * {exact.format('1000')} * {exact.format('total')} div ({exact.format('before[k]')} * {exact.format('after[k]')}), 'k', k)))"
    )
    return out.withColumn("cut", F.expr(cut)).select(
        "lang", "key", "p", "s", "words", F.col("n").alias("a"), F.expr("before[cut.k]").alias("l"), F.expr("after[cut.k]").alias("r"),
        F.col("total").alias("n"), F.col("cut.score").alias("score"),
    )


def mine(
    docs: DataFrame,
    min_count: int = 100,
    top: int = 2000,
    max_words: int = 5,
    first_share: int = 8,
    filter_bits: int = 27,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """The ``top`` phrases of each language that score highest, without those inside a longer one as frequent.

    Returns ``lang``, ``rank``, ``phrase``, ``a`` (its occurrences), ``l`` and ``r``
    (those of the two parts of its lowest-scoring cut), ``n`` (all words of the
    language) and ``score`` (``1000 * a * n / (l * r)``, rounded down; exact).

    A phrase scores at most ``1000 * n / c`` for the count c of its first word, and of
    its last: a cut next to it leaves a part that occurs at least as often as the
    phrase. So words are the nodes of the first level, rare ones first. The frontier is
    all words up to a count; phrases that start or end with one of them are grown word
    by word, as long as they and their parts occur ``min_count`` times, and phrases
    with both ends inside are scored: their parts, and all phrases one word longer,
    start or end inside too, so nothing that the score or the dropping needs is
    missing. The first frontier has words with an eighth (``first_share``) of a
    language's occurrences. A language is settled when its last wanted score among the
    survivors exceeds the bound of the first word outside; if not, the frontier grows
    up to the count whose bound is that score, or to all words where there are too few
    survivors, which settles it.

    Each level counts windows in tasks and adds the counts up by phrase. Tasks know
    frequent parts from tables of at most ``2 ** filter_bits`` bits (16 MB); beyond some
    10 million phrases these let more windows pass, and results stay exact.
    A language may hold all rows: phrases are spread by key. Words and phrases are told
    apart by hashes, of 64 bits for words and 128 for phrases.

    A missing language is ``und``. A missing or empty text has no words. Repeated rows
    count each. Texts are read whole, a task holds some forty bytes for each of the
    longest text. Ties go by ``a``, then by the phrase's bytes. An empty table gives
    no rows.
    """
    texts = docs.select(F.col(quoted(lang_col)).cast("string").alias("lang"), F.col(quoted(text_col)).alias("text"))
    counts = stored(word_counts(texts).where(F.col("key").isNull() | (F.col("n") >= min_count)), "word-counts")
    totals = counts.where("key is null").select("lang", F.col("n").alias("total"))
    words = stored(counts.where("key is not null").join(totals, "lang"), "frequent-words")

    def share(keys: DataFrame) -> Broadcast:
        return texts.sparkSession.sparkContext.broadcast(filter_of(keys.select("key"), filter_bits))  # of a bounded size

    known = share(words)

    # The first frontier: counts up to the power of two below which an eighth of the occurrences lies.
    power = F.floor(F.log2(F.col("n"))).cast("int")
    by_power = words.groupBy("lang", "total", power.alias("power")).agg(F.sum("n").alias("n"))
    below = F.sum("n").over(Window.partitionBy("lang").orderBy("power"))  # a row per power of two
    start = by_power.withColumn("below", below).where(F.col("below") * first_share <= F.col("total")).groupBy("lang").agg(F.max("power").alias("power"))
    least = F.lit(min_count * 2).cast("long")
    limits = totals.join(start, "lang", "left").select(
        "lang", "total", F.greatest(least, F.coalesce(F.pow(F.lit(2.0), F.col("power") + 1).cast("long"), least)).alias("limit")
    )
    limits = stored(limits, "frontier")
    settled = []
    by_score = [F.desc("score"), F.desc("a")]
    while True:
        inside = words.drop("word").join(limits.select("lang", "limit"), "lang").withColumn("inside", F.col("n") <= F.col("limit")).drop("limit")
        inside = stored(inside, "frontier-words")
        ends, shorter, levels = share(inside.where("inside")), known, {}
        for size in range(2, max_words + 1):
            levels[size] = phrase_counts(texts, size, ends, known, shorter, min_count)
            # The counts are stored: what tasks looked up is not needed again.
            if shorter is not known:
                shorter.destroy()
            shorter = share(levels[size]) if size < max_words else known
        ends.destroy()
        scored = stored(_scored(levels, inside, max_words), "scored")
        # The last wanted place of each language, all ties with it included.
        places = first_rows(scored, "lang", top, by_score)
        edge = places.groupBy("lang").agg(F.min(F.struct("score", "a")).alias("edge"), F.count("*").alias("found"))
        largest = inside.groupBy("lang").agg(F.max("n").alias("largest"))
        state = limits.join(largest, "lang").join(edge, "lang", "left").select(
            "lang", "total", "limit", "largest", "edge", (F.coalesce("found", F.lit(0)) >= top).alias("full")
        )
        bound = F.expr("cast(1000 as decimal(38,0)) * total div (limit + 1)")
        done = (F.col("limit") >= F.col("largest")) | (F.col("full") & (F.col("edge.score") > bound))
        state = stored(state.withColumn("done", F.coalesce(done, F.lit(False))), "frontier-state")
        kept = scored.join(state.where("done").select("lang", "full", "edge"), "lang")
        settled.append(kept.where(~F.col("full") | (F.struct("score", "a") >= F.col("edge"))).drop("full", "edge"))
        if state.where("not done").isEmpty():
            break
        reach = F.expr("cast(1000 as decimal(38,0)) * total div nullif(edge.score, 0)")
        limit = F.when(F.col("full"), F.least(reach, F.col("largest"))).otherwise(F.col("largest"))
        limits = stored(state.where("not done").select("lang", "total", limit.alias("limit")), "frontier")
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    found = stored(found, "phrases")
    ranked = first_rows(named(found, words), "lang", top, [*by_score, F.asc("phrase")])
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
