"""Elements of an array in JSON documents of any size, each document read by many tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored
from .documents import CORRUPT, empty_files, filled_files

# Readers cut files at this character: a fragment starts with it, and no key or bracket lies across a cut.
_CUT = "{"
# Files may start with this mark of their encoding.
_BOM = b"\xef\xbb\xbf"
# The table of splits, a row each, is broadcast up to this size.
_BROADCAST_BYTES = 64 << 20
_ELEMENT, _PIECE, _STATE = 0, 1, 2
_STATES = "quotes long, depth0 int, lowest0 int, open0 array<int>, depth1 int, lowest1 int, open1 array<int>"

# What a byte is: a bracket's step, 0 for a quote, or a backslash.
_SLASH = 2
_KINDS = np.zeros(256, np.int8)
_KINDS[[ord(c) for c in "{[}]\\"]] = 1, 1, -1, -1, _SLASH
_MARKS = bytes((_KINDS != 0) | (np.arange(256) == ord('"')))


class Brackets:
    """The quotes and brackets of a piece of JSON, and which brackets open the array of a field."""

    def __init__(self, text: bytes, field: re.Pattern):
        data = np.frombuffer(text, np.uint8)
        # Text is gone over once for the few bytes that matter, the rest is done on those.
        marks = np.flatnonzero(np.frombuffer(text.translate(_MARKS), bool))
        kinds = _KINDS[data[marks]]
        if b"\\" in text:
            keep = ~_escaped(marks, kinds) & (kinds != _SLASH)
            marks, kinds = marks[keep], kinds[keep]
        quote = kinds == 0
        self.quotes = marks[quote]
        brackets = np.flatnonzero(~quote)
        self.at, self.step = marks[brackets], kinds[brackets]
        # Of the marks before a bracket, those that are no brackets are quotes.
        self.odd = (brackets - np.arange(len(brackets))) & 1
        # Both lists of places are in order: a search tells what is in them, without hashing either.
        named = np.array([(m.start(), m.end() - 1) for m in field.finditer(text)], np.int64).reshape(-1, 2)
        keys = np.append(self.quotes, -1)[np.searchsorted(self.quotes, named[:, 0])] == named[:, 0]
        self.names = np.zeros(len(self.at), bool)
        self.names[np.searchsorted(self.at, named[keys, 1])] = True

    def outside(self, in_string: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, steps and named openings of the brackets outside strings, if the text starts inside one or not."""
        keep = self.odd == in_string
        return self.at[keep], self.step[keep], self.names[keep]


def _escaped(marks: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Which quotes follow a run of backslashes of odd length. A bracket there stays one: JSON has no such escape."""
    slash = np.flatnonzero(kinds == _SLASH)
    places = marks[slash]
    first = np.flatnonzero(np.diff(places, prepend=-2) != 1)
    length = np.diff(np.append(first, len(places)))
    last = slash[first + length - 1][length % 2 == 1]
    last = last[last + 1 < len(marks)]
    hit = last[marks[last + 1] == marks[last] + 1] + 1
    escaped = np.zeros(len(marks), bool)
    escaped[hit[kinds[hit] == 0]] = True
    return escaped


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """All files cut before each opening brace, in order within each split: (``file``, ``split``, ``value``).

    Spark's text reader cuts and splits the files. Every fragment gets its brace back;
    the first of a file had none. Fragments are short and many: ``file`` is a hash.
    """
    text = spark.read.option("lineSep", _CUT).text(path)
    place = [_file_key(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("split")]
    return text.select(*place, F.concat(F.lit(_CUT), "value").alias("value"))


def _file_key(file: Column) -> Column:
    return F.xxhash64(file)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The files that have bytes, and the hash that splits name them by: (``key``, ``file``, ``name``, ``length``)."""
    files = filled_files(spark, path).select(_file_key(F.col("file")).alias("key"), "file", "name", "length")
    files = stored(files, "files")
    if not files.groupBy("key").count().where("count > 1").isEmpty():
        raise ValueError(f"two files below {path} have names of one hash")
    return files


def _opened(name: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), "/" + name[5:].lstrip("/")) if name.startswith("file:") else fs.FileSystem.from_uri(name)


def _in_reach(spark: SparkSession, files: DataFrame) -> bool:
    """Whether Arrow can read the files as they are: it knows their store, and Spark's reader would unpack none of them."""
    ends = [r[0] for r in files.select(F.regexp_extract("name", r"\.[^./]*$", 0)).distinct().collect()]
    codecs = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration())
    if any(codecs.getCodec(spark._jvm.org.apache.hadoop.fs.Path("a" + end)) is not None for end in ends):
        return False
    first = files.select("name").first()
    try:
        store, place = _opened(first.name) if first else (None, None)
        return store is not None and store.get_file_info(place).is_file
    except (OSError, pa.ArrowException):
        return False


def _splits(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, int]:
    """Parts of the files, cut and packed about as Spark's readers do, and the number of tasks: (``file``, ``split``, ``name``, ``end``, ``task``)."""
    conf = spark._jsparkSession.sessionState().conf()
    most, cost = conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes()
    total = files.agg(F.sum(F.col("length") + cost)).first()[0]
    step = max(1, min(most, max(cost, total // spark.sparkContext.defaultParallelism)))
    before = F.sum(F.col("length") + cost).over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long")))
    splits = files.withColumn("before", F.coalesce(before, F.lit(0))).select(F.col("key").alias("file"), starts.alias("split"), "name", "length", "before")
    end = F.least(F.col("split") + step, "length")
    task = F.floor((F.col("before") + F.col("split")) / F.lit(step))
    return stored(splits.select("file", "split", "name", end.alias("end"), task.cast("long").alias("task")), "splits"), total // step + 1


def _dealt(splits: DataFrame, tasks: int) -> DataFrame:
    """The rows of the splits, where their tasks read them."""
    if 256 * splits.count() > _BROADCAST_BYTES:
        return splits.repartition(tasks, "task").drop("task")
    numbers = splits.sparkSession.range(0, tasks, 1, tasks).withColumnRenamed("id", "task")
    return numbers.join(F.broadcast(splits), "task").drop("task")


def _part(name: str, start: int, end: int, max_bytes: int) -> Iterator[bytes]:
    """Text from the first cut at or after ``start`` to the first at or after ``end``; pieces of some ``max_bytes``, all but a file's first start at a cut."""
    cut = _CUT.encode()
    store, place = _opened(name)
    with store.open_input_file(place) as f:
        f.seek(start)
        held, at, begun = bytearray(), start, False  # text not given yet, and where it starts
        while data := f.read(max(1 << 16, min(max_bytes, end - at - len(held)))):
            new = at + len(held)
            held += data
            if not begun:
                first = 0 if start == 0 else held.find(cut)
                if first < 0 or at + first >= end:
                    if at + len(held) >= end:
                        return
                    at, held = at + len(held), bytearray()
                    continue
                begun, at, held = True, at + first, held[first:]
            stop = held.find(cut, max(end, new) - at)
            if at + len(held) > end and stop >= 0:
                yield _without_mark(held[:stop], at)
                return
            last = held.rfind(cut)
            if last > 0 and len(held) >= max_bytes:
                yield _without_mark(held[:last], at)
                at, held = at + last, held[last:]
        if begun:
            yield _without_mark(held, at)


def _without_mark(text: bytearray, at: int) -> bytes:
    return bytes(text.removeprefix(_BOM) if at == 0 else text)


def _read_splits(batches: Iterator[pa.RecordBatch], max_bytes: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, bool, bytes]]:
    """The same as :func:`_chunks` from rows that only name the splits."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            name, start, end = (row.column(c)[0].as_py() for c in ("name", "split", "end"))
            for k, text in enumerate(_part(name, start, end, max_bytes)):
                yield row, k == 0, text


def _chunks(batches: Iterator[pa.RecordBatch], max_bytes: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, bool, bytes]]:
    """Text in order: the row it starts at, whether a split starts there, and some ``max_bytes`` of whole fragments."""
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        files = batch.column(0).to_numpy()
        splits = batch.column(1).to_numpy()
        values = batch.column(2).cast(pa.large_string())
        offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + n + 1]
        data = values.buffers()[2]
        new = np.ones(n, bool)
        new[1:] = (splits[1:] != splits[:-1]) | (files[1:] != files[:-1])
        new[0] = last != (batch.column(0)[0].as_py(), int(splits[0]))
        edges = np.unique(np.concatenate([[0, n], np.flatnonzero(new)]))
        for a, b in zip(edges, edges[1:]):
            start = int(a)
            while start < b:
                stop = max(start + 1, min(int(b), int(np.searchsorted(offsets, offsets[start] + max_bytes))))
                text = data.slice(offsets[start], offsets[stop] - offsets[start]).to_pybytes()
                begins = bool(new[start])
                # The first fragment of a file follows no brace.
                yield batch.slice(start, 1), begins, text[1:] if begins and splits[start] == 0 else text
                start = stop
        last = (batch.column(0)[n - 1].as_py(), int(splits[n - 1]))


def _split_states(splits: DataFrame, read: Callable, field: re.Pattern) -> DataFrame:
    """What each split does to the reader's state, for both cases: it starts outside a string, or inside one.

    ``depth`` is how far brackets lead, ``lowest`` the lowest they get on the way, and
    ``open`` the depths at which the field's array opens and stays open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, quotes, cases = None, 0, []

        def finished() -> pa.RecordBatch:
            columns = [row.column(0), row.column(1), pa.array([quotes])]
            for depth, lowest, opened in cases:
                columns += [pa.array([depth], pa.int32()), pa.array([lowest], pa.int32()), pa.array([sorted(set(opened))], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for start, begins, text in read(batches):
            if begins:
                if row is not None:
                    yield finished()
                row, quotes, cases = start, 0, [(0, 0, []), (0, 0, [])]
            brackets = Brackets(text, field)
            for case, (depth, lowest, opened) in enumerate(cases):
                _, step, names_ = brackets.outside((case + quotes) % 2)
                after = depth + np.cumsum(step)
                if len(after):
                    # Lowest depth from each bracket on: what opened above it stays open.
                    ahead = np.minimum.accumulate(after[::-1])[::-1]
                    opened = [d for d in opened if ahead[0] > d] + (after[names_ & (ahead >= after)] - 1).tolist()
                    depth, lowest = int(after[-1]), min(lowest, int(ahead[0]))
                cases[case] = depth, lowest, opened
            quotes += len(brackets.quotes)
        if row is not None:
            yield finished()

    names = ["file", "split", "quotes", "depth0", "lowest0", "open0", "depth1", "lowest1", "open1"]
    return stored(splits.mapInArrow(run, f"file long, split long, {_STATES}"), "split-states")


def _starts(states: DataFrame) -> DataFrame:
    """The state each split starts in, from those before it: inside a string, depth, inside the field's array."""
    order = Window.partitionBy("file").orderBy("split")  # a row per split
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    known = states.withColumn("in_string", F.pmod(F.coalesce(F.sum("quotes").over(before), F.lit(0)), F.lit(2)).cast("int"))
    for name in ("depth", "lowest", "open"):
        known = known.withColumn(name, F.when(F.col("in_string") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1")))
    known = known.withColumn("start_depth", F.coalesce(F.sum("depth").over(before), F.lit(0)).cast("int"))
    opens = F.array_contains("open", (1 - F.col("start_depth")).cast("int"))
    turns = F.when(opens, True).when(F.col("start_depth") + F.col("lowest") <= 1, False)
    known = known.withColumn("_turns", turns).withColumn("inside", F.coalesce(F.last("_turns", True).over(before), F.lit(False)))
    return known.select("file", "split", "in_string", "start_depth", "inside")


def _elements(splits: DataFrame, read: Callable, field: re.Pattern) -> DataFrame:
    """Whole elements, pieces of those that a cut goes through (``mark`` 1 where one begins), and what ends each split.

    For the last kind ``mark`` counts the documents that begin in the split, -1 where
    the split has text outside a document or brackets that close nothing, and ``text``
    tells how the split ends: inside a string, and its depth.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, state = None, None
        rows: list[tuple[int, int, bytes]] = []

        def flush() -> pa.RecordBatch:
            kind, mark, text = zip(*rows)
            n = len(rows)
            at = pa.array(np.zeros(n, np.int32))
            columns = [row.column(0).take(at), row.column(1).take(at), pa.array(kind, pa.int32()), pa.array(mark, pa.int32()), pa.array(text, pa.binary()).cast(pa.string(), safe=False)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=["file", "split", "kind", "mark", "text"])

        def end() -> pa.RecordBatch:
            if state.held is not None:
                rows.append((_PIECE, int(not state.carried), b"".join(state.held)))
            rows.append((_STATE, -1 if state.stray else state.documents, f"{state.in_string} {state.depth}".encode()))
            return flush()

        for start, begins, text in read(batches):
            if begins:
                if row is not None:
                    yield end()
                row = start
                known = [row.column(c)[0].as_py() for c in ("in_string", "start_depth", "inside")]
                if known[0] is None:
                    raise ValueError(f"the files changed while they were read")
                state = _Reader(*known)
            rows += state.read(text, field)
            if rows:
                yield flush()
        if row is not None:
            yield end()

    return stored(splits.mapInArrow(run, "file long, split long, kind int, mark int, text string"), "elements", "zstd")


class _Reader:
    """Follows one split from its known start, and gives the elements that end in it."""

    def __init__(self, in_string: int, depth: int, inside: bool):
        self.in_string, self.depth, self.inside = in_string, depth, inside
        # Text of the element that is open, and whether it began in an earlier split.
        self.carried = inside and depth >= 3
        self.held: list[bytes] | None = [] if self.carried else None
        self.documents, self.stray = 0, False

    def read(self, text: bytes, field: re.Pattern) -> list[tuple[int, int, bytes]]:
        brackets = Brackets(text, field)
        at, step, names = brackets.outside(self.in_string)
        after = self.depth + np.cumsum(step)
        before = after - step
        self._outer_text(text, at, after, before)
        # Inside the array from its opening on until the depth falls to that of the document.
        turns = np.where(names & (before == 1), 1, np.where(after <= 1, 0, -1))
        last = np.maximum.accumulate(np.where(turns >= 0, np.arange(len(at)), -1))
        inside = np.where(last >= 0, turns[last] == 1, self.inside) if len(at) else np.zeros(0, bool)
        begin, end = at[inside & (step > 0) & (before == 2)], at[inside & (step < 0) & (after == 2)] + 1
        out = []
        if self.held is not None:
            self.held.append(text[: end[0]] if len(end) else text)
            if len(end):
                whole = b"".join(self.held)
                out.append((_PIECE, 0, whole) if self.carried else (_ELEMENT, 0, whole))
                self.held, self.carried, end = None, False, end[1:]
        out += [(_ELEMENT, 0, text[a:b]) for a, b in zip(begin.tolist(), end.tolist())]
        if len(begin) > len(end):
            self.held = [text[begin[-1] :]]
        self.in_string = (self.in_string + len(brackets.quotes)) % 2
        if len(at):
            self.depth, self.inside = int(after[-1]), bool(inside[-1])
        return out

    def _outer_text(self, text: bytes, at: np.ndarray, after: np.ndarray, before: np.ndarray) -> None:
        """Documents that begin, and text or brackets outside them."""
        starts = at[(before == 0) & (after == 1)]
        self.documents += len(starts)
        self.stray |= bool((after < 0).any()) or any(text[i] != ord(_CUT) for i in starts.tolist())
        edges = np.concatenate([[0], at[after == 0] + 1, [len(text)]]) if self.depth == 0 else np.concatenate([at[after == 0] + 1, [len(text)]])
        for a in edges[:-1].tolist():
            following = at[np.searchsorted(at, a)] if len(at) and at[-1] >= a else len(text)
            self.stray |= bool(text[a:following].strip())


def _elements_of_fragments(fragments: DataFrame, field: re.Pattern) -> DataFrame:
    """The same elements through Spark's text reader, a row per fragment."""
    starts = stored(_starts(_split_states(fragments, _chunks, field)), "split-starts")
    if 48 * starts.count() <= _BROADCAST_BYTES:
        placed = fragments.join(F.broadcast(starts), ["file", "split"], "left")
    else:
        numbered = fragments.withColumn("_id", F.monotonically_increasing_id())
        placed = numbered.join(starts.hint("merge"), ["file", "split"], "left").sortWithinPartitions("file", "split", "_id").drop("_id")
    return _elements(placed.select("file", "split", "value", "in_string", "start_depth", "inside"), _chunks, field)


def read_elements(spark: SparkSession, path: str, field: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The objects in the array ``field`` of each JSON document, and what could not be read.

    A document is one object in a file of its own. Returns the elements' fields, after
    ``file``, and the rejects (``file``, ``value``, ``reason``): files that hold no
    object, more than one, other text, or that end early, with a NULL value, and single
    elements that do not fit the schema. Elements that are no objects are skipped, as
    are other fields of the document; one without the field has no elements.

    Files of any size: they are split, and a task reads its split alone; by Arrow, or
    by Spark's reader where Arrow does not know the store or files are packed. Whether a
    bracket is structure depends on all text before it, so a first pass finds for each
    split how it changes strings, depth and the open array, in both cases; those rows
    are put in order to give each split's start. A second pass cuts out the elements.
    Only pieces of elements that lie across splits are shuffled. An element, not a
    document, must fit in a task.

    The files are read before this returns. The elements' texts are kept, compressed, in
    the scratch folder, and both tables read those, so the files may be removed.
    """
    if _CUT in field or '"' in field or "\\" in field:
        raise ValueError("the field's name must be plain")
    pattern = re.compile(rb'"' + re.escape(field.encode()) + rb'"\s*:\s*\[')
    files = _files(spark, path)
    if _in_reach(spark, files):
        splits, tasks = _splits(spark, files)
        starts = _starts(_split_states(_dealt(splits, tasks), _read_splits, pattern))
        known = stored(splits.join(starts, ["file", "split"], "left"), "split-starts")
        found = _elements(_dealt(known, tasks), _read_splits, pattern)
    else:
        found = _elements_of_fragments(_fragments(spark, path), pattern)

    pieces = found.where(F.col("kind") == _PIECE)
    heads = F.sum("mark").over(Window.partitionBy("file").orderBy("split", "mark"))  # two rows a split, without texts
    numbered = pieces.select("file", "split", "mark").withColumn("element", heads)
    parts = pieces.join(numbered, ["file", "split", "mark"]).groupBy("file", "element").agg(F.array_sort(F.collect_list(F.struct("split", "mark", "text"))).alias("parts"))
    whole = parts.select("file", F.array_join("parts.text", "").alias("text"))
    texts = found.where(F.col("kind") == _ELEMENT).select("file", "text").unionByName(whole).where(F.col("text").startswith(_CUT))

    ends = found.where(F.col("kind") == _STATE).groupBy("file").agg(
        F.min("mark").alias("lowest"), F.sum("mark").alias("documents"), F.max_by("text", "split").alias("end")
    )
    reason = (
        F.when(F.col("end").startswith("1"), "ends inside a string").when(F.col("end") != "0 0", "brackets do not match")
        .when(F.col("lowest") < 0, "text outside the document").when(F.col("documents") != 1, "not one document")
    )
    bad = ends.select(F.col("file").alias("key"), reason.alias("reason")).where("reason is not null").join(files.select("key", "file"), "key").select("file", "reason")
    bad = bad.unionByName(empty_files(spark, path).select("file", F.lit("no bytes").alias("reason")))
    bad = stored(bad, "unreadable")
    parsed = F.from_json("text", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    named = texts.withColumnRenamed("file", "key").join(files, "key").select("file", "text").join(bad, "file", "left_anti")
    # The outer form keeps Catalyst from parsing an element again in the filter and for every field.
    judged = named.select("file", "text", F.explode_outer(F.array(parsed)).alias("_e"))
    fits = F.coalesce(F.col("_e").isNotNull() & F.col(f"_e.{CORRUPT}").isNull(), F.lit(False))
    elements = judged.where(fits).select("file", "_e.*").drop(CORRUPT)
    rejects = judged.where(~fits).select("file", F.col("text").alias("value"), F.lit("element does not fit the schema").alias("reason"))
    return elements, rejects.unionByName(bad.select("file", F.lit(None).cast("string").alias("value"), "reason"))
