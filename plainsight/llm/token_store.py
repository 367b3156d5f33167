"""Token ids in binary shards, each document compressed by itself with a shared dictionary."""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .rows import fields, open_folder, slices
from .tokens import default_path, encoder

# A shard is: frames; document ids (int64), whether each is present (uint8), ids per
# document (uint64), frame ends (uint64); then this trailer: where the index starts,
# documents, bytes per id, SHA-256 of the dictionary, magic.
_TRAILER = "<QQI32s8s"
_TRAILER_SIZE = struct.calcsize(_TRAILER)
_MAGIC = b"PSTOKS01"
_MANIFEST = "part int, seq int, n_docs long, n_ids long, first_id long, last_id long, file string"


def train_dictionary(docs: DataFrame, path: str, size: int = 65536, max_docs: int = 1000, max_chars: int = 65536, width: int = 2) -> bytes:
    """A zstandard dictionary from the serialized ids of a bounded sample of documents.

    The sample is the ``max_docs`` ids with the lowest hashes, without texts of more
    than ``max_chars``: the dictionary is for short ones. Where they are too few to
    train on, their ids themselves are the dictionary, or there is none.
    """
    chosen = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi").where(F.char_length("text") <= max_chars)
    texts = [r[0] for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").select("text").limit(max_docs).collect()]
    samples = [np.frombuffer(x, "<u4").astype(f"<u{width}").tobytes() for x in encoder(path).encode(pa.array(texts, pa.string()))]
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2, level: int = 3, max_bytes: int = 16 << 20) -> DataFrame:
    """Write the ids of ``docs`` in ascending order of ``doc_id`` below ``folder``, which all executors share.

    Texts, not ids, are shuffled: a range partition by id is sorted, encoded and written
    by one task, as shards of about ``max_bytes``. A shard is written under a name of its
    own and then moved, so a repeated task leaves the same files. Each document is one
    zstandard frame of its ids and ``end_id``. The dictionary is in ``folder`` too, and
    its hash in each shard. Returns the manifest, one row per shard, which is also kept
    in ``folder``: part, seq, n_docs, n_ids, first and last id, file.

    A missing text is empty: the end id alone. Rows without an id come first; rows with
    one id stand together, ordered by text. An empty table gives no shard.
    """
    path, spark = path or default_path(), docs.sparkSession
    width = 2 if encoder(path).tokenizer.get_vocab_size() <= 1 << 16 else 4
    dictionary = train_dictionary(docs, path, width=width)
    fs, root = open_folder(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary") as out:
        out.write(dictionary)
    digest = hashlib.sha256(dictionary).digest()
    schema = fields(_MANIFEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        encode, part = encoder(path).encode, TaskContext.get().partitionId()
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compress = zstandard.ZstdCompressor(level=level, dict_data=shared).compress
        end, seq = np.array([end_id], f"<u{width}").tobytes(), 0
        frames: list[bytes] = []
        ids: list[int | None] = []
        counts: list[int] = []

        def shard() -> pa.RecordBatch:
            name = f"part-{part:06d}-{seq:04d}.tok"
            body = b"".join(frames)
            index = [
                np.array([i or 0 for i in ids], "<i8"), np.array([i is not None for i in ids], np.uint8),
                np.array(counts, "<u8"), np.cumsum([len(f) for f in frames]).astype("<u8"),
            ]
            temporary = f"{root}/_{name}-{uuid.uuid4().hex}"
            with fs.open_output_stream(temporary) as out:
                out.write(body)
                for column in index:
                    out.write(column.tobytes())
                out.write(struct.pack(_TRAILER, len(body), len(ids), width, digest, _MAGIC))
            fs.move(temporary, f"{root}/{name}")
            row = [part, seq, len(ids), sum(counts), ids[0], ids[-1], name]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=schema.fieldNames())

        size = 0
        for whole in batches:
            for batch in slices(whole):
                for doc, data in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                    data = (np.frombuffer(data, "<u4").astype(f"<u{width}").tobytes() if width == 2 else data) + end
                    frames.append(compress(data))
                    ids.append(doc)
                    counts.append(len(data) // width)
                    size += len(frames[-1])
                    if size >= max_bytes:
                        yield shard()
                        frames, ids, counts, size, seq = [], [], [], 0, seq + 1
        if ids:
            yield shard()
        encoder(path).rest()

    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, schema).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per shard, with ``start``: the ids in all shards before it."""
    shards = spark.read.schema(fields(_MANIFEST)).parquet(f"{folder}/manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


class Shard:
    """Random access to the documents of one shard."""

    def __init__(self, fs, path: str, dictionary: bytes):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        index, n, self.width, digest, magic = struct.unpack(_TRAILER, self.file.read_at(_TRAILER_SIZE, size - _TRAILER_SIZE))
        if magic != _MAGIC:
            raise ValueError(f"{path} is no token shard")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        data = self.file.read_at(25 * n, index)
        at = lambda start, kind: np.frombuffer(data, kind, n, start * n)
        self.ids, self.present, self.counts, ends = at(0, "<i8"), at(8, np.uint8), at(9, "<u8").astype(np.int64), at(17, "<u8")
        self.ends = np.concatenate([[0], ends]).astype(np.int64)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.decompress = zstandard.ZstdDecompressor(dict_data=shared).decompress

    def read(self, a: int, b: int) -> list[bytes]:
        """The ids of documents ``a`` to ``b`` as little-endian unsigned 32-bit numbers."""
        low = self.ends[a]
        data = self.file.read_at(int(self.ends[b] - low), int(low))
        frames = [self.decompress(data[x - low : y - low]) for x, y in zip(self.ends[a:b], self.ends[a + 1 : b + 1])]
        return [np.frombuffer(f, f"<u{self.width}").astype("<u4").tobytes() for f in frames]


def _dictionary(fs, root: str) -> bytes:
    with fs.open_input_stream(f"{root}/dictionary") as f:
        return f.read()


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """All documents of ``folder``: doc_id, ``start``, ``n_tokens``, ``ids_crc32`` and ``ids`` (32-bit, little-endian)."""
    schema = fields("doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    schema = schema if with_ids else StructType(schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        dictionary = _dictionary(fs, root)
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(fs, f"{root}/{row['file']}", dictionary)
                starts = row["start"] + np.cumsum(shard.counts) - shard.counts
                for a in range(0, len(shard.ids), 1000):
                    b = min(a + 1000, len(shard.ids))
                    ids = shard.read(a, b)
                    columns = [
                        pa.array(shard.ids[a:b], mask=shard.present[a:b] == 0), pa.array(starts[a:b]), pa.array(shard.counts[a:b]),
                        pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names=schema.fieldNames())

    shards = manifest(spark, folder).select("file", "start")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return shards.repartition(n).mapInArrow(run, schema)


def fetch(spark: SparkSession, folder: str, doc_ids: Sequence[int]) -> DataFrame:
    """The documents with these ids (``doc_id``, ``ids``): reads the index of shards that may hold them, and their frames."""
    wanted = np.unique(np.array(list(doc_ids), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        dictionary = _dictionary(fs, root)
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(fs, f"{root}/{row['file']}", dictionary)
                at = np.flatnonzero(np.isin(shard.ids, wanted) & (shard.present == 1))
                ids = [shard.read(i, i + 1)[0] for i in at]
                yield pa.RecordBatch.from_arrays([pa.array(shard.ids[at]), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    shards = manifest(spark, folder)
    if len(wanted):
        shards = shards.where((F.col("last_id") >= int(wanted[0])) & (F.coalesce("first_id", F.lit(-(1 << 63))) <= int(wanted[-1])))
    else:
        shards = shards.limit(0)
    return shards.select("file").repartition("file").mapInArrow(run, "doc_id long, ids binary")
