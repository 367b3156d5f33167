"""Write pages as WARC records and read archives back, sure of where records begin."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .rows import fields, open_folder, slices

_MAGIC = b"WARC/1.0\r\n"
# Fixed value: the profile that marks a record as a repeat of an equal payload.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"
# Most headers end within this much; for others more is read.
_AHEAD = 1 << 16
# The table of archives that a finished write leaves beside them.
_MANIFEST = "manifest"
_ARCHIVES = "file string, n_records long, size long"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit without."""
    header = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if url is not None:
        header.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~%")))
    if refers_to is not None:
        header += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", _PROFILE)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    header += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return _MAGIC + "".join(f"{k}: {v}\r\n" for k, v in header).encode() + b"\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, min_bytes: int = 100, max_bytes: int = 64 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) to archives below ``folder``, which all executors share.

    Of records with equal payloads of ``min_bytes`` at least, those with the smallest
    page id are responses and the others revisits of it. Only digests are grouped; a
    payload that a third of the pages have is counted before the shuffle and is joined
    back as one row. Each task writes archives of about ``max_bytes``, under names that
    no other attempt uses; the manifest beside them lists those of the attempts that
    Spark committed, and no others are read. Returns one row per archive: ``file``,
    ``n_records``, ``size``. A folder takes one write.

    A missing html is an empty payload. A row without a page id is a response only if
    no row with an id has its payload; repeated rows of the smallest id are all
    responses. An empty table gives no archive. A payload of any length is one record,
    and must fit in a task.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), F.sha2(payload, 256).alias("digest"))
    long_ = F.octet_length("html") >= min_bytes
    first = rows.where(long_).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = stored(first.where("n > 1 and first is not null").select(F.col("digest").alias("_digest"), "first"), "payloads")
    rows = rows.join(first, long_ & (F.col("digest") == F.col("_digest")), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.select(F.col("page_id").cast("long"), "url", "html", "digest", refers.cast("long").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        fs.create_dir(root, recursive=True)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        seq, size, n, out, name = 0, 0, 0, None, ""

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["file", "n_records", "size"])

        for whole in batches:
            for batch in slices(whole):
                for page, url, html, digest, refers_to in zip(*[c.to_pylist() for c in batch.columns]):
                    if out is None:
                        name = f"part-{part:06d}-{seq:04d}-{attempt}.warc"
                        out, size, n = fs.open_output_stream(f"{root}/{name}"), 0, 0
                    data = record(page, url, html.encode("utf-8", "replace"), digest, refers_to, date)
                    out.write(data)
                    size, n = size + len(data), n + 1
                    if size >= max_bytes:
                        yield close()
                        out, seq = None, seq + 1
        if out is not None:
            yield close()

    rows.mapInArrow(run, _ARCHIVES).write.parquet(f"{folder}/{_MANIFEST}")
    return archives(pages.sparkSession, folder)


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """The archives below ``folder``: those that the manifest of a finished write names, else all there are."""
    fs, root = open_folder(folder)
    if fs.get_file_info(f"{root}/{_MANIFEST}").type != FileType.NotFound:
        return spark.read.schema(_ARCHIVES).parquet(f"{folder}/{_MANIFEST}")
    if fs.get_file_info(root).type == FileType.NotFound:
        return spark.createDataFrame([], _ARCHIVES)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").load(folder)
    return listed.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.lit(None).cast("long").alias("n_records"), F.col("length").alias("size"))


def _header(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """The fields of the record header at a position, and where its block starts."""
    end = data.find(_END, at)
    if end < 0:
        return None
    found = {}
    for line in data[at + len(_MAGIC) : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        found[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    return found, end + 4


def _whole_header(f, data: bytes, first: int, at: int, size: int) -> bytes:
    """``data``, which stands at ``first`` in a file of ``size`` bytes, read on to where the header at a position ends."""
    if data.find(_END, at) >= 0:
        return data
    parts, n, tail = [data], len(data), data[-3:]
    while first + n < size:
        more = f.read_at(min(max(_AHEAD, n), size - first - n), first + n)
        parts.append(more)
        n += len(more)
        if _END in tail + more:
            break
        tail = (tail + more)[-3:]
    return b"".join(parts)


def candidates(splits: DataFrame, folder: str) -> DataFrame:
    """Every place in the splits that looks like a record, and where the next would start.

    ``splits`` are rows of file, size, split, start, end. Returns file, split, ``at``,
    ``next``, and ``leaves``: the first offset outside the split that following ``next``
    inside it comes to. A place that does not follow an empty line, whose header cannot
    be read, or whose record would go beyond the file or not end with an empty line, is
    none. A header may have any length. As each stands between two empty lines, none is
    read twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{root}/{row['file']}") as f:
                    start, end, size = row["start"], row["end"], row["size"]
                    first = max(0, start - len(_END))
                    data = f.read_at(min(size, end + _AHEAD) - first, first)
                    at, following = [], []
                    place = data.find(_MAGIC, start - first)
                    while 0 <= place < end - first:
                        header = None
                        if first + place == 0 or data[place - len(_END) : place] == _END:
                            data = _whole_header(f, data, first, place, size)
                            header = _header(data, place)
                        if header is not None and header[0].get("content-length", "").isdigit():
                            after = first + header[1] + int(header[0]["content-length"]) + 4
                            if after <= size:
                                inside = after - first <= len(data)
                                closing = data[after - 4 - first : after - first] if inside else f.read_at(4, after - 4)
                                if closing == _END:
                                    at.append(first + place)
                                    following.append(after)
                        place = data.find(_MAGIC, place + 1)
                leaves = dict(zip(at, following))
                for a in reversed(at):
                    leaves[a] = leaves.get(leaves[a], leaves[a])
                columns = [pa.array([row["file"]] * len(at), pa.string()), pa.array([row["split"]] * len(at), pa.int64())]
                columns += [pa.array(x, pa.int64()) for x in (at, following, [leaves[a] for a in at])]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "split", "at", "next", "leaves"])

    return splits.mapInArrow(run, "file string, split long, at long, next long, leaves long")


def entries(found: DataFrame) -> DataFrame:
    """Of the candidates, those at which the chain of records from the file's start enters a split.

    Pointer jumping: in each round, what is reached grows by where its pointers lead,
    and every pointer is replaced by the pointer of where it leads. Rounds grow with the
    logarithm of the splits per file. Each is written to the shared folder.
    """
    jumps = nodes = stored(found.select("file", "at", "leaves"), "jumps")
    reached = stored(jumps.where("at = 0").select("file", "at"), "reached")
    n = -1
    while (count := reached.count()) != n:
        n = count
        led = reached.join(jumps, ["file", "at"]).select("file", F.col("leaves").alias("at"))
        # What points beyond the end of the file has no pointer any more, but is a node.
        led = led.join(nodes.select("file", "at"), ["file", "at"], "left_semi")
        reached = stored(reached.unionByName(led).distinct(), "reached")
        onward = jumps.select("file", F.col("at").alias("leaves"), F.col("leaves").alias("then"))
        jumps = stored(jumps.join(onward, ["file", "leaves"]).select("file", "at", F.col("then").alias("leaves")), "jumps")
    return reached


def read(spark: SparkSession, folder: str, split_bytes: int = 4 << 20) -> DataFrame:
    """The records of all archives below ``folder``.

    Files are read in splits. Tasks find what looks like records, also inside payloads;
    only what the chain of records from a file's start reaches is one. Returns file,
    ``at``, ``record_type``, ``page_id``, ``url``, ``payload`` (of responses),
    ``payload_bytes``, ``payload_digest`` (of the payload read, or as recorded for a
    revisit), ``intact`` (whether it is the recorded one) and ``refers_to``. What stands
    after a broken record in a file cannot be reached and is left out. Of a folder that
    :func:`write` filled only archives in its manifest are read.
    """
    files = archives(spark, folder).where("size > 0").select("file", "size")
    split = F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / split_bytes)))
    splits = files.withColumn("split", split).withColumn("start", F.col("split") * split_bytes)
    splits = splits.withColumn("end", F.least("size", F.col("start") + split_bytes))
    splits = splits.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "split")
    found = stored(candidates(splits, folder), "candidates")
    entered = entries(found).withColumn("entered", F.lit(True))
    marked = found.join(entered, ["file", "at"], "left")
    schema = fields(
        "file string, at long, record_type string, page_id long, url string, payload binary, payload_bytes long,"
        " payload_digest string, intact boolean, refers_to long"
    )

    def page(urn: str | None) -> int | None:
        number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number.lstrip("-").isdigit() else None

    def records(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        following = dict(zip(pdf["at"].tolist(), pdf["next"].tolist()))
        chain = []
        for at in sorted(pdf.loc[pdf["entered"].notna(), "at"].tolist()):
            while at in following:
                chain.append(at)
                at = following.pop(at)
        chain.sort()
        out = []
        if chain:
            fs, root = open_folder(folder)
            with fs.open_input_file(f"{root}/{key[0]}") as f:
                ends = dict(zip(pdf["at"].tolist(), pdf["next"].tolist()))
                for at in chain:
                    data = f.read_at(ends[at] - at, at)
                    header, block = _header(data, 0)
                    body = data[block:-4]
                    http, _, payload = body.partition(b"\r\n\r\n")
                    recorded = header.get("warc-payload-digest", "").removeprefix("sha256:")
                    if header.get("warc-type") == "revisit":
                        lengths = [x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                        values = ["revisit", None, int(lengths[0]) if lengths else None, recorded, True, page(header.get("warc-refers-to"))]
                    else:
                        digest = hashlib.sha256(payload).hexdigest()
                        values = [header.get("warc-type"), payload, len(payload), digest, digest == recorded, None]
                    out.append([key[0], at, values[0], page(header.get("warc-record-id")), header.get("warc-target-uri"), *values[1:]])
        frame = pd.DataFrame(out, columns=schema.fieldNames())
        for c in ("page_id", "payload_bytes", "refers_to"):
            frame[c] = pd.array(frame[c].tolist(), dtype="Int64")
        return frame

    return marked.groupBy("file", "split").applyInPandas(records, schema)
