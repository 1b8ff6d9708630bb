"""WARC archives with Zstandard dictionaries: a writer for tables of pages, and a reader.

Layout of a file: a skippable frame (magic 0x184D2A5D) with the dictionary,
compressed by itself; then each record in a Zstandard frame of its own that
uses the dictionary, so any record can be read by its offset.  The first record
is ``warcinfo``.  A task writes a file whenever it holds ``FILE_BYTES`` of
records.  The file's dictionary is trained on its own records, evenly spaced
ones of ``TRAIN_BYTES`` together at most, and takes ``DICTIONARY_BYTES`` or a
sixteenth of what it is trained on.  A file with too little to train on (below
``LEAST_TRAINING`` bytes) has no dictionary frame, which the format allows.

Of pages with equal payloads of ``REVISIT_BYTES`` bytes or more the one with the
largest id is a ``response``; the others are ``revisit`` records of it, with
their headers only.  Equality is told by length and SHA-256.  Copies of one
payload are brought together within tasks before they meet.

Files are named by attempt, and only those of committed tasks are in the index
that ``write`` returns: losing an executor, or running a task twice, leaves an
unlisted file and no wrong result.  Folders are URIs of the cluster's shared
storage, opened by pyarrow.

Edge cases: a null payload is empty; smaller payloads are all responses.  Rows
that share the largest id of their payload are all responses; rows that share
another id are all revisits.  A page without id is a revisit of one that has
an id; among pages without ids none is.  A null URL gives ``urn:page:`` and the
id; control characters, spaces and ``%`` in URLs and ids are percent-encoded.
Extra columns aren't read.  An empty table writes no file and reads as no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed_ids, written

REVISIT_BYTES = 1000
FILE_BYTES, TRAIN_BYTES, DICTIONARY_BYTES, LEAST_TRAINING = 32 << 20, 2 << 20, 110 << 10, 16 << 10
SAMPLE_BYTES = 8 << 10
LEVEL = 3
#: Fixed values of the format.
SKIPPABLE_MAGIC, DICTIONARY_MAGIC = 0x184D2A5D, 0xEC30A437
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "id string, path string, offset long, length long"
_PAGE = "id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"
#: Allowed as they are in header values; "%" isn't, so that decoding gives every value back.
_SAFE = "!#$&'()*+,/:;=?@[]~-._|\"<>{}^`\\"


def _uuid(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _head(lines: list[tuple[str, str | None]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None).encode()


def _coded(value: str) -> str:
    return quote(value, safe=_SAFE)


def record(page: str | None, url: str | None, payload: bytes, payload_sha1: bytes, target: str | None, date: str) -> bytes:
    """The record of a page; ``target`` is the id of the page that holds the payload, for a revisit."""
    digest = base64.b32encode(payload_sha1).decode()
    name = lambda p: _uuid(f"page:{p if p is not None else ''}:{digest}")
    http = b"HTTP/1.1 200 OK\r\n" + _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]) + b"\r\n"
    block = http + (payload if target is None else b"")
    coded = None if page is None else _coded(page)
    head = [
        ("WARC-Type", "response" if target is None else "revisit"), ("WARC-Record-ID", name(page)), ("WARC-Date", date),
        ("WARC-Target-URI", _coded(url) if url is not None else f"urn:page:{coded or ''}"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Page-ID", coded), ("Page-URL-Missing", "1" if url is None else None),
        ("WARC-Profile", REVISIT_PROFILE if target is not None else None), ("WARC-Refers-To", name(target) if target is not None else None), ("Refers-To-Page-ID", None if target is None else _coded(target)),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + _head(head) + b"\r\n" + block + b"\r\n\r\n"


def info_record(date: str) -> bytes:
    block = _head([("software", "tidemark"), ("format", "WARC File Format 1.1")])
    return b"WARC/1.1\r\n" + _head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _uuid("info")), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]) + b"\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Trained on pieces of records that are evenly spaced over all of them."""
    size = sum(map(len, records))
    step = max(1, -(-size // TRAIN_BYTES))
    samples = [r[a : a + SAMPLE_BYTES] for r in records[::step] for a in range(0, len(r), SAMPLE_BYTES)]
    used = sum(map(len, samples))
    if used < LEAST_TRAINING:
        return None
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, used // 16)), samples, level=LEVEL)
    except zstandard.ZstdError:  # the samples have nothing in common
        return None


def archive(records: list[bytes], date: str) -> Iterator[bytes]:
    """The frames of a file: the dictionary's, if there is one, the warcinfo record, then one for each record."""
    held = dictionary(records)
    if held is not None:
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(held.as_bytes())
        yield struct.pack("<II", SKIPPABLE_MAGIC, len(packed)) + packed
    else:
        yield b""
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=True)
    yield press.compress(info_record(date))
    for r in records:
        yield press.compress(r)


def _decompressor(file) -> zstandard.ZstdDecompressor:
    """For the records of an open file, which is left at the first one."""
    head = file.read(8)
    magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
    if magic != SKIPPABLE_MAGIC:
        file.seek(0)
        return zstandard.ZstdDecompressor()
    data = file.read(size)
    if struct.unpack("<I", data[:4])[0] != DICTIONARY_MAGIC:
        data = zstandard.ZstdDecompressor().decompress(data)
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))


def _fields(lines: Iterator[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        line = line.rstrip(b"\r\n")
        if not line:
            break
        k, _, v = line.decode().partition(":")
        out[k.lower()] = v.strip()
    return out


def parsed(stream: io.BufferedReader) -> Iterator[tuple]:
    """(id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of each page's record; digests are checked."""
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {first[:40]!r}")
        head = _fields(stream)
        block = stream.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record is cut short")
        if head["warc-type"] not in ("response", "revisit"):
            continue
        inner = io.BytesIO(block)
        inner.readline()
        http = _fields(inner)
        digest = base64.b32decode(head["warc-payload-digest"].partition(":")[2])
        payload = inner.read() if head["warc-type"] == "response" else None
        if payload is not None and hashlib.sha1(payload).digest() != digest:
            raise ValueError(f"payload of page {head.get('page-id')} differs from its digest")
        back = lambda k: unquote(head[k]) if k in head else None
        yield back("page-id"), None if "page-url-missing" in head else back("warc-target-uri"), head["warc-type"], int(http["content-length"]), digest.hex(), back("refers-to-page-id"), payload


def read_file(path: str) -> Iterator[tuple]:
    files, at = pafs.FileSystem.from_uri(path)
    with files.open_input_file(at) as f:
        unpress = _decompressor(f)
        with unpress.stream_reader(f, read_size=1 << 20, read_across_frames=True) as stream:
            yield from parsed(io.BufferedReader(stream, 1 << 20))


def read_record(path: str, offset: int, length: int) -> tuple:
    """One page's record, by its place in the index."""
    files, at = pafs.FileSystem.from_uri(path)
    with files.open_input_file(at) as f:
        unpress = _decompressor(f)
        f.seek(offset)
        return next(parsed(io.BufferedReader(io.BytesIO(unpress.decompress(f.read(length))))))


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(id, digest, target) of pages whose payload an other page holds. ``pages``: id, digest, size."""
    packs = packed_ids(pages.where(F.col("size") >= least).select("digest", "id"))
    held = packs.groupBy("key").agg(F.max(F.array_max("ids")).alias("target"), F.sum(F.size("ids")).alias("n")).where("n > 1 and target is not null").select("key", "target")
    met = packs.join(held, "key").select(F.explode("ids").alias("id"), F.col("key").alias("digest"), "target")
    return met.where("id is null or id <> target").distinct()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_BYTES, date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes archives of all pages below ``folder`` and returns their index: id (as text), path, offset, length."""
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    again = revisits(rows.select("id", "digest", F.length("payload").alias("size")), least)
    r, a = rows.alias("r"), again.alias("a")
    met = r.join(a, F.col("r.id").eqNullSafe(F.col("a.id")) & (F.col("r.digest") == F.col("a.digest")), "left")
    texts = met.select(F.col("r.id").cast("string").alias("id"), "r.url", "r.payload", F.col("a.target").cast("string").alias("target"))
    folder = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[str | None] = []
        held: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            path = f"{folder}/pages-{uuid.uuid4().hex}.warc.zst"
            files, at = pafs.FileSystem.from_uri(path)
            files.create_dir(at.rsplit("/", 1)[0], recursive=True)
            offsets, lengths, now = [], [], 0
            with files.open_output_stream(at, compression=None) as f:
                for k, frame in enumerate(archive(held, date)):
                    f.write(frame)
                    if k > 1:
                        offsets.append(now)
                        lengths.append(len(frame))
                    now += len(frame)
            made = pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([path] * len(ids), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["id", "path", "offset", "length"])
            ids.clear()
            held.clear()
            return made

        for b in batches:
            for k in range(b.num_rows):
                page, url, data, target = (b.column(c)[k].as_py() for c in range(4))
                ids.append(page)
                held.append(record(page, url, data, hashlib.sha1(data).digest(), target, date))
                size += len(held[-1])
                if size >= file_bytes:
                    yield out()
                    size = 0
        if held:
            yield out()

    return written(texts.mapInArrow(run, _INDEX), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """The pages of the files that an index names: id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    A file is read by one task, record after record; ``payload`` is null for revisits.
    """
    schema = pa.schema([("id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                rows: list[tuple] = []
                size = 0
                for row in read_file(path):
                    rows.append(row)
                    size += 200 + len(row[-1] or b"")
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)

    return index.groupBy("path").agg(F.count(F.lit(1)).alias("n")).select("path").mapInArrow(run, _PAGE)


def with_payloads(read_rows: DataFrame) -> DataFrame:
    """The rows of ``read`` with the payloads of revisits, taken from their responses."""
    held = read_rows.where("record_type = 'response' and id is not null").select(F.col("id").alias("refers_to"), "payload_digest", F.col("payload").alias("held")).dropDuplicates(["refers_to", "payload_digest"])
    return read_rows.join(held, ["refers_to", "payload_digest"], "left").withColumn("payload", F.coalesce("payload", "held")).select(*read_rows.columns)


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """All archives below a folder as an index for ``read``, where the writer's index isn't at hand."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(folder)
    return files.select("path")
