"""WARC archives in seekable Zstandard bundles: independent frames, a footer seek table, and an index of record places."""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidence.llm.common import materialize, shared_dir

#: Fixed values of the seekable format: magic numbers of the skippable frame and of the footer.
SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
INDEX = "_key {kind}, record_id string, bundle string, frame int, offset long, length long"
#: Rows whose payloads are Python objects at a time.
SLICE = 256
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "page")


def record_id(key) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(key))}>"


def warc_record(key, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record: a response with its payload, or a revisit of `refers_to` without."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:page:" + str(key))
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Key: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of a record; names in lower case."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = lambda lines: {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode().split("\r\n")[1:])}
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    if not head.startswith(b"WARC/1.1") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


class BundleWriter:
    """A bundle in the shared folder under a name of its own; it appears there whole or not at all."""

    def __init__(self, folder: str, level: int):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.files, self.at = fs.FileSystem.from_uri(self.path)
        self.files.create_dir(self.at.rpartition("/")[0])
        self.out = self.files.open_output_stream(self.at + ".part", compression=None)
        self.zstd, self.sizes, self.frame, self.places, self.written = zstandard.ZstdCompressor(level=level), [], bytearray(), [], 0

    def add(self, key, record: bytes) -> None:
        self.places.append((key, record_id(key), self.path, len(self.sizes), len(self.frame), len(record)))
        self.frame += record

    def end_frame(self) -> None:
        if self.frame:
            packed = self.zstd.compress(bytes(self.frame))
            self.out.write(packed)
            self.sizes.append((len(packed), len(self.frame)))
            self.written, self.frame = self.written + len(packed), bytearray()

    def close(self) -> list[tuple]:
        self.end_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, FOOTER)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        self.files.move(self.at + ".part", self.at)
        return self.places


class BundleReader:
    """Frames of a bundle by number, found through the footer."""

    def __init__(self, path: str):
        files, at = fs.FileSystem.from_uri(path)
        self.file = files.open_input_file(at)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        table = self.file.read_at(8 * n + 17, size - 8 * n - 17)
        if magic != FOOTER or struct.unpack("<II", table[:8]) != (SKIPPABLE, 8 * n + 9):
            raise ValueError("no seek table")
        self.frames, start = [], 0
        for packed, full in struct.iter_unpack("<II", table[8 : 8 + 8 * n]):
            self.frames.append((start, packed, full))
            start += packed
        self.zstd, self.held = zstandard.ZstdDecompressor(), (-1, b"")

    def frame(self, number: int) -> bytes:
        if self.held[0] != number:
            start, packed, full = self.frames[number]
            self.held = number, self.zstd.decompress(self.file.read_at(packed, start), max_output_size=full)
        return self.held[1]


def write_archives(
    df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 100, frame_bytes: int = 1 << 20, bundle_bytes: int = 64 << 20, level: int = 3, date: str = "2025-01-01T00:00:00Z"
) -> DataFrame:
    """The index: key, record_id, bundle, frame, offset and length in the frame, a row per row of `df`.

    Of equal payloads of at least `min_bytes` the one with the smallest key is a response and the others revisit it;
    rows with that key (repeated ones) are responses all. A null payload is empty; a null key comes after all others.
    The index is written by Spark's commit, so bundles of tasks that failed are in no index and are never read.
    """
    folder = f"{shared_dir(df.sparkSession)}/warc-{uuid.uuid4().hex}"
    body = F.coalesce(df[payload], F.lit(""))
    rows = df.select(df[key].alias("_key"), df[url].alias("_url"), body.alias("_payload"), F.sha2(body, 256).alias("_digest"), (F.octet_length(body) >= min_bytes).alias("_large"))
    first = rows.where("_large").groupBy("_digest").agg(F.min("_key").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_digest", "_first")
    later = F.col("_first").isNotNull() & F.coalesce(F.col("_key") > F.col("_first"), F.lit(True))
    rows = rows.join(first, "_digest", "left").select("_key", "_url", "_payload", "_digest", F.when(later, F.col("_first").cast("string")).alias("_refers"))

    kind = dict(rows.dtypes)["_key"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, keys = None, None
        names = ["_key", "record_id", "bundle", "frame", "offset", "length"]

        def index() -> pa.RecordBatch:
            places = [pa.array(c, t) for c, t in zip(zip(*bundle.close(), strict=True), (keys, pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
            return pa.RecordBatch.from_arrays(places, names)

        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            keys = batch["_key"].type
            for at, link, text, digest, refers in zip(*(batch[c].to_pylist() for c in ("_key", "_url", "_payload", "_digest", "_refers")), strict=True):
                bundle = bundle or BundleWriter(folder, level)
                bundle.add(at, warc_record(at, link, text.encode(), digest, refers, date))
                if len(bundle.frame) >= frame_bytes:
                    bundle.end_frame()
                    if bundle.written >= bundle_bytes:
                        yield index()
                        bundle = None
        if bundle:
            yield index()

    return materialize(rows.mapInArrow(write, INDEX.format(kind=kind)), "warc-index").withColumnRenamed("_key", key)


def read_archives(index: DataFrame, key: str = "page_id", with_payload: bool = False) -> DataFrame:
    """key, record_id, payload_bytes, payload_digest, record_type, refers_to (and payload) of the records in `index`.

    Any part of an index will do: a frame is opened only if a wanted record lies in it. Payloads are checked against
    the digests in their headers. A revisit has the length and digest of the payload that it stands for.
    """
    kind = dict(index.dtypes)[key]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, bundle = "", None
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            found = {"payload_bytes": [], "payload_digest": [], "record_type": [], "refers_to": [], "payload": []}
            for wanted, number, at, length, name in zip(*(batch[c].to_pylist() for c in ("bundle", "frame", "offset", "length", "record_id")), strict=True):
                if wanted != path:
                    path, bundle = wanted, BundleReader(wanted)
                warc, http, payload = parse_record(bundle.frame(number)[at : at + length])
                digest, revisit = warc["warc-payload-digest"].removeprefix("sha256:"), warc["warc-type"] == "revisit"
                if warc["warc-record-id"] != name or not revisit and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{name} isn't what the index says")
                row = (int(http["content-length"]), digest, warc["warc-type"], warc.get("x-refers-to-key"), None if revisit or not with_payload else payload)
                for column, value in zip(found.values(), row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
            out = {"_key": batch["_key"], "record_id": batch["record_id"]} | {c: pa.array(v, t) for (c, v), t in zip(found.items(), kinds, strict=True) if with_payload or c != "payload"}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    rows = index.withColumnRenamed(key, "_key").repartition("bundle").sortWithinPartitions("bundle", "frame", "offset")
    schema = f"_key {kind}, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * with_payload
    out = rows.mapInArrow(read, schema)
    return out.select(F.col("_key").alias(key), "record_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), *["payload"] * with_payload)
