"""Web archives in Zstandard frames (operator 9): a dictionary in the leading skippable frame, one frame per record."""
from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierflow.llm.shared import file_system, filled, scratch, stored

#: Fixed values of the formats: the magic number of the frame that holds a dictionary, and that of any frame.
DICTIONARY_FRAME, FRAME = 0x184D2A5D, 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes of a file, and bytes of records that its dictionary is trained on.
FILE_BYTES, TRAIN_BYTES, DICTIONARY_BYTES = 16 << 20, 1 << 20, 32 << 10
#: Smaller payloads are never revisits.
REVISIT_FROM = 1000
#: Archives that one task reads back, about.
TASK_FILES = 4


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, original: int | None, date: str) -> bytes:
    """One record; a revisit (``original`` given) carries the HTTP header alone, whose length is that of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if original is not None else http + payload
    safe = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    head = {"WARC-Type": "response" if original is None else "revisit", "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
            "WARC-Date": date, "WARC-Target-URI": safe or None, "WARC-Payload-Digest": f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
            "WARC-Refers-To": None if original is None else f"<urn:page:{original}>", "WARC-Profile": None if original is None else REVISIT_PROFILE,
            "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on records spread over the file, up to ``TRAIN_BYTES`` of them; where there are too few, the plain bytes of one."""
    step, sample, size = max(1, len(records) // 256), [], 0
    for r in records[::step]:
        if size + len(r) <= TRAIN_BYTES:
            sample.append(r)
            size += len(r)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=256, d=8) if len(sample) >= 16 else plain_dictionary(records)
    except zstandard.ZstdError:
        return plain_dictionary(records)


def plain_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(records[0][:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def to_archive(records: list[bytes]) -> bytes:
    shared = dictionary(records)
    held = zstandard.ZstdCompressor(level=3).compress(shared.as_bytes())
    packer = zstandard.ZstdCompressor(level=3, dict_data=shared, write_content_size=True, write_checksum=True)
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(held)), held, *map(packer.compress, records)])


def from_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive. The dictionary may stand in its frame as it is or compressed; other skippable frames are passed over."""
    def magic(at: int) -> int:
        return struct.unpack_from("<I", data, at)[0] if len(data) >= at + 4 else -1

    at, unpacker = 0, zstandard.ZstdDecompressor()
    if magic(0) == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        held, at = data[8:8 + size], 8 + size
        if len(held) != size:
            raise ValueError("dictionary frame is cut short")
        plain = zstandard.ZstdDecompressor().decompress(held) if held[:4] == struct.pack("<I", FRAME) else held
        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(plain))
    view = memoryview(data)
    while at < len(data):
        if 0x184D2A50 <= magic(at) <= 0x184D2A5F:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        frame, out = unpacker.decompressobj(), []
        while not frame.eof:
            if at >= len(data):
                raise ValueError("last frame is cut short")
            chunk = view[at:at + 16384]
            out.append(frame.decompress(chunk))
            at += len(chunk) - (len(frame.unused_data) if frame.eof else 0)
        yield b"".join(out)


def fields(data: bytes, first: str) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and what follows the blank line."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    start, *lines = head.decode("utf-8").split("\r\n")
    if not gap or not start.startswith(first):
        raise ValueError(f"no {first} header")
    named = dict(line.split(": ", 1) for line in lines)
    return {k.lower(): v for k, v in named.items()}, rest


def parsed(data: bytes) -> dict:
    """One record, checked: version, needed fields, both lengths, the end mark, and the digest of a response's payload."""
    head, rest = fields(data, "WARC/1.")
    kind, length = head["warc-type"], int(head["content-length"])
    if kind not in ("response", "revisit") or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"{head['warc-record-id']}: type or length is wrong")
    http, payload = fields(rest[:length], "HTTP/1.")
    n, digest = int(http["content-length"]), base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest) or kind == "revisit" and payload:
        raise ValueError(f"{head['warc-record-id']}: payload and header differ")
    number = lambda v: int(v) if (v := v.removeprefix("<urn:page:").rstrip(">")) else None
    return {"page_id": number(head["warc-record-id"]), "url": head.get("warc-target-uri"), "payload": payload if kind == "response" else None,
            "payload_bytes": n, "payload_digest": digest, "record_type": kind,
            "refers_to": number(head["warc-refers-to"]) if kind == "revisit" else None}


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   date: str = "2024-01-01T00:00:00Z", revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Archives of all pages below ``folder``; returns the stored manifest ``file, n_records``.

    Of equal payloads of at least ``revisit_from`` bytes the one with the largest id is the response, the others revisit it. Rows
    that share this largest id are all responses, as are all of a group without any id. A null html is an empty payload; a null or
    empty url gives a record without target. Ids are whole numbers of 64 bits; a text id that is no number stops the job. Payloads of any
    length are one record; an empty table gives an empty manifest; further columns are left out whatever their names. Each attempt of a task names its own files and only those in the manifest count. A task
    holds one file's records."""
    payload = filled(html)
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), payload.alias("p"), F.sha1(payload.cast("binary")).alias("digest"))
    large = F.octet_length("p") >= revisit_from
    # small payloads get keys that meet nothing, and are spread by their ids
    rows = rows.withColumn("k", F.when(large, F.sha2("p", 256)).otherwise(F.concat(F.lit("-"), F.xxhash64("id", "url").cast("string"))))
    groups = (rows.where(large).groupBy("k").agg(F.max("id").alias("largest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    marked = (rows.join(groups, "k", "left")
              .select("id", "url", F.col("p").cast("binary").alias("p"), "digest",
                      F.when(F.coalesce(F.col("id") != F.col("largest"), F.col("largest").isNotNull()), F.col("largest")).alias("original")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, size, part = [], 0, TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            fs, root = file_system(folder)
            name = f"pages-{part:06d}-{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(to_archive(records))
            return pa.RecordBatch.from_pydict({"file": [name], "n_records": pa.array([len(records)], pa.int64())})

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                records.append(record(*row, date))
                size += len(records[-1])
                if size >= FILE_BYTES:
                    yield flush()
                    records, size = [], 0
        if records:
            yield flush()

    file_system(folder)[0].create_dir(file_system(folder)[1], recursive=True)
    return stored(marked.mapInArrow(write, "file string, n_records long"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Records of the manifest's archives: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` and the ``payload``
    of responses. A record whose header or length is wrong stops the read. A task reads about ``TASK_FILES`` archives."""
    types = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(),
             "refers_to": pa.int64()} | ({"payload": pa.binary()} if with_payload else {})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}") as f:
                    data = f.read()
                rows, size = [], 0
                for raw in from_archive(data):
                    rows.append(parsed(raw))
                    size += len(raw) if with_payload else 256
                    if size > 8 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in types.items()], names=list(types))

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    parts = -(-max(1, manifest.count()) // TASK_FILES)
    return manifest.select("file").repartition(parts, "file").mapInArrow(read, schema + (", payload binary" if with_payload else ""))


def archive_round_trip(pages: DataFrame, with_payload: bool = False) -> DataFrame:
    folder = scratch(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder, with_payload)
