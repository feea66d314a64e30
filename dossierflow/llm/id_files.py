"""Token ids in word-aligned files (operator 8): Simple-8b words in blocks that decode on their own.

A file is: magic, counts of documents, blocks, ids and words; the documents' ids and lengths; the blocks' first words and numbers
of escapes; the words. In a word the upper 4 bits are a selector: how many ids the lower 60 bits hold and how wide each is. An id of
more than 60 bits takes a word of the escape selector, which points to a raw word at the end of the block.
"""
from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossierflow.llm import tokens
from dossierflow.llm.shared import before_parts, file_system, filled, scratch, stored

MAGIC = b"S8BIDS01"
HEAD = struct.Struct("<8sQQQQ")
#: Ids in a word by selector; the widths follow as 60 // count.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15
#: Ids of a block, and ids of a file before the next one begins (a document is never split).
BLOCK_IDS, FILE_IDS = 1 << 14, 1 << 22
#: Words that a worker keeps, and characters of texts that it cuts at once.
KEPT_WORDS, TEXT_BLOCK = 800_000, 1 << 23
#: Files that one task reads back, about.
TASK_FILES = 4
IN_WORD = np.array([*COUNTS, 0, 1], np.int64)


def widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, at least 1: the exponent of its upper 32 bits, or else of its lower ones, which a double holds exactly."""
    upper = ids >> np.uint64(32)
    bits = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(float))[1]
    if upper.any():
        bits = np.where(upper > 0, 32 + np.frexp(upper.astype(float))[1], bits)
    return np.maximum(bits, 1).astype(np.uint8)


def pack_block(ids: np.ndarray) -> tuple[np.ndarray, int]:
    """The words of one block (raw words of escapes last) and the number of escapes."""
    n = len(ids)
    bits = np.full(n + COUNTS[0], 255, np.uint8)
    bits[:n] = widths(ids)
    best = np.ones(n, np.uint8)
    widest, power = bits, 1
    for count in reversed(COUNTS[:-1]):
        while 2 * power <= count:
            widest, power = np.maximum(widest[:-power], widest[power:]), 2 * power
        fits = np.maximum(widest[:n], widest[count - power:count - power + n]) <= 60 // count
        if not fits.any():
            break
        best[fits] = count
    at, starts, step = 0, [], best.tolist()
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts, np.int64)
    taken = best[starts]
    words = np.zeros(len(starts), np.uint64)
    for selector, count in enumerate(COUNTS):
        own = np.flatnonzero(taken == count)
        if len(own):
            value = np.full(len(own), selector << 60, np.uint64)
            for j in range(count):
                value |= ids[starts[own] + j] << np.uint64(j * (60 // count))
            words[own] = value
    large = np.flatnonzero((taken == 1) & (bits[starts] > 60))
    words[large] = np.uint64(ESCAPE << 60) | np.arange(len(large), dtype=np.uint64)
    return np.concatenate([words, ids[starts[large]]]), len(large)


def unpack_block(words: np.ndarray, escapes: int) -> np.ndarray:
    """The ids of a block, one vectorised pass per selector."""
    body, raw = words[:len(words) - escapes], words[len(words) - escapes:]
    selector = (body >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(IN_WORD[selector])
    starts = ends - IN_WORD[selector]
    out = np.empty(ends[-1] if len(ends) else 0, np.uint64)
    for s, count in enumerate(COUNTS):
        own = np.flatnonzero(selector == s)
        if len(own):
            width = 60 // count
            mask = np.uint64((1 << width) - 1)
            for j in range(count):
                out[starts[own] + j] = (body[own] >> np.uint64(j * width)) & mask
    own = np.flatnonzero(selector == ESCAPE)
    out[starts[own]] = raw[(body[own] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


def to_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    blocks, words, at = [], [], 0
    for i in range(0, len(ids), BLOCK_IDS):
        packed, escapes = pack_block(ids[i:i + BLOCK_IDS])
        blocks.append((at, escapes))
        words.append(packed)
        at += len(packed)
    return b"".join([HEAD.pack(MAGIC, len(doc_ids), len(blocks), len(ids), at), bytes(d is None for d in doc_ids),
                     np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(lengths, "<i8").tobytes(),
                     np.array(blocks, "<i8").tobytes(), *(w.astype("<u8").tobytes() for w in words)])


def from_file(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """Documents of a file in their order, with their ids. Raises if the file is cut short or not of this format."""
    magic, n_docs, n_blocks, n_ids, n_words = HEAD.unpack_from(data)
    if magic != MAGIC or len(data) != HEAD.size + 17 * n_docs + 16 * n_blocks + 8 * n_words:
        raise ValueError("not a whole id file")
    at = HEAD.size
    empty = data[at:at + n_docs]
    doc_ids, lengths = np.frombuffer(data, "<i8", 2 * n_docs, at + n_docs).reshape(2, -1)
    blocks = np.frombuffer(data, "<i8", 2 * n_blocks, at + 17 * n_docs).reshape(-1, 2)
    words = np.frombuffer(data, "<u8", n_words, at + 17 * n_docs + 16 * n_blocks)
    if lengths.sum() != n_ids:
        raise ValueError("lengths of documents do not add up")
    kept, block = np.zeros(0, np.uint64), 0
    for k in range(n_docs):
        parts, have = [kept], len(kept)
        while have < lengths[k]:
            first, escapes = blocks[block]
            last = blocks[block + 1][0] if block + 1 < n_blocks else n_words
            parts.append(unpack_block(words[first:last], int(escapes)))
            have += len(parts[-1])
            block += 1
        joined = np.concatenate(parts) if len(parts) > 1 else kept
        kept = joined[lengths[k]:]
        yield (None if empty[k] else int(doc_ids[k])), joined[:lengths[k]]


def write_id_files(docs: DataFrame, tokenizer: str, folder: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0,
                   file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every text, add ``end_id`` and write the ids into files below ``folder``, in ascending order of id over parts and files.

    Returns the stored manifest, one row per file: ``part, seq, file, n_docs, n_ids``. A file gets a name of its own for each attempt,
    and only files in the manifest count, so a task that runs again does no harm. A task holds the ids of one file.

    Ids are whole numbers of 64 bits, as the format holds them; a text id that is no number stops the job. A null text is empty (only
    ``end_id``), null ids come first, rows of the same id follow each other by the first 64 characters of the text, then by its hash, an empty table gives an empty manifest,
    texts of any length are one document, and further columns are left out whatever their names."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, seq = tokens.id_table(tokenizer, KEPT_WORDS, TEXT_BLOCK), TaskContext.get().partitionId(), 0
        ids_of, lengths, ids, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            fs, root = file_system(folder)
            name = f"part-{part:06d}-{seq:05d}-{uuid.uuid4().hex}.s8b"
            flat = np.concatenate(ids).astype(np.uint64)
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(to_file(ids_of, lengths, flat))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "seq": pa.array([seq], pa.int64()), "file": [name],
                                               "n_docs": pa.array([len(ids_of)], pa.int64()), "n_ids": pa.array([len(flat)], pa.int64())})

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for flat, sizes in table.texts(batch.column(1).to_pylist()):
                own, keys, sizes = keys[:len(sizes)], keys[len(sizes):], sizes + 1
                ends = np.cumsum(sizes)
                flat, at = np.insert(flat, ends - np.arange(1, len(ends) + 1), end_id), 0
                while at < len(own):  # up to the document that fills the file
                    done = ends[at - 1] if at else 0
                    to = min(len(own), int(np.searchsorted(ends, done + file_ids - held)) + 1)
                    ids_of += own[at:to]
                    lengths += sizes[at:to].tolist()
                    ids.append(flat[done:ends[to - 1]])
                    held, at = held + len(ids[-1]), to
                    if held >= file_ids:
                        yield flush()
                        ids_of, lengths, ids, held, seq = [], [], [], 0, seq + 1
        if ids_of:
            yield flush()

    file_system(folder)[0].create_dir(file_system(folder)[1], recursive=True)
    rows = docs.select(F.col(doc_id).cast("long").alias("k"), filled(text).alias("t"))
    order = ["k", F.left("t", F.lit(64)), F.xxhash64("t")]  # the text spreads the rows of one id
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "t")
    return stored(ordered.mapInArrow(write, "part long, seq long, file string, n_docs long, n_ids long"), "id-manifest")


def read_id_files(manifest: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """Documents back from the files: ``doc_id, start`` (ids of all documents before it)``, n_tokens, ids_crc32`` and the ``ids``. A task
    reads about ``TASK_FILES`` files."""
    totals = manifest.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    inside = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = (manifest.withColumn("inside", inside).join(before_parts(totals, [], "part", "n_ids"), "part")
              .select("file", (F.col("inside") + F.col("before")).alias("first")))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int64()))] if with_ids else []

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for name, first in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_input_stream(f"{root}/{name}") as f:
                    data = f.read()
                rows, size = [], 0
                for key, ids in from_file(data):
                    rows.append((key, first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) + ((ids.astype(np.int64),) if with_ids else ()))
                    first, size = first + len(ids), size + len(ids)
                    if size > BLOCK_IDS * 64:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return placed.repartition(-(-max(1, manifest.count()) // TASK_FILES), "file").mapInArrow(read, schema)


def id_file_round_trip(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """Write all documents to a new folder below the shared one and read them back."""
    folder = scratch(docs.sparkSession, "ids")
    return read_id_files(write_id_files(docs, tokenizer, folder), folder, with_ids)
