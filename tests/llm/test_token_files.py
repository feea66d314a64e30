"""Operators 2, 3 and 8 against the tokenizers library, and the words of the id files."""
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from dossierflow.llm import id_files, packing, token_counts, tokens
from tests.llm.rows import TEXTS, by_id

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


@pytest.fixture(scope="module")
def given(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_pieces_meet_the_library_on_any_mix():
    rng, parts = random.Random(1), ["a", "b", " ", " ", "\n", "\n", "\t", "'s", "é", "1", "#", "<|endoftext|>", "　", "\x1c", "\x85", "word", "..", "你"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(20000)]
    table = tokens.PieceTable(PATH, bytes, kept=500)
    for text, values in zip(texts, table.of(texts)):
        assert np.frombuffer(b"".join(values), "<u4").tolist() == ids(text), repr(text)


@pytest.mark.parametrize("kept, block", [(500, 1000), (1_000_000, 1 << 22)])
def test_ids_of_whole_blocks_meet_the_library(monkeypatch, kept, block):
    monkeypatch.setattr(tokens, "TEXT_BLOCK", block)
    rng, parts = random.Random(2), ["a", "b", " ", " ", " ", "\n", "\t", "'s", "é", "1", "#", "<|endoftext|>", "\x85", "word", "..", "你"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(5000)]
    table = tokens.IdTable(PATH, kept)
    for _ in range(2):
        flat, sizes = (np.concatenate(x) for x in zip(*table.texts(texts)))
        wanted = [ids(t) for t in texts]
        assert sizes.tolist() == [len(w) for w in wanted] and flat.tolist() == sum(wanted, [])


def count_rows(rows, limit=1024):
    return by_id((i, len((t or "").encode()), n := len(ids(t)), n > limit) for i, t in rows)


def test_counts(spark, given):
    assert by_id(map(tuple, entry.queries()["op3_token_counts"](spark, SF).collect())) == count_rows(given)


def test_counts_of_odd_rows(odd_docs, no_docs):
    assert by_id(map(tuple, token_counts.token_counts(odd_docs, PATH).collect())) == count_rows(TEXTS)
    assert token_counts.token_counts(no_docs, PATH).collect() == []


def file_rows(rows, end=0):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        own = [*ids(t), end]
        out.append((i, start, len(own), crc(own)))
        start += len(own)
    return by_id(out)


def test_id_files(spark, given):
    assert by_id(map(tuple, entry.queries()["op8_id_files"](spark, SF).collect())) == file_rows(given)


def test_id_files_of_odd_rows(odd_docs, no_docs, tmp_path):
    assert by_id(map(tuple, id_files.id_file_round_trip(odd_docs, PATH).collect())) == file_rows(TEXTS)
    assert id_files.id_file_round_trip(no_docs, PATH).collect() == []
    folder = f"file://{tmp_path}/ids"
    manifest = id_files.write_id_files(odd_docs, PATH, folder, file_ids=50)
    assert manifest.count() > 1
    got = id_files.read_id_files(manifest, folder).collect()
    assert by_id((r.doc_id, tuple(r.ids)) for r in got) == by_id((i, (*ids(t), 0)) for i, t in TEXTS)


@pytest.mark.parametrize("bits", [1, 4, 9, 16, 31, 60, 64])
def test_words_hold_any_ids(bits):
    rng = random.Random(bits)
    for n in (0, 1, 2, 59, 60, 61, 500):
        values = np.array([rng.getrandbits(rng.randint(1, bits)) for _ in range(n)], np.uint64)
        words, escapes = id_files.pack_block(values)
        assert id_files.unpack_block(words, escapes).tolist() == values.tolist()
        assert len(words) <= n + escapes
    assert len(id_files.pack_block(np.ones(600, np.uint64))[0]) == 10


def test_cut_files_are_refused():
    data = id_files.to_file([1, None], [2, 1], np.array([5, 2**63, 7], np.uint64))
    assert [(d, i.tolist()) for d, i in id_files.from_file(data)] == [(1, [5, 2**63]), (None, [7])]
    for bad in (data[:-1], b"x" + data[1:], data + b"x"):
        with pytest.raises(ValueError):
            list(id_files.from_file(bad))


def check_packing(rows, given, capacity):
    """Pieces make up the documents, sequences have no gaps, and few are used."""
    docs, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    expected = defaultdict(list)
    for i, t in given:
        own, at = [*ids(t), 0], 0
        first = (len(own) - 1) % capacity + 1
        for k, n in enumerate([first] + [capacity] * ((len(own) - first) // capacity)):
            expected[i].append((k, at, n, crc(own[at:at + n])))
            at += n
    got = {i: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in own) for i, own in docs.items()}
    assert got == {i: sorted(v) for i, v in expected.items()}
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    total, large = sum(r.length for r in rows), sum(2 * r.length > capacity for r in rows)
    return len(bins), max(-(-total // capacity), large)


def test_packing(spark, given):
    rows = entry.queries()["op2_best_fit_packing"](spark, SF).collect()
    used, bound = check_packing(rows, given, 2048)
    assert used <= 1.02 * bound


def test_packing_of_odd_rows(odd_docs, no_docs):
    for capacity in (2048, 64, 3, 1):
        check_packing(packing.packed_documents(odd_docs, PATH, capacity).collect(), TEXTS, capacity)
    assert packing.packed_documents(no_docs, PATH).collect() == []


def test_plan_places_every_piece_once():
    rng = random.Random(3)
    for capacity in (1, 2, 7, 30, 100):
        for _ in range(40):
            counts = {rng.randint(1, capacity): rng.randint(1, 50) for _ in range(rng.randint(0, 12))}
            ranks, space = defaultdict(list), defaultdict(list)
            for length, rank, n, first, offset in packing.plan(counts, capacity):
                ranks[length] += range(rank, rank + n)
                for s in range(first, first + n):
                    space[s].append((offset, length))
            assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
            for own in space.values():
                at = 0
                for offset, length in sorted(own):
                    assert offset == at
                    at += length
                assert at <= capacity
                assert sum(3 * n > capacity for _, n in own) <= 2
