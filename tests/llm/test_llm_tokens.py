"""BPE, token files and packing against the tokenizers library and exact round trips."""

import hashlib
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from graphloom.llm import bpe, packing, token_files
from graphloom.llm.chunks import Chunks, Library, led_chunks
from graphloom.llm.common import utf8, words
from graphloom.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"
WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


def odd_texts():
    r = random.Random(1)
    signs = [*"abcdeABC  \n\t'.,!?0123éßñ  日😀́\x1f　\x85", "<|endoftext|>", "'s", "'LL", "\r\n"]
    return ["", "  ", "a  b c \n d", "x<|endoftext|>y <|startoftext|>", "Σίσυφος ΣΑΣ İstanbul ﬁ ½ Ⅷ", "abab" * 300, "a" * 3000,
            " <|endoftext|>  <|endoftext|> \n a", *("".join(r.choices(signs, k=r.randint(1, 60))) for _ in range(3000))]


@pytest.mark.parametrize("make, name", [
    (lambda p: bpe.Bpe(p), WORD), (lambda p: Library(p, False), WORD), (lambda p: Library(p, True), BYTE)])
def test_ids_are_the_librarys(make, name):
    texts = odd_texts()
    ours = make(vocabulary(name))
    ids, lengths = ours.encode(*utf8(pa.array(texts)))
    want = Tokenizer.from_file(vocabulary(name)).encode_batch(texts, add_special_tokens=False)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [e.ids for e in want]


def test_merging_and_verifying_agree():
    ours = bpe.Bpe(vocabulary(WORD))
    r = random.Random(5)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(1, 14))).encode() for _ in range(3000)]
    assert ours.words(words) == [ours.merge(w) for w in words]


def test_cache_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr("graphloom.llm.chunks.CACHE_CHUNKS", 50)
    chunks = Chunks(lambda new: (np.frombuffer(b"".join(new), np.uint8), np.array([len(c) for c in new])))
    r = random.Random(2)
    for _ in range(60):
        texts = [" ".join(f"{r.randint(0, 99)}" * r.choice([1, 1, 9]) for _ in range(r.randint(0, 9))) for _ in range(5)]
        data, offsets = utf8(pa.array(texts))
        ids, lengths, odd = chunks.ids(data, *words(data, offsets), 5)
        assert bytes(ids.tolist()).decode() == "".join(texts).replace(" ", "") and not odd.any()
        assert lengths.tolist() == [len(t.replace(" ", "")) for t in texts]


def test_chunks_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr("graphloom.llm.chunks.word_hashes", lambda data, starts, ends, seed: np.full(len(starts), 7, np.uint64))
    texts = ["some text", "other", "some", ""]
    ids, lengths = Library(vocabulary(WORD), False).encode(*utf8(pa.array(texts)))
    want = Tokenizer.from_file(vocabulary(WORD)).encode_batch(texts, add_special_tokens=False)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [e.ids for e in want]


def test_led_chunks_cover_all():
    texts = ["", " ", "a", " a  b ", "x\n\ny z", "   "]
    data, offsets = utf8(pa.array(texts))
    starts, ends, rows = led_chunks(offsets, *words(data, offsets))
    raw = data.tobytes()
    assert [b"".join(raw[s:e] for s, e, r in zip(starts, ends, rows, strict=True) if r == i).decode() for i in range(6)] == texts
    assert [raw[s:e].decode() for s, e in zip(starts, ends, strict=True)] == [" ", "a", " a", "  b", " ", "x", "\n\ny", " z", "   "]


def test_encode_and_decode(documents, odd_rows, no_documents):
    library = Tokenizer.from_file(vocabulary(WORD))
    rows = bpe.encode(documents, vocabulary(WORD)).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(no_documents, vocabulary(WORD)).collect() == []


def test_digests(spark):
    library = Tokenizer.from_file(vocabulary(WORD))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op2_bpe_codec"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False).encode()
        assert tuple(r)[1:] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest())


# --- files --------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [1, 5, 15, 16, 17, 31, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 10_007).astype(np.uint32)
    packed = token_files.pack_bits(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    assert (token_files.unpack_bits(np.frombuffer(packed, np.uint8), len(ids), bits) == ids).all()


def test_record_random_access():
    rng = np.random.default_rng(1)
    lengths = np.array([0, 3, 9000, 1, 4096, 0])
    ids = rng.integers(0, 49408, lengths.sum()).astype(np.uint32)
    reader = token_files.RecordReader(token_files.write_record([5, None, -7, 8, 9, 10], lengths, ids, 17))
    assert reader.doc_ids == [5, None, -7, 8, 9, 10]
    for start, stop in [(0, 0), (0, 1), (4095, 4097), (100, 9000), (0, len(ids)), (len(ids) - 1, len(ids))]:
        assert (reader.ids(start, stop) == ids[start:stop]).all()
    assert (reader.document(2) == ids[3:9003]).all()
    with pytest.raises(ValueError):
        token_files.write_record([1], np.array([1]), np.array([70000], np.uint32), 16)


def wanted_files(rows):
    library = Tokenizer.from_file(vocabulary(WORD))
    start, out = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


def test_files_of_odd_and_empty_tables(documents, odd_rows, no_documents):
    for frame, rows in ((documents, odd_rows), (no_documents, [])):
        records = token_files.written(token_files.token_records(frame, vocabulary(WORD), end=2))
        got = sorted(map(tuple, token_files.read_documents(records).collect()), key=repr)
        assert got == wanted_files([(d, t) for d, t, _ in rows])


def test_files_of_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op6_token_files"](spark, SF).collect()), key=repr) == wanted_files(rows)


# --- packing ----------------------------------------------------------------------------


def check_placed(rows, size):
    by = Counter()
    spans = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    for sequence, offset, length in spans:
        assert offset == by[sequence]
        by[sequence] += length
    assert all(n <= size for n in by.values())
    return len(by)


@pytest.mark.parametrize("seed", range(4))
def test_plans(seed):
    rng = np.random.default_rng(seed)
    size = [10, 64, 100, 2048][seed]
    counts = Counter(rng.integers(1, size + 1, 3000).tolist()) + Counter({size // 3: 500, 1: 3})
    bins = packing.best_fit(counts, size)
    better = packing.local_search(bins, size, 200)
    for found in (bins, better):
        held = Counter()
        for kind, n in found.items():
            assert n > 0 and sum(kind) <= size
            held.update({k: n * c for k, c in Counter(kind).items()})
        assert held == counts
    assert sum(better.values()) <= sum(bins.values())
    least = -(-sum(k * n for k, n in counts.items()) // size)
    assert sum(better.values()) <= least * 1.02 + 1


def test_search_empties_bins():
    bins = {(6,): 2, (4, 4): 1, (3,): 2}
    assert sum(packing.local_search(bins, 10).values()) < 5


def test_pack_of_odd_pieces(spark):
    rows = [(i % 7, [1, 5, 5, 5, 10, 3][i % 6], "x") for i in range(200)]
    pieces = spark.createDataFrame(rows, "doc_id long, length long, offset string").repartition(3)
    placed = packing.pack(pieces, size=10)
    assert Counter((r["doc_id"], r["length"]) for r in placed.collect()) == Counter((d, n) for d, n, _ in rows)
    check_placed(placed.collect(), 10)
    assert packing.pack(pieces.where("false"), size=10).collect() == []
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 11)], "doc_id long, length long"), size=10)


def test_pieces_and_sequences(documents, odd_rows):
    library = Tokenizer.from_file(vocabulary(BYTE))
    pieces = packing.token_pieces(documents, vocabulary(BYTE), end=0, size=100, ids=True)
    placed = packing.pack(pieces, size=100)
    rows = placed.collect()
    check_placed(rows, 100)
    want = Counter()
    for d, t, _ in odd_rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range((len(ids) - 1) % 100 + 1, len(ids) + 1, 100)]
        for i, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[d, i, s, e - s, crc32(np.array(ids[s:e], "<u4").tobytes()), tuple(ids[s:e])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in rows) == want
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(placed).collect()}
    assert all(whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"] for r in rows)


def test_packing_of_documents(spark):
    rows = QUERIES["op7_best_fit_packing"](spark, SF).collect()
    least = -(-sum(r["length"] for r in rows) // 2048)
    assert check_placed(rows, 2048) <= least + 1
