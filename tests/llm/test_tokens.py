import io
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import packing, tokenfile, tokenoutput, tokens
from tests.llm.conftest import ODD

pytest.importorskip("public_tokenizers")


def library(name):
    """The library's own tokenizer, as its file gives it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary(name))


HARD = ["a<|endoftext|>b", "<|startoftext|>A<|endoftext|> <|ENDOFTEXT|>", "<|endoftext|>", "x <|endoftext|", "|> y", "a  b  c\n\n d\te  ", "", None, " x", "it's we'll 12 34 é　z é", "<|endoftext|> a <|endoftext|>", "x" * 500 + " y", "ΑΣ ÀB ć ́d", "a\x1c b\x85 c   d", "ab\r\n cd\r\n\r\n  e", "a×! ÷? é. naïve,"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(name, monkeypatch):
    rng = random.Random(1)
    texts = HARD + ["".join(rng.choice("ab 1.\n\té 'sZ　́,×") for _ in range(60)) for _ in range(400)]
    monkeypatch.setattr(tokens, "CACHE_PIECES", 3_000)
    e = tokens.Encoder(tokens.vocabulary(name))
    for _ in range(2):
        flat, offs = e.encode(pa.array(texts))
        want = [x.ids for x in library(name).encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [flat[offs[i] : offs[i + 1]].tolist() for i in range(len(texts))] == want


def reference(name, rows, end):
    e = library(name)
    return [(i, np.array([*e.encode(t or "", add_special_tokens=False).ids, end], "<u4")) for i, t in rows]


def test_packing_keeps_every_id_once(documents):
    rows = ODD + [(100 + k, "some words of text " * k) for k in range(1, 300)]
    want = defaultdict(list)
    for i, ids in reference("byte_bpe_50k.json", rows, 0):
        want[i].append(ids.tobytes())
    got = packing.pack(documents(rows), tokens.vocabulary("byte_bpe_50k.json")).collect()
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for i, texts in want.items():
        pieces = sorted(docs[i], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == sum(len(t) // 4 for t in texts)
        if len(texts) == 1:
            assert b"".join(r.ids for r in pieces) == texts[0] and all(r.doc_tokens == len(texts[0]) // 4 for r in pieces)
            assert [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces]])[:-1].tolist()
    used = 0
    for members in seqs.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        used += at
    padded = sum(r.padded for r in packing.sequences(packing.pack(documents(rows), tokens.vocabulary("byte_bpe_50k.json"))).collect())
    assert used / padded > 0.95
    assert packing.pack(documents(ODD).limit(0), tokens.vocabulary("byte_bpe_50k.json")).collect() == []


def test_classes_are_filled_with_a_fixed_count():
    bins = packing.Bins()
    full = [b for n in range(90) for b in [bins.add(300, (n, 0, 0, 0, None))] if b]
    assert len(full) == 30 and all(len(b) == 3 for b in full) and list(bins.rest()) == []
    for length in range(1, 3_000):
        pieces = packing.cuts(length)
        assert sum(pieces) == length and max(pieces) <= 1024
        assert all(1024 // p * p >= 1000 for p in pieces if p > packing.SHORT_TAIL)


def test_token_file_reads_only_what_is_asked():
    docs = [(k if k % 7 else None, np.arange(k * 3, dtype="<u4").tobytes()) for k in range(60)]
    data, n, total = tokenfile.encode_file(docs, frame_tokens=500)
    assert (n, total) == (60, sum(len(x) // 4 for _, x in docs))
    source = io.BytesIO(data)
    r = tokenfile.Reader(source)
    assert list(r) == docs
    assert len(r._sizes) > 5 and r.tokens(59) == docs[59][1]
    broken = bytearray(data)
    broken[int(r._at[3]) + 12] ^= 1
    with pytest.raises(Exception):  # noqa: B017 the frame's or the table's checksum
        tokenfile.Reader(io.BytesIO(bytes(broken))).frame(3)
    assert tokenfile.Reader(io.BytesIO(bytes(broken))).tokens(0) == docs[0][1]
    empty, n, total = tokenfile.encode_file([])
    assert (n, total, list(tokenfile.Reader(io.BytesIO(empty)))) == (0, 0, [])


def test_token_output_is_in_id_order(documents, monkeypatch):
    monkeypatch.setattr(tokenoutput, "FILE_TEXT_BYTES", 40_000)
    rows = ODD + [(1_000 - k, f"text number {k} " * 20) for k in range(200)]
    got = tokenoutput.tokens_round_trip(documents(rows), tokens.vocabulary("word_bpe_49k.json")).collect()
    want = sorted(reference("word_bpe_49k.json", rows, 2), key=lambda x: (x[0] is not None, x[0] or 0))
    at, expected = 0, []
    for i, ids in want:
        expected.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda x: x[1]) == expected
    assert tokenoutput.tokens_round_trip(documents(ODD).limit(0), tokens.vocabulary("word_bpe_49k.json")).collect() == []


def test_files_are_read_back_by_as_many_partitions(spark, documents, monkeypatch):
    monkeypatch.setattr(tokenoutput, "FILE_TEXT_BYTES", 100)
    df = tokenoutput.tokens_round_trip(documents([(i, f"text of document {i}") for i in range(120)]), tokens.vocabulary("word_bpe_49k.json"))
    assert df.rdd.getNumPartitions() > 8 and df.count() == 120


def test_rows_of_one_id_are_spread_and_have_one_order(spark, documents, monkeypatch):
    monkeypatch.setattr(tokenoutput, "FILE_TEXT_BYTES", 300)
    rows = [(None if i % 3 == 0 else 5, f"text number {i}" if i % 4 else None) for i in range(160)]
    df = documents(rows)
    folder = f"file://{spark.sparkContext._jvm.java.lang.System.getProperty('java.io.tmpdir')}/strandline-test-{id(rows)}"
    name = tokens.vocabulary("word_bpe_49k.json")
    files = tokenoutput.write_tokens(df, name, folder, id_col="doc_id").collect()
    assert max(f.docs for f in files) < 160 / 2
    read = lambda d: sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenoutput.tokens_round_trip(d, name).collect()), key=lambda r: r[1])
    got = read(df)
    assert got == read(df.repartition(7)) and len(got) == 160
    assert [r[0] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
