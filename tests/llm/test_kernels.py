import random

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import kernels, shared, tokens


def whole(words, table=None):
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    size = np.array([len(w) for w in words])
    end = np.cumsum(size + 1) - 1
    return kernels.span_hashes(data, end - size, end, table)


def test_equal_spans_have_equal_hashes_wherever_they_stand():
    rng = random.Random(1)
    words = [bytes(rng.choice(b"abAB") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 1_023, 1_032, 1_033, 3_000]))) for _ in range(400)] * 2
    for table, key in ((None, lambda w: w), (kernels.LOWER, bytes.lower)):
        by = {}
        for w, h in zip(words, whole(words, table).tolist(), strict=True):
            by.setdefault(key(w), set()).add(h)
        assert all(len(h) == 1 for h in by.values()) and len({min(h) for h in by.values()}) == len(by)


def test_alternating_words_differ():
    # the Thue-Morse word and its complement, which any polynomial modulo a power of two confuses
    morse = bytes(97 + bin(i).count("1") % 2 for i in range(4_096))
    other = bytes(195 - b for b in morse)
    for n in (64, 1_024, 2_048, 4_096):
        a, b = whole([morse[:n], other[:n]]).tolist()
        assert a != b


def test_same_spans():
    rng = random.Random(2)
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(400)), np.uint8)
    a, b, n = (np.array([rng.randrange(k) for _ in range(3_000)]) for k in (360, 360, 40))
    raw = data.tobytes()
    assert kernels.same_spans(data, a, data, b, n).tolist() == [raw[i : i + k] == raw[j : j + k] for i, j, k in zip(a, b, n, strict=True)]


@pytest.mark.parametrize("bits", [0, 3, 64])
def test_pieces_with_one_hash_keep_their_own_ids(monkeypatch, bits):
    was = kernels.span_hashes
    monkeypatch.setattr(kernels, "span_hashes", lambda *a: was(*a) & np.uint64((1 << bits) - 1))
    texts = ["the cat sat, on the mat; the dog\nbarked " * 3, "a dog and a cat", None, "cats dogs mats barks", "x" * 200]
    enc = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"))
    plain = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"))
    for _ in range(2):  # with an empty table, and with a full one
        ids, offs = enc.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[offs[i] : offs[i + 1]].tolist() == (plain._encode_texts([t])[0] if t else [])


class FakeContext:
    master = "spark://head:7077"

    def getConf(self):  # noqa: N802
        return {}


class FakeSession:
    sparkContext = FakeContext()  # noqa: N815
    conf = {}


def test_no_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        shared.shared_dir(FakeSession())


def test_hot_keys_join_where_they_are(spark):
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 500), (2, 3), (None, 4), (3, 90)) for i in range(n)], "k int, i int")
    table = spark.createDataFrame([(1, "a", 500), (2, "b", 3), (3, "c", 90), (4, "d", 0)], "k int, name string, copies long")
    got = shared.join_counted(rows, table, "k", "copies")
    assert got.columns == ["k", "i", "name"] and sorted(got.groupBy("name").count().collect()) == [("a", 500), ("b", 3), ("c", 90)]
