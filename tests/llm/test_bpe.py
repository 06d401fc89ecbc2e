import hashlib
import random

import pytest

from strandline.llm import bpe, tokens
from tests.llm.conftest import ODD

pytest.importorskip("public_tokenizers")
NAME = "byte_bpe_50k.json"
HARD = ["", "a  b  c\n\n d\te  ", " x", "it's we'll I'LL 12 34 é　z é", "<|endoftext|> a <|endoftext|><|endoftext|>  b", "a<|endoftext|>b", "<|ENDOFTEXT|>", "x" * 500 + " y", "ΑΣ ÀB ć ́d", "a\x1c b\x85 c   d", "ab\r\n cd\r\n\r\n  e", "a×! ÷? é. naïve,", "\U0001f600\U0001f600 ok", "\x00\x01", "   ", "a՘b 1\U00011de0", "ᲀ‍न̃"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary(NAME))
    t.no_truncation()
    t.no_padding()
    return t


def test_ids_and_text_are_the_librarys(library, monkeypatch):
    monkeypatch.setattr(bpe, "WINDOW_CHARS", 40)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 500)
    rng = random.Random(1)
    texts = HARD + ["".join(rng.choice(["a", "b", "the", " ", " ", "1", ".", "\n", "\t", "é", "'s", "Z", "　", "́", ",", "<|endoftext|>", "ing", "漢", "😀"]) for _ in range(80)) for _ in range(600)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x250), rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(40)) for _ in range(600)]
    c = bpe.Codec(tokens.vocabulary(NAME))
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert c.encode(t).tolist() == want
        assert c.decode(want) == library.decode(want, skip_special_tokens=False)
    for _ in range(300):
        ids = [rng.randrange(50_400) for _ in range(12)]
        assert c.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert c.decode([-1, 64]) == "a"


def test_long_words_merge_like_short_ones(library):
    c = bpe.Codec(tokens.vocabulary(NAME))
    for t in ("a" * 30_000, "abcabd" * 4_000, "漢" * 5_000):
        assert c.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_tables_hold_the_letters_of_the_library(library):
    cut = library.pre_tokenizer.pre_tokenize_str
    for ranges, sign in ((bpe._LATER_LETTERS, "a"), (bpe._LATER_NUMBERS, "1")):
        for part in __import__("regex").findall(r"\\(?:u(....)|U(.{8}))", ranges):
            ch = chr(int("".join(part), 16))
            assert len(cut(sign + ch)) == 2 and len(bpe._PIECE.findall(sign + ch)) == 2


def test_rows(spark, documents, library):
    rows = ODD + list(enumerate(HARD, 100))
    got = bpe.digests(documents(rows), tokens.vocabulary(NAME)).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    ids = bpe.encode(documents(rows), tokens.vocabulary(NAME))
    assert ids.filter("doc_id = 1").first().ids == []
    back = bpe.decode(ids, tokens.vocabulary(NAME)).collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    odd = spark.createDataFrame([(1, None), (2, [64, None, 70_000, -3, 65])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(odd, tokens.vocabulary(NAME)).collect()} == {1: "", 2: "ab"}
    assert bpe.digests(documents(ODD).limit(0), tokens.vocabulary(NAME)).collect() == []


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="not a plain byte-level"):
        bpe.Codec(tokens.vocabulary("word_bpe_49k.json"))

