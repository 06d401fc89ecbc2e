import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import queries, repeats
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plainly(words, least=6, periods=4):
    """Every run: from each place on and for each period, the longest stretch, if it is not part of another and has no lesser period."""
    n, found = len(words), set()
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - s
            if length >= max(least, periods * q) and not any(all(words[j] == words[j + d] for j in range(s, s + length - d)) for d in range(1, q)):
                found.add((s, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def texts(rng, count, top):
    for _ in range(count):
        kind, n = rng.random(), rng.randrange(top)
        if kind < 0.3:
            yield [rng.choice("ab") for _ in range(n)]
        elif kind < 0.5:
            yield [rng.choice("abc") for _ in range(n)]
        else:
            w = [rng.choice("abcdefgh") for _ in range(rng.randrange(4))]
            while len(w) < n:
                unit = [rng.choice("abcd") for _ in range(rng.randrange(1, 9))]
                w += unit * rng.randrange(1, 7) + unit[: rng.randrange(len(unit))]
            yield w


@pytest.mark.parametrize(("least", "periods"), [(6, 4), (2, 2), (5, 3), (9, 2)])
def test_runs_are_those_of_brute_force(least, periods):
    rng = random.Random(least)
    all_of = list(texts(rng, 800, 60))
    col = pa.array([rng.choice([" ", "\n ", "\t"]).join(w) for w in all_of])
    for at in range(0, len(col), 200):
        got = repeats.runs_of_texts(col.slice(at, 200), least, periods)
        assert got == [plainly(w, least, periods) for w in all_of[at : at + 200]]


def test_the_vocabulary_is_complete():
    rng = random.Random(5)
    for w in list(texts(rng, 300, 50)) + [list("abaababaabaababaababa"), list("a" * 40)]:
        codes = np.array([*map(ord, w), 1_000])
        names = repeats.Names(codes)
        got = {(q, tuple(codes[names.order[low] : names.order[low] + 2 * q])) for q, low, _ in repeats.vocabulary(names)}
        want = set()
        for q in range(1, len(w) // 2 + 1):
            for i in range(len(w) - 2 * q + 1):
                half = w[i : i + q]
                if half == w[i + q : i + 2 * q] and not any(q % d == 0 and half == half[:d] * (q // d) for d in range(1, q)):
                    want.add((q, tuple(map(ord, half + half))))
        assert got == want
        for q, low, high in repeats.vocabulary(names):
            square = codes[names.order[low] : names.order[low] + 2 * q].tolist()
            assert sorted(names.order[low : high + 1].tolist()) == [i for i in range(len(codes)) if codes[i : i + 2 * q].tolist() == square]


def test_rows(documents):
    rows = ODD + [(20, "x " + "a b c " * 9 + "y"), (21, "A a A a A a A"), (22, "say it again\nsay it again\tsay it again say it z"), (23, "é é é é é é")]
    docs = documents(rows)
    got = {(r.doc_id, r.start, r.length, r.period) for r in repeats.find_runs(docs).collect()}
    assert got == {(i, *r) for i, t in rows for r in plainly(WORD.findall(t or ""))} and (20, 1, 27, 3) in got
    kept = {r.doc_id: r.text for r in repeats.collapse_runs(docs).collect()}
    assert kept[20] == "x a b c y" and kept[8] == "word" and kept[22] == "say it again say it again say it again say it z" and kept[1] == ""
    assert repeats.run_digests(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        repeats.find_runs(docs, periods=1)


def test_a_long_text_of_repeats():
    rng = random.Random(3)
    unit = [str(rng.randrange(900)) for _ in range(4_000)]
    w = [str(rng.randrange(50)) for _ in range(3_000)] + unit * 9 + ["end"] * 30_000
    got = repeats.runs_of_texts(pa.array([" ".join(w)]))[0]
    assert got == [(3_000, 36_000, 4_000), (39_000, 30_000, 1)]


def expected(i, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(i).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    runs = plainly(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else None
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_the_query_is_the_contract(spark, small):
    got = queries.op11_tandem_repeat_runs(spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((expected(r.doc_id, r.text) for r in docs), key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    assert sum(r[1] > 0 for r in want) > 5
