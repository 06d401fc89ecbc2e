import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from strandline.llm import resampling
from tests.llm.conftest import ODD

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def grams(text, longest):
    w = words(text)
    return [b" ".join(w[i : i + r]) for r in range(1, longest + 1) for i in range(len(w) - r + 1)]


def plainly(rows, target, longest=1, percent=10, least=20, buckets=10_000):
    def counts(texts):
        c = [0] * buckets
        for t in texts:
            for g in grams(t, longest):
                c[zlib.crc32(g) % buckets] += 1
        return c

    s, t = counts(x for _, x in rows), counts(target)
    ns, nt = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        g = grams(x, longest)
        weight = sum(gain[zlib.crc32(y) % buckets] for y in g)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((r[:5] for r in out), key=repr)


@pytest.mark.parametrize("longest", [1, 3])
def test_like_the_plain_way(spark, documents, longest):
    rows = ODD + [(1_000 + k, f"Some Words, {k} é{k % 7} of " + "Benchmark text_here " * (k % 40)) for k in range(300)]
    bench = ["benchmark text here", None, "of é3 and X9 " * 5]
    target = spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(bench)], "item_id string, text string")
    got = resampling.resample(documents(rows), target, longest=longest).collect()
    assert sorted((list(r) for r in got), key=repr) == plainly(rows, bench, longest)


def test_equal_scores_and_equal_rows_are_ranked_apart(spark, documents):
    rows = [(7, "same words again " * 10)] * 400 + [(None, "same words again " * 10)] * 100
    target = spark.createDataFrame([("a", "other")], "item_id string, text string")
    got = resampling.resample(documents(rows), target, percent=50).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 251))


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id string, text string")
    assert resampling.resample(documents(ODD).limit(0), none).collect() == []
    got = resampling.resample(documents(ODD), none).collect()
    assert sorted((list(r) for r in got), key=repr) == plainly(ODD, [])
    assert resampling.bucket_counts(spark.sparkContext.parallelize([]).map(lambda x: (x,)).toDF("text string")).sum() == 0


def test_checksums_of_spans():
    data = np.frombuffer(b"abc" + b"x" * 300 + b"\xff\x00", np.uint8)
    first, end = np.array([0, 3, 0, 5]), np.array([3, 303, 305, 5])
    got = resampling.crc_states(data, first, end, np.full(4, 0xFFFFFFFF, np.uint32)) ^ np.uint32(0xFFFFFFFF)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(first, end, strict=True)]
