import random
import re

from strandline.llm import decontamination as dc
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), len(found), dc.items_digest(found), bool(hit)))
    return sorted(out, key=repr)


def sample(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("aa bb Cc dd é".split()) + rng.choice(["", ",", ". ", "-"]) for _ in range(n))
    items = [(k, text(rng.choice([0, 1, 2, 3, 9, 10, 11, 14]))) for k in range(12)] + [(50, None), (None, text(12)), (3, "one more of three")]
    docs = []
    for i in range(60):
        picked = items[rng.randrange(12)][1] if i % 3 == 0 else ""
        docs.append((i, f"{text(rng.randrange(60))} {picked} {text(3)}"))
    return docs, items


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=repr)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def test_equals_direct_search(spark, documents):
    for seed in (1, 2):
        docs, items = sample(seed)
        assert rows(dc.contamination(documents(docs), bench(spark, items))) == brute(docs, [x for x in items if x[0] is not None])


def test_several_blocks_give_the_same(spark, documents, monkeypatch):
    docs, items = sample(3)
    docs += [docs[0], docs[0]]
    want = brute(docs, [x for x in items if x[0] is not None])
    monkeypatch.setattr(dc, "BLOCK_CHARS", 40)
    assert rows(dc.contamination(documents(docs), bench(spark, items))) == want


def test_odd_rows_and_empty_tables(spark, documents):
    items = [(1, "same text here now")]
    got = rows(dc.contamination(documents(ODD), bench(spark, items)))
    assert got == brute(ODD, items) and sum(r[5] for r in got) == 3
    assert rows(dc.contamination(documents(ODD), bench(spark, items[:0]))) == brute(ODD, [])
    assert rows(dc.contamination(documents(ODD).limit(0), bench(spark, items))) == []


def test_filter_drops_only_what_is_contaminated(spark, documents):
    df = documents(ODD)
    kept = dc.drop_contaminated(df, bench(spark, [(1, "same text here now")]))
    assert kept.columns == df.columns and kept.count() == len(ODD) - 3


def test_a_share_does_not_depend_on_the_blocks(spark, documents, monkeypatch):
    items = [(1, "a b c d e f g h i j"), (2, "k l m n o p q r s t")]
    docs = [(1, f"{items[0][1]} x y {items[1][1]}"), (2, f"{items[0][1]} " + "w " * 20), (3, None), (4, "-"), (1, f"{items[0][1]} x y {items[1][1]}")]
    df = documents(docs)
    for most in (0.0, 0.4, 0.8, 0.95):
        want = None
        for chars in (4_000_000, 25):
            monkeypatch.setattr(dc, "BLOCK_CHARS", chars)
            got = sorted((r.doc_id for r in dc.drop_contaminated(df, bench(spark, items), most).collect()))
            want = got if want is None else want
            assert got == want and dc.drop_contaminated(df, bench(spark, items), most).columns == df.columns
        assert want == {0.0: [3, 4], 0.4: [2, 3, 4], 0.8: [2, 3, 4], 0.95: [1, 1, 2, 3, 4]}[most]


def test_only_one_block_is_on_the_driver(spark, documents, monkeypatch):
    sizes = []
    was = dc._block
    monkeypatch.setattr(dc, "_block", lambda *a: sizes.append(len(was(*a))) or was(*a))
    monkeypatch.setattr(dc, "BLOCK_CHARS", 60)
    dc.contamination(documents([(1, "x")]), bench(spark, [(i, f"item number {i}") for i in range(40)])).collect()
    assert len(sizes) > 5 and sum(sizes) == 40 and max(sizes) < 20
