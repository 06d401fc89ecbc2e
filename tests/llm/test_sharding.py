import hashlib
import math
import zlib
from collections import Counter

from strandline.llm import sharding as sh
from tests.llm.conftest import ODD


def test_laws(spark, documents, monkeypatch):
    monkeypatch.setattr(sh, "SLOT_GROUP_ROWS", 50)
    docs = [(i, f"text {i % 700}") for i in range(2_000)]
    got = sh.assign_shards(documents(docs), sh.even_tree(16), sh.even_tree(17)).collect()
    texts = dict(docs)
    assert len(got) == 2_000 and {r.doc_id for r in got} == set(texts)
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "key" for r in got)
    by = Counter(r.shard for r in got)
    assert set(by) == set(range(16)) and min(by.values()) > 60
    for s in by:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(by[s]))
    moved = [r for r in got if r.grown_shard != r.shard]
    assert moved and all(r.grown_shard == 16 for r in moved)


def test_more_shards_take_rows_only_into_themselves_where_a_region_opens(spark, documents):
    docs = documents([(i, "x") for i in range(500)])
    for n in (4, 8, 12, 16):
        got = sh.assign_shards(docs, sh.even_tree(n), sh.even_tree(n + 1), rows=500).collect()
        assert all(r.grown_shard in (r.shard, n) for r in got)


def test_movement_stays_in_the_subtree_whose_weights_change(spark, documents):
    def tree(w):
        a = sh.inner("a", [sh.leaf("a0", 0, w), sh.leaf("a1", 1, 3 - w)])
        return sh.inner("root", [a, sh.inner("b", [sh.leaf("b0", 2), sh.leaf("b1", 3)])])

    got = sh.assign_shards(documents([(i, "x") for i in range(600)]), tree(1), tree(2)).collect()
    assert all((r.shard < 2) == (r.grown_shard < 2) for r in got) and all(r.shard == r.grown_shard for r in got if r.shard > 1)
    share = sum(r.shard == 0 for r in got) / sum(r.shard < 2 for r in got)
    assert 0.22 < share < 0.45


def test_odd_rows(documents):
    got = sh.assign_shards(documents(ODD), sh.even_tree(4)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert (by[1].size, by[1].text_crc32) == (1, 0) and by[2].size == 1 and by[None].shard is not None
    assert len({(r.shard, r.slot) for r in got}) == len(got) and all(r.grown_shard is None for r in got)
    assert sh.assign_shards(documents(ODD).limit(0), sh.even_tree(4)).collect() == []


def test_each_shard_that_is_grown_takes_rows_only_into_itself(documents):
    docs, tree = documents([(i, "x") for i in range(3_000)]), sh.even_tree(16)
    for new in range(16, 21):
        more = sh.grow(tree)
        got = sh.assign_shards(docs, tree, more, rows=3_000).collect()
        assert all(r.grown_shard in (r.shard, new) for r in got)
        share = sum(r.grown_shard == new for r in got) / 3_000
        assert 0.6 / (new + 1) < share < 1.5 / (new + 1)
        tree = more


def plain_descent(key, node):
    """The least of -ln(u) / weight among the children, level by level."""
    while node.shard is None:
        def draw(c):
            u = (int(hashlib.md5(f"{key}/{c.name}".encode()).hexdigest()[:13], 16) + 1) / (1 << 52)
            return -math.log(u) / c.weight

        node = min((c for c in node.children if c.weight > 0), key=draw)
    return node.shard


def test_shards_equal_a_plain_descent(documents):
    tree = sh.grow(sh.inner("root", [sh.inner("a", [sh.leaf("a0", 0, 2.5), sh.leaf("a1", 1, 0)]), sh.inner("b", [sh.inner("b0", [sh.leaf("c", 2, 0.5), sh.leaf("d", 3)]), sh.leaf("e", 4, 3)])]), 0.7)
    got = sh.assign_shards(documents([(i, "x") for i in range(800)]), tree, sh.grow(tree)).collect()
    assert all((r.shard, r.grown_shard) == (plain_descent(r.doc_id, tree), plain_descent(r.doc_id, sh.grow(tree))) for r in got)
