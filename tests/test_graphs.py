from strandline.operators import credit, graphs

EDGES = "trajectory_uid string, ref string, input string"


def table(spark, by):
    return spark.createDataFrame([(t, a, b) for t, edges in by.items() for a, b in edges], EDGES)


def plain(edges):
    """Ancestor pairs by following inputs from each step."""
    inputs = {}
    for a, b in edges:
        if a is not None and b is not None:
            inputs.setdefault(a, set()).add(b)
    out = set()
    for start in inputs:
        stack, seen = list(inputs[start]), set()
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += inputs.get(x, ())
        out |= {(start, x) for x in seen}
    return out


CHAIN = [(f"s{i}", f"s{i - 1}") for i in range(1, 201)]
DIAMOND = [(f"{side}{i}", f"{x}{i - 1}") for i in range(1, 21) for side in "ab" for x in "ab"]
CIRCLE = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("d", "a")]
BLANK = [("a", None), (None, "b"), ("a", "b")]


def test_long_chains_diamonds_and_circles(spark):
    by = {"chain": CHAIN, "diamond": DIAMOND, "circle": CIRCLE, "blank": BLANK}
    got = {}
    for r in graphs.ancestors(table(spark, by)).collect():
        assert (r.ref, r.ancestor) not in got.setdefault(r.trajectory_uid, set())
        got[r.trajectory_uid].add((r.ref, r.ancestor))
    assert got == {t: plain(e) for t, e in by.items()}
    assert len(got["chain"]) == 200 * 201 // 2


def test_taint_of_deep_steps(spark):
    nodes = spark.createDataFrame([("chain", f"s{i}", i not in (0, 150)) for i in range(201)], "trajectory_uid string, ref string, valid boolean")
    got = {r.ref: (r.bad, r.weight) for r in credit.taint(nodes, table(spark, {"chain": CHAIN}), 0.5).collect()}
    assert got["s0"] == (0, 0.0) and got["s149"] == (1, 0.5) and got["s150"] == (1, 0.0) and got["s200"] == (2, 0.25)


def test_what_starts_reach(spark):
    starts = spark.createDataFrame([("chain", "s180"), ("chain", "s3"), ("alone", "x"), ("alone", None)], "trajectory_uid string, ref string")
    got = {(r.trajectory_uid, r.ref) for r in graphs.reachable(table(spark, {"chain": CHAIN}), starts).collect()}
    assert got == {("chain", f"s{i}") for i in range(181)} | {("alone", "x")}


def test_empty_graphs(spark):
    none = spark.createDataFrame([], EDGES)
    assert graphs.ancestors(none).collect() == []
    assert graphs.reachable(none, none.select("trajectory_uid", "ref")).collect() == []


def test_a_chain_of_thousands_without_python_workers(spark):
    edges = spark.range(1, 5_001).selectExpr("'long' AS trajectory_uid", "id AS ref", "id - 1 AS input")
    closed = graphs.ancestors(edges)
    r = closed.selectExpr("count(*) AS n", "sum(ref - ancestor) AS far", "count_if(ancestor >= ref) AS wrong").first()
    assert (r.n, r.wrong) == (5_000 * 5_001 // 2, 0) and r.far == sum(d * (5_001 - d) for d in range(1, 5_001))
    starts = spark.createDataFrame([("long", 4_000)], "trajectory_uid string, ref bigint")
    assert graphs.reachable(edges, starts).count() == 4_001
    assert "Python" not in closed._jdf.queryExecution().toString() and "MapIn" not in closed._jdf.queryExecution().toString()
