"""Co-members by bitmaps against all pairs of members."""

import random

from ewpanel.operators import graph


def by_pairs(inc):
    edges, of = {}, {}
    for n, t, e in inc:
        edges.setdefault((t, e), set()).add(n)
        of.setdefault(n, []).append((t, e))
    out = {}
    for n, mine in of.items():
        others = set().union(*(edges[e] for e in mine)) - {n}
        mean = round(sum(len(of[o]) for o in others) / len(others), 9) if others else None
        out[n] = (len(mine), sum(len(edges[e]) - 1 for e in mine), mean)
    return out


def features(spark, inc):
    df = spark.createDataFrame(inc, "node_id string, edge_type string, edge_id string")
    sizes = df.groupBy("edge_type", "edge_id").count().withColumnRenamed("count", "edge_size")
    rows = graph.structural_features(df.join(sizes, ["edge_type", "edge_id"])).collect()
    assert len({r.node_id for r in rows}) == len(rows)
    return {r.node_id: (r.degree, r.co_memberships, None if r.mean_co_degree is None else round(r.mean_co_degree, 9)) for r in rows}


def test_random_edges_equal_all_pairs(spark):
    r = random.Random(4)
    inc = {(f"n{r.randrange(1500)}", r.choice("ab"), str(int(r.paretovariate(0.5)) % 300)) for _ in range(6000)}
    inc |= {(f"n{i}", "hot", "all") for i in range(900)} | {("n1", "many", str(i)) for i in range(400)} | {("alone", "own", "x")}
    assert features(spark, sorted(inc)) == by_pairs(inc)


def test_no_edges(spark):
    assert features(spark, []) == {}


def test_a_large_edge_makes_no_pairs(spark, monkeypatch):
    """Rows that reach the unions: one for each edge and block of nodes, and the slices."""
    inc = [(f"n{i}", "hot", "all") for i in range(20000)]
    df = spark.createDataFrame(inc, "node_id string, edge_type string, edge_id string")
    numbered = df.select("node_id").distinct().coalesce(1).selectExpr("node_id", "monotonically_increasing_id() _no", "1L degree").cache()
    sums = graph.co_member_degrees(df.join(numbered, "node_id"), numbered.select("_no", "degree"))
    assert {tuple(r)[1:] for r in sums.collect()} == {(20000, 20000)} and sums.count() == 20000
    assert "CartesianProduct" not in sums._jdf.queryExecution().toString()
