"""Joins of the subgraphs' tables."""

import os
import random

import pytest

from stopwise.operators import graph as gr

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_no_table_of_points_is_built_in_the_driver(spark):
    from stopwise import plans

    plan = plans.QUERIES["K36_pack_subgraphs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_nodes_are_found_without_edges(spark, monkeypatch):
    """A query of nodes alone makes no edges between them, and queries of one session share its nodes."""
    from stopwise.plans import QUERIES, network_graph

    def unwanted(*_):
        raise AssertionError("edges are made")

    monkeypatch.setattr(network_graph.gr, "subgraph_edges", unwanted)
    sf = "/root/testdata/sf0.001"
    assert QUERIES["K33_subgraph_nodes"](spark, sf).columns == ["trip_key", "stop_seq", "pos", "station_id", "role", "hop", "found"]
    assert network_graph.graph_nodes(spark, sf) is network_graph.graph_nodes(spark, sf)


def steps(n, edges, most):
    """The matrix of steps by a breadth-first search."""
    out = bytearray()
    for start in range(n):
        seen, edge = {start: 0}, [start]
        while edge:
            edge = [b for x in edge for e in edges for a, b in (e, e[::-1]) if a == x and b not in seen and not seen.update({b: seen[x] + 1})]
        out += bytes(min(seen.get(i, most + 1), most + 1) for i in range(n))
    return bytes(out)


@pytest.mark.parametrize("most", [1, 6, 14])
def test_hops_of_random_graphs(spark, most):
    """Points of all sizes, without edges, with single nodes, edges that come twice and ends that are no nodes, in blocks of a few points."""
    rng = random.Random(most)
    sizes = [1, 2, 63, 63, *[rng.randrange(1, 20) for _ in range(30)]]
    made = [[(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([0, n // 2, n, 2 * n]))] for n in sizes]
    made[2] = [(i, i + 1) for i in range(62)]
    nodes = spark.createDataFrame([("t", k, i) for k, n in enumerate(sizes) for i in range(n)], "trip_key string, stop_seq long, pos int")
    edges = spark.createDataFrame([("t", k, *e) for k, es in enumerate(made) for e in [*es, *es[:1], (0, 63)]], "trip_key string, stop_seq long, from_pos int, to_pos int")
    got = {r["stop_seq"]: (r["n"], bytes(r["hops"])) for r in gr.hop_matrix(nodes, edges, most, block=3).collect()}
    assert got == {k: (n, steps(n, made[k], most)) for k, n in enumerate(sizes)}


def test_hops_are_stepped_for_blocks_of_points(spark):
    """Not by expressions over each row's lists, which took milliseconds a point."""
    nodes = spark.createDataFrame([("t", 1, 0)], "trip_key string, stop_seq long, pos int")
    edges = spark.createDataFrame([("t", 1, 0, 0)], "trip_key string, stop_seq long, from_pos int, to_pos int")
    plan = gr.hop_matrix(nodes, edges)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "lambdafunction" not in plan
