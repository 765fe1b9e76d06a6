"""Queries over the trade graph take all its edges."""

from weft.catalog import QUERIES
from weft.sources.graphs import trade

SF = "/root/testdata/sf0.001"


def parts(nodes, links):
    out = {n: n for n in nodes}
    for a, b in links:
        low, high = sorted((out[a], out[b]))
        out = {n: low if c == high else c for n, c in out.items()}
    return out


def test_bridges_and_two_edge_components_of_all_edges(spark):
    g = trade(spark, SF)
    nodes, links = [r["id"] for r in g.nodes.collect()], {(r["u"], r["v"]) for r in g.links.collect()}
    cut = {e for e in links if parts(nodes, links - {e}) != parts(nodes, links)}
    assert {(r["u"], r["v"]) for r in QUERIES["bridges"](spark, SF).collect()} == cut
    assert {r["id"]: r["component"] for r in QUERIES["two_edge_components"](spark, SF).collect()} == parts(nodes, links - cut)
