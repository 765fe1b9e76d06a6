"""Rules that add to a graph: their matches become edges, nodes or fields. What a rule adds is named after the rule and the match, so applying it twice adds nothing."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators import inference, maintenance, rules, temporal
from weft.operators.classes import classes, lists_of, spread
from weft.plans.graph import Graph
from weft.plans.iterate import checkpoint


def edges_of(rows: DataFrame, rule: str, label: str) -> DataFrame:
    """Edges for matches(src, tgt, weight): one source and one target each; of several matches of one pair the best."""
    best = rows.groupBy("src", "tgt").agg(F.max("weight").cast("double").alias("weight"))
    return best.select(F.concat_ws(":", F.lit(rule), "src", "tgt").alias("edge_id"), F.array("src").alias("source_ids"), F.array("tgt").alias("target_ids"), F.lit(label).alias("label"), "weight")


def nodes_of(rows: DataFrame, label: str | None = None, **data: str) -> DataFrame:
    """Nodes for rows(id), or rows(id, label), with the given fields."""
    fields = F.create_map(*[F.lit(x) for k, v in data.items() for x in (k, v)]) if data else F.create_map().cast("map<string,string>")
    name = F.col("label") if label is None and "label" in rows.columns else F.lit(label) if label else F.col("id")
    return rows.select("id", name.alias("label"), fields.alias("data"), F.lit(1.0).alias("weight")).dropDuplicates(["id"])


def _grown(g: Graph, edges: DataFrame, nodes: DataFrame | None = None, prefix: str | None = None) -> Graph:
    """g with new nodes and edges. They are named after members that exist, so no reference needs to be checked.

    prefix: what all new edges' names begin with; where no old one's does, none is looked up.
    """
    new = edges.select(*g.edges.columns)
    old = g.edges.select("edge_id") if prefix is None else _names(g, prefix)
    if old is not None:
        new = new.join(old, "edge_id", "left_anti").select(*g.edges.columns)
    old = g.nodes if nodes is None else g.nodes.unionByName(nodes.join(g.nodes.select("id"), "id", "left_anti"))
    return Graph(old, g.edges.unionByName(new))


def _names(g: Graph, prefix: str) -> DataFrame | None:
    """edge_id of the edges whose names begin with the prefix; None without any."""
    old = checkpoint(g.edges.select("edge_id").where(F.col("edge_id").startswith(prefix)))
    return None if old.isEmpty() else old


def apply_transitive(g: Graph, label: str, confidence: float = 0.9, new_label: str = "inferred") -> Graph:
    """An edge from a to c for each chain over the label that has none."""
    found = rules.transitive(g, label, confidence).select(F.col("a").alias("src"), F.col("c").alias("tgt"), F.col("score").alias("weight"))
    return _grown(g, edges_of(found, "transitive", new_label))


def apply_inverse(g: Graph, label: str, inverse_label: str) -> Graph:
    return _grown(g, edges_of(rules.inverse(g, label, inverse_label).withColumn("weight", F.lit(1.0)), "inverse", inverse_label))


def apply_hub(g: Graph, support: int = 2, confidence: float = 0.6, label: str = "causes") -> Graph:
    return _grown(g, edges_of(rules.hub_inference(g, support, confidence).select("src", "tgt", F.col("share").alias("weight")), "hub", label))


def apply_property(g: Graph, key: str) -> Graph:
    """The nodes with the field that reaches them."""
    found = rules.propagate_property(g, key).withColumnRenamed("value", "_v")
    nodes = g.nodes.join(found, "id", "left").withColumn("data", F.when(F.col("_v").isNotNull(), F.map_concat(F.map_filter("data", lambda k, _: k != key), F.create_map(F.lit(key), F.col("_v")))).otherwise(F.col("data")))
    return Graph(nodes.drop("_v"), g.edges)


def apply_abduction(g: Graph, effect: str, explained: str, confidence: float = 0.5) -> Graph:
    """A hypothesis for each effect without a cause, and an edge from it."""
    found = inference.abductions(g, effect, explained).select(F.concat(F.lit("hypothesis:"), "id").alias("src"), F.col("id").alias("tgt"), F.lit(confidence).alias("weight"))
    return _grown(g, edges_of(found, "abduction", "possible_cause"), nodes_of(found.select(F.col("src").alias("id")), kind="hypothesis"))


def apply_induction(g: Graph, least: int = 3, confidence: float = 0.7) -> Graph:
    """A category for each target that enough nodes have by one label: an edge to its members, and one of the label to the target."""
    found = rules.inductive(g, least).select("label", "tgt", F.concat_ws(":", F.lit("category"), "label", "tgt").alias("id"))
    members = g.pairs.select("label", "src", "tgt").distinct().join(found, ["label", "tgt"]).groupBy("id").agg(F.array_sort(F.collect_set("src")).alias("target_ids"))
    general = members.select(F.concat(F.lit("generalizes:"), "id").alias("edge_id"), F.array("id").alias("source_ids"), "target_ids", F.lit("generalizes").alias("label"), F.lit(confidence).alias("weight"))
    own = found.select(F.concat(F.lit("induction:"), "id").alias("edge_id"), F.array("id").alias("source_ids"), F.array("tgt").alias("target_ids"), "label", F.lit(confidence).alias("weight"))
    return _grown(g, general.unionByName(own), nodes_of(found.select("id"), kind="category"))


def similar_data(g: Graph, least: float = 0.8, digits: int | None = None, but: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """a < b, similarity: nodes with the same set of fields that agree in a share of ``least`` of them or more.

    Of k fields, d = floor((1 - least) k) may differ; dealt into d + 1 groups, one of them agrees as a whole: nodes meet over the values of such a group.
    Nodes with the same data are one class, and only classes meet. digits: the similarity is rounded to so many, once for each two classes. but(a, b), a < b, and known(xs, ys, own): pairs left out.
    """
    found, members = _like_classes(g, least, digits)
    if known is not None:
        return spread(found, members, but, known)
    return spread(found, members) if but is None else spread(found, members, but)


def _like_classes(g: Graph, least: float, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """ca <= cb, similarity of the classes of nodes of the same data, and their members."""
    keys = F.array_sort(F.map_keys("data"))
    rows = g.nodes.where(F.size("data") > 0).select("id", keys.alias("keys"), F.transform(keys, lambda k: F.col("data")[k]).alias("values"))
    kinds, members = classes(rows, "keys", "values")
    d = F.floor((1 - least) * F.size("keys") + 1e-9).cast("int")
    groups = F.transform(F.sequence(F.lit(0), d), lambda j: F.struct(j.alias("j"), F.filter("values", lambda _, i: F.pmod(i, d + 1) == j).alias("values")))
    spread_ = kinds.select("c", "keys", F.col("values").alias("v"), F.explode(groups).alias("at"))
    side = lambda c: spread_.select(F.col("c").alias(f"c{c}"), "keys", "at", F.col("v").alias(f"v{c}"))
    same = F.size(F.filter(F.zip_with("va", "vb", lambda x, y: x == y), lambda e: e)) / F.size("keys")
    found = side("a").join(side("b"), ["keys", "at"]).where("ca <= cb").select("ca", "cb", same.alias("similarity")).where(F.col("similarity") >= least)
    found = found.dropDuplicates(["ca", "cb"])
    if digits is not None:
        found = found.withColumn("similarity", F.round("similarity", digits))
    return found, members


def generalizations(g: Graph, least: float = 0.8, label: str = "generalizes", digits: int | None = None) -> DataFrame:
    """a < b, similarity of nodes with like fields that no edge of the label has as targets together."""
    have = g.edges.where(F.col("label") == label).select(F.array_sort("target_ids").alias("ids")).select("ids", F.posexplode("ids").alias("i", "a"))
    both = have.select("a", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("b"))
    return similar_data(g, least, digits, both)


def apply_generalization(g: Graph, least: float = 0.8, digits: int | None = None) -> Graph:
    """An abstract node for each pair, and an edge from it to both."""
    found = generalizations(g, least, digits=digits).select("*", F.concat_ws(":", F.lit("abstract"), "a", "b").alias("id"))
    edges = found.select(F.concat(F.lit("generalizes:"), "id").alias("edge_id"), F.array("id").alias("source_ids"), F.array("a", "b").alias("target_ids"), F.lit("generalizes").alias("label"), F.col("similarity").alias("weight"))
    return _grown(g, edges, nodes_of(found.select("id"), kind="abstract"), "generalizes:abstract:")


@dataclass(frozen=True)
class Substituted(Graph):
    """A graph with an edge each way of ``label`` between each x and each y of lists(xs, ys, own), as lists_of gives them: its other edges are those of ``before``."""

    before: Graph
    label: str
    lists: DataFrame


def substitutions(g: Graph, least: float = 0.8, label: str = "substitutes", digits: int | None = None) -> DataFrame:
    """a < b, similarity of nodes with like fields and no edge of the label between them, either way."""
    return similar_data(g, least, digits, *_linked(g, label))


def _linked(g: Graph, label: str) -> tuple[DataFrame, DataFrame | None]:
    """The pairs a <= b that an edge of the label links, either way, as rows and as lists. Edges that are known as lists are not made only to be looked up."""
    known = g.lists if isinstance(g, Substituted) and g.label == label else None
    pairs = (g if known is None else g.before).pairs
    return pairs.where(F.col("label") == label).select(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")), known


def apply_substitution(g: Graph, least: float = 0.8, label: str = "substitutes", digits: int | None = None) -> Graph:
    """An edge each way, of the similarity's weight. Each pair is found once, so none of its edges are told apart again."""
    found, members = _like_classes(g, least, digits)
    pairs = spread(found, members, *_linked(g, label))
    ways = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("tgt")), F.struct(F.col("b").alias("src"), F.col("a").alias("tgt")))
    both = pairs.select(F.explode(ways).alias("x"), "similarity").select("x.src", "x.tgt", F.col("similarity").cast("double").alias("weight"))
    edges = both.select(F.concat_ws(":", F.lit("substitution"), "src", "tgt").alias("edge_id"), F.array("src").alias("source_ids"), F.array("tgt").alias("target_ids"), F.lit(label).alias("label"), "weight")
    if isinstance(g, Substituted) or _names(g, "substitution:") is not None:
        return _grown(g, edges)
    # no edge is left out for its name, so all pairs of the lists are linked now: by the new edges, or by those of the label that g has
    return Substituted(g.nodes, g.edges.unionByName(edges.select(*g.edges.columns)), g, label, lists_of(found.select("ca", "cb"), members))


def analogous_nodes(g: Graph, least: float = 0.6, labels: int = 2) -> DataFrame:
    """a < b, similarity of the sets of labels of their outgoing edges, of as many labels each."""
    sets = g.incidence.where(F.col("role") == "source").groupBy("node_id").agg(F.array_sort(F.collect_set("label")).alias("s")).where(F.size("s") >= labels)
    kinds = rules.analogies(g, least, labels).select("p", "q", "similarity")
    side = lambda c, k: sets.select(F.col("node_id").alias(c), F.array_join("s", "|").alias(k))
    rows = kinds.join(side("x", "p"), "p").join(side("y", "q"), "q").where("x <> y")
    return rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity").distinct()


def apply_analogy(g: Graph, least: float = 0.6, labels: int = 2) -> Graph:
    found = analogous_nodes(g, least, labels).select(F.col("a").alias("src"), F.col("b").alias("tgt"), F.col("similarity").alias("weight"))
    return _grown(g, edges_of(found, "analogy", "analogous_to"))


def causal_sequences(events: DataFrame, key: str, max_gap: float, least: float = 0.0) -> DataFrame:
    """cause, effect, gap, confidence: events of one key that meet or come before another, at most max_gap apart; confidence 1 / (1 + gap)."""
    near = temporal.close_pairs(events, max_gap, key)
    ahead = near.where(F.col("relation").isin("before", "meets")).select(F.col("a").alias("cause"), F.col("b").alias("effect"), "gap")
    behind = near.where(F.col("relation").isin("after", "met_by")).select(F.col("b").alias("cause"), F.col("a").alias("effect"), "gap")
    return ahead.unionByName(behind).withColumn("confidence", 1 / (1 + F.col("gap"))).where(F.col("confidence") >= least)


def causal_edges(sequences: DataFrame, prefix: str = "event:") -> DataFrame:
    """The edges that causal_sequences add between the nodes of the events."""
    name = lambda c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    return edges_of(sequences.select(name("cause").alias("src"), name("effect").alias("tgt"), F.col("confidence").alias("weight")), "sequence", "temporal_cause")


def decompositions(g: Graph, degree: int = 5, least: int = 2, label: str = "decomposes_into") -> DataFrame:
    """hub, label, members (sorted): for hubs of ``degree`` edges or more the other side's nodes by edge label, groups of ``least`` members or more, where there are two such groups."""
    hubs = g.degree.where(F.col("degree") >= degree).select(F.col("id").alias("hub"))
    done = g.incidence.where((F.col("label") == label) & (F.col("role") == "source")).select(F.col("node_id").alias("hub")).distinct()
    out = g.pairs.select(F.col("src").alias("hub"), "label", F.col("tgt").alias("id"))
    back = g.edges.select("label", "source_ids", "target_ids", F.explode("target_ids").alias("hub")).where(~F.array_contains("source_ids", F.col("hub"))).select("hub", "label", F.explode("source_ids").alias("id"))
    rows = out.unionByName(back).where("hub <> id").join(hubs, "hub", "left_semi").join(done, "hub", "left_anti")
    groups = rows.groupBy("hub", "label").agg(F.array_sort(F.collect_set("id")).alias("members")).where(F.size("members") >= least)
    many = groups.groupBy("hub").agg(F.count("*").alias("n")).where("n >= 2").select("hub")
    return groups.join(many, "hub", "left_semi")


def apply_decomposition(g: Graph, degree: int = 5, least: int = 2, confidence: float = 0.7) -> Graph:
    """A node for each group, an edge from the hub to it, and one from it to the members."""
    found = decompositions(g, degree, least).select("*", F.concat_ws(":", F.lit("part"), "hub", "label").alias("id"))
    into = found.select(F.concat(F.lit("decomposes:"), "id").alias("edge_id"), F.array("hub").alias("source_ids"), F.array("id").alias("target_ids"), F.lit("decomposes_into").alias("label"), F.lit(confidence).alias("weight"))
    holds = found.select(F.concat(F.lit("contains:"), "id").alias("edge_id"), F.array("id").alias("source_ids"), F.col("members").alias("target_ids"), F.lit("contains").alias("label"), F.lit(1.0).alias("weight"))
    return _grown(g, into.unionByName(holds), nodes_of(found.select("id"), kind="component"))


def simultaneities(states: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """a < b: nodes that both occur in leaves of states(state, parent, nodes) with one parent, where it has two leaves or more; without the pairs of known(a, b).

    A parent's nodes are paired in the row; how many there are is a matter of its leaves.
    """
    leaves = states.join(states.select(F.col("parent").alias("state")).where("state is not null").distinct(), "state", "left_anti").where("parent is not null")
    groups = leaves.groupBy("parent").agg(F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("nodes")))).alias("ids")).where("n >= 2")
    rows = groups.select("ids", F.posexplode("ids").alias("i", "a")).select("a", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("b")).distinct()
    return rows if known is None else rows.join(known, ["a", "b"], "left_anti")


def simultaneous_edges(pairs: DataFrame) -> DataFrame:
    return edges_of(pairs.select(F.col("a").alias("src"), F.col("b").alias("tgt"), F.lit(1.0).alias("weight")), "simultaneity", "simultaneous")


def frame_complexities(g: Graph, frames: dict[str, int], field: str = "optimal_frame") -> DataFrame:
    """id, frame, complexity: of each node not yet stamped with the field, the mean number of edges of it and its neighbours that have frames[frame] members at most."""
    fresh = g.nodes.where(F.col("data")[field].isNull()).select("id")
    around = g.adj.select(F.col("u").alias("id"), F.col("v").alias("node_id")).unionByName(g.nodes.select("id", F.col("id").alias("node_id"))).join(fresh, "id", "left_semi")
    counts = [F.count_if(F.col("size") <= most).alias(name) for name, most in frames.items()]
    per = g.members.groupBy("node_id").agg(*counts)
    means = around.join(per, "node_id", "left").groupBy("id").agg(*[F.avg(F.coalesce(name, F.lit(0))).alias(name) for name in frames])
    each = F.array(*[F.struct(F.lit(name).alias("frame"), F.col(name).alias("complexity")) for name in frames])
    return means.select("id", F.explode(each).alias("x")).select("id", "x.frame", "x.complexity")


def apply_complexity(g: Graph, frames: dict[str, int], field: str = "optimal_frame") -> Graph:
    """The nodes stamped with the frame of the least complexity, ties by name."""
    best = frame_complexities(g, frames, field).groupBy("id").agg(F.min(F.struct("complexity", "frame")).alias("m")).select("id", F.col("m.frame").alias("_f"))
    nodes = g.nodes.join(best, "id", "left").withColumn("data", F.when(F.col("_f").isNotNull(), F.map_concat("data", F.create_map(F.lit(field), F.col("_f")))).otherwise(F.col("data"))).drop("_f")
    return Graph(nodes, g.edges)


def projections(g: Graph, vectors: DataFrame, sources: DataFrame, label: str, least: float = 0.7) -> DataFrame:
    """a, b, c, d, score: for each edge of the label from a to b and each c of sources.id, the d nearest to c + b - a by vectors(id, embedding), of least or more; all four differ; ties by id.

    The offsets of a label's edges and the sources make one query each, which is compared with all vectors; sources are few, being asked for.
    """
    from weft.operators.retrieval import nearest, unit

    u = unit(vectors)
    side = lambda c: u.select(F.col("id").alias(c), F.col("embedding").alias(f"v{c}"))
    ab = g.pairs.where((F.col("label") == label) & (F.col("src") != F.col("tgt"))).select(F.col("src").alias("a"), F.col("tgt").alias("b")).distinct()
    offsets = ab.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.zip_with("vb", "va", lambda x, y: x - y).alias("off"))
    asked = sources.select(F.col("id").alias("c")).distinct().join(side("c"), "c").agg(F.collect_list(F.struct("c", "vc")).alias("cs"))
    rows = offsets.withColumn("cs", asked.scalar()).select("a", "b", "off", F.explode("cs").alias("x")).where("x.c <> a and x.c <> b")
    queries = rows.select(F.concat_ws(":", "a", "b", "x.c").alias("query"), "a", "b", F.col("x.c").alias("c"), F.zip_with("x.vc", "off", lambda x, y: x + y).alias("embedding"))
    best = nearest(u, unit(queries), F.array("a", "b", "c"))
    return best.where(F.col("cosine") >= least).select("a", "b", "c", F.col("id").alias("d"), F.col("cosine").alias("score"))


def apply_projection(g: Graph, found: DataFrame, label: str) -> Graph:
    """The graph with an edge of the label from c to d for each of the projections."""
    return _grown(g, edges_of(found.select(F.col("c").alias("src"), F.col("d").alias("tgt"), F.col("score").alias("weight")), "projection", label))


def reason(g: Graph, label: str, depth: int = 3, confidence: float = 0.9, least: float = 0.0) -> tuple[Graph, DataFrame]:
    """The graph with what chains over the label infer, in rounds until nothing new is found, and its provenance (edge_id, rule, depth, score).

    Each round sees only the pairs that the last one found. least: inferences of a lower score are not added.
    """
    found = inference.forward_chain(g, label, depth, confidence).where(F.col("score") >= least)
    edges = edges_of(found.select("src", "tgt", F.col("score").alias("weight")), "transitive", "inferred")
    provenance = found.select(F.concat_ws(":", F.lit("transitive"), "src", "tgt").alias("edge_id"), F.lit("transitive").alias("rule"), "depth", "score")
    return _grown(g, edges), provenance


def reason_from(g: Graph, label: str, new: DataFrame, depth: int = 2, confidence: float = 0.9) -> DataFrame:
    """src, tgt, depth, score of what is inferred from the nodes new.id on: pairs whose source is one of them."""
    from weft.operators.inference import forward_chain_from

    return forward_chain_from(g, label, new, depth, confidence)


def fused(runs: dict[str, DataFrame], least: float) -> DataFrame:
    """src, tgt, votes, score: the pairs that a share of ``least`` of the runs(src, tgt, score) or more infer, with the mean of their scores."""
    rows = reduce(DataFrame.unionByName, [r.select("src", "tgt", "score").withColumn("run", F.lit(name)) for name, r in runs.items()])
    found = rows.groupBy("src", "tgt").agg(F.count("*").alias("votes"), F.avg("score").alias("score"))
    return found.where(F.col("votes") >= math.ceil(least * len(runs) - 1e-9))


def resolve(g: Graph, negations: list[tuple[str, str]], by: str = "weight") -> Graph:
    """g without the lesser of each two contradicting edges: by weight, or by id (the later stays); ties go to the smaller id. """
    found = rules.contradictions(g, negations)
    key = F.struct(-F.col("weight"), "edge_id") if by == "weight" else F.struct(F.lit(0.0), "edge_id")
    rank = g.edges.select("edge_id", key.alias("k"))
    rows = found.join(rank.select(F.col("edge_id").alias("first"), F.col("k").alias("k1")), "first").join(rank.select(F.col("edge_id").alias("second"), F.col("k").alias("k2")), "second")
    first_stays = F.col("k1") < F.col("k2") if by == "weight" else F.col("k1") > F.col("k2")
    return maintenance.remove_edges(g, rows.select(F.when(first_stays, F.col("second")).otherwise(F.col("first")).alias("edge_id")).distinct())


#: What a rule's specification may name: its function and parameters.
RULES = {
    "transitive": (apply_transitive, ("label", "confidence", "new_label")),
    "inverse": (apply_inverse, ("label", "inverse_label")),
    "hub": (apply_hub, ("support", "confidence", "label")),
    "property": (apply_property, ("key",)),
    "abduction": (apply_abduction, ("effect", "explained", "confidence")),
    "induction": (apply_induction, ("least", "confidence")),
    "generalization": (apply_generalization, ("least",)),
    "substitution": (apply_substitution, ("least", "label")),
    "analogy": (apply_analogy, ("least", "labels")),
    "decomposition": (apply_decomposition, ("degree", "least", "confidence")),
    "complexity": (apply_complexity, ("frames", "field")),
}


def serialize_rules(rules_: list[dict]) -> str:
    """Specifications of rules (kind and parameters) as JSON; unknown kinds and parameters are an error."""
    for spec in rules_:
        known = RULES[spec["kind"]][1]
        if wrong := set(spec) - {"kind", *known}:
            raise ValueError(f"{spec['kind']} has no {sorted(wrong)}")
    return json.dumps(rules_, sort_keys=True)


def deserialize_rules(text: str) -> list[dict]:
    rules_ = json.loads(text)
    serialize_rules(rules_)
    return rules_


def apply_rules(g: Graph, rules_: list[dict], rounds: int = 1) -> Graph:
    """g after each of the rules in order, and all of them again in each further round, over what the round before added."""
    for _ in range(rounds):
        for spec in rules_:
            function, _ = RULES[spec["kind"]]
            g = function(g, **{k: v for k, v in spec.items() if k != "kind"})
        g = Graph(checkpoint(g.nodes), checkpoint(g.edges))
    return g
