"""Categorical beliefs: posteriors, odds, entropy, credible sets; amplitudes and density matrices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.columns import chance
from weft.operators.paths import components

EPS = 1e-12


def normalized(weights: DataFrame) -> DataFrame:
    """concept, outcome, p: weights (concept, outcome, w) over their sum; alike where the sum is 0."""
    total = weights.groupBy("concept").agg(F.sum("w").alias("total"), F.count("*").alias("n"))
    return weights.join(total, "concept").select("concept", "outcome", F.when(F.col("total") > 0, F.col("w") / F.col("total")).otherwise(1 / F.col("n")).alias("p"))


def posterior(prior: DataFrame, evidence: DataFrame) -> DataFrame:
    """concept, outcome, prior, p: prior times the likelihoods of evidence (concept, seq, outcome, likelihood), normalised.

    Both are at least EPS. A chain of evidence multiplies, so its order doesn't matter; outcomes without evidence count as likelihood 1.
    """
    logs = evidence.groupBy("concept", "outcome").agg(F.sum(F.log(F.greatest("likelihood", F.lit(EPS)))).alias("l"))
    rows = prior.join(logs, ["concept", "outcome"], "left").select("concept", "outcome", F.col("p").alias("prior"), (F.log(F.greatest("p", F.lit(EPS))) + F.coalesce("l", F.lit(0.0))).alias("l"))
    top = rows.groupBy("concept").agg(F.max("l").alias("top"))
    scaled = rows.join(top, "concept").select("concept", "outcome", "prior", F.exp(F.col("l") - F.col("top")).alias("w"))
    total = scaled.groupBy("concept").agg(F.sum("w").alias("total"))
    return scaled.join(total, "concept").select("concept", "outcome", "prior", (F.col("w") / F.col("total")).alias("p"))


def divergence(found: DataFrame) -> DataFrame:
    """concept, kl (nats) of p from prior, and entropy (bits) of p."""
    p, q = F.greatest("p", F.lit(EPS)), F.greatest("prior", F.lit(EPS))
    return found.groupBy("concept").agg(F.sum(F.col("p") * F.log(p / q)).alias("kl"), (-F.sum(F.col("p") * F.log2(p))).alias("entropy"))


def map_estimate(found: DataFrame) -> DataFrame:
    """concept, outcome, p of the likeliest outcome; ties go to the first by name."""
    best = found.groupBy("concept").agg(F.min(F.struct((-F.col("p")).alias("p"), "outcome")).alias("m"))
    return best.select("concept", "m.outcome", (-F.col("m.p")).alias("p"))


def credible_set(found: DataFrame, level: float = 0.9) -> DataFrame:
    """concept, outcome, p: the likeliest outcomes, as few as reach the level together. A concept has few outcomes, so one task orders them."""
    w = Window.partitionBy("concept").orderBy(F.desc("p"), "outcome").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("before", F.coalesce(F.sum("p").over(w), F.lit(0.0))).where(F.col("before") < level).select("concept", "outcome", "p")


def odds(found: DataFrame, a: str, b: str) -> DataFrame:
    """concept, odds of outcome a to outcome b."""
    p = lambda x: F.max(F.when(F.col("outcome") == x, F.col("p")))
    return found.groupBy("concept").agg((p(a) / F.greatest(p(b), F.lit(EPS))).alias("odds"))


def born(amplitudes: DataFrame) -> DataFrame:
    """state_id, node_id, p: squared length of each amplitude (re, im) over the state's sum."""
    size = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    total = amplitudes.groupBy("state_id").agg(F.sum(size).alias("total"))
    return amplitudes.join(total, "state_id").select("state_id", "node_id", (size / F.col("total")).alias("p"))


def density_matrix(amplitudes: DataFrame) -> DataFrame:
    """state_id, i, j, re, im of the state's amplitudes, normalised, times their conjugates."""
    total = amplitudes.groupBy("state_id").agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("total"))
    side = lambda p: amplitudes.select("state_id", F.col("node_id").alias(p), F.col("re").alias(f"r{p}"), F.col("im").alias(f"m{p}"))
    rows = side("i").join(side("j"), "state_id").join(total, "state_id")
    return rows.select("state_id", "i", "j", ((F.col("ri") * F.col("rj") + F.col("mi") * F.col("mj")) / F.col("total")).alias("re"), ((F.col("mi") * F.col("rj") - F.col("ri") * F.col("mj")) / F.col("total")).alias("im"))


def interference(amplitudes: DataFrame) -> DataFrame:
    """node_id, together, apart, effect: the squared length of the sum of a node's amplitudes, the sum of their squared lengths, and the difference."""
    sums = amplitudes.groupBy("node_id").agg(F.sum("re").alias("re"), F.sum("im").alias("im"), F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("apart"), F.count("*").alias("n"))
    together = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    return sums.where("n > 1").select("node_id", together.alias("together"), "apart", (together - F.col("apart")).alias("effect"))


def size_of(re: str = "re", im: str = "im"):
    return F.col(re) * F.col(re) + F.col(im) * F.col(im)


def normal_amplitudes(amplitudes: DataFrame) -> DataFrame:
    """state_id, node_id, re, im with the squared lengths of each state adding up to 1; alike and real where all are 0."""
    total = amplitudes.groupBy("state_id").agg(F.sum(size_of()).alias("total"), F.count("*").alias("n"))
    rows = amplitudes.join(total, "state_id")
    part = lambda c, flat: F.when(F.col("total") > 0, F.col(c) / F.sqrt("total")).otherwise(flat).alias(c)
    return rows.select("state_id", "node_id", part("re", 1 / F.sqrt(F.col("n").cast("double"))), part("im", F.lit(0.0)))


def evolve_amplitudes(amplitudes: DataFrame, updates: DataFrame) -> DataFrame:
    """The amplitudes times updates(state_id, node_id, factor), 1 where there is none, normalised again."""
    rows = amplitudes.join(updates, ["state_id", "node_id"], "left").withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    return normal_amplitudes(rows.select("state_id", "node_id", (F.col("re") * F.col("factor")).alias("re"), (F.col("im") * F.col("factor")).alias("im")))


def evolve_unitary(amplitudes: DataFrame, matrix: DataFrame) -> DataFrame:
    """The amplitudes of each state after matrix(i, j, ur, ui), normalised: the new one of i is the sum over j of the entry times that of j."""
    rows = amplitudes.join(matrix, F.col("node_id") == F.col("j"))
    re, im = F.col("ur") * F.col("re") - F.col("ui") * F.col("im"), F.col("ur") * F.col("im") + F.col("ui") * F.col("re")
    return normal_amplitudes(rows.groupBy("state_id", F.col("i").alias("node_id")).agg(F.sum(re).alias("re"), F.sum(im).alias("im")))


def sample(amplitudes: DataFrame, seed: int = 0, weights: DataFrame | None = None) -> DataFrame:
    """state_id, node_id: one outcome of each state, by its probabilities times weights(node_id, weight), 1 where there is none.

    Outcomes stand in order of id; that is drawn in which a number hashed of seed and state falls.
    """
    p = born(amplitudes)
    if weights is not None:
        p = p.join(weights, "node_id", "left").withColumn("p", F.col("p") * F.coalesce("weight", F.lit(1.0))).drop("weight")
    up = Window.partitionBy("state_id").orderBy("node_id")
    rows = p.withColumn("upto", F.sum("p").over(up)).withColumn("all", F.sum("p").over(Window.partitionBy("state_id")))
    drawn = rows.where(F.col("upto") > chance(seed, "state_id") * F.col("all"))
    return drawn.groupBy("state_id").agg(F.min("node_id").alias("node_id"))


def partial_trace(rho: DataFrame, keep: int = 0) -> DataFrame:
    """state_id, i, j, re, im of one factor's density matrix; rows and columns of rho are named ``first|second``."""
    part = lambda c, k: F.split_part(F.col(c), F.lit("|"), F.lit(k + 1))
    rows = rho.where(part("i", 1 - keep) == part("j", 1 - keep))
    return rows.groupBy("state_id", part("i", keep).alias("i"), part("j", keep).alias("j")).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def von_neumann_entropy(rho: DataFrame) -> DataFrame:
    """state_id, entropy in bits of each density matrix (state_id, i, j, re, im): minus the sum of p log2 p over its eigenvalues. A matrix is in one task as a whole."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names = {x: k for k, x in enumerate(sorted(set(rows["i"]) | set(rows["j"])))}
        m = np.zeros((len(names), len(names)), complex)
        m[rows["i"].map(names), rows["j"].map(names)] = rows["re"] + 1j * rows["im"]
        p = np.linalg.eigvalsh(m)
        p = p[p > 1e-12]
        return pd.DataFrame({"state_id": [rows["state_id"].iloc[0]], "entropy": [float(-(p * np.log2(p)).sum())]})

    return rho.groupBy("state_id").applyInPandas(run, f"state_id {rho.schema['state_id'].dataType.simpleString()}, entropy double")


def triggers(amplitudes: DataFrame, stale: DataFrame | None = None) -> DataFrame:
    """state_id, fired (names, comma-joined), confidence, recommended, dominant: what speaks for drawing an outcome now.

    staleness (0.9; states in stale.state_id), single_outcome (1.0), dominance (0.8; one outcome has over 0.8 of the probability), convergence
    (0.7; an entropy under 0.3 bits of two outcomes or more). Recommended at a confidence of 0.5; dominant is null without one that dominates.
    """
    p = born(amplitudes)
    best = p.groupBy("state_id").agg(F.count("*").alias("n"), F.max("p").alias("top"), F.min(F.struct((-F.col("p")).alias("p"), "node_id")).alias("m"), (-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2("p")).otherwise(0.0))).alias("entropy"))
    best = best.join(stale.select("state_id", F.lit(True).alias("stale")).distinct(), "state_id", "left") if stale is not None else best.withColumn("stale", F.lit(False))
    rules = [("staleness", 0.9, F.coalesce("stale", F.lit(False))), ("single_outcome", 1.0, F.col("n") == 1), ("dominance", 0.8, F.col("top") > 0.8), ("convergence", 0.7, (F.col("entropy") < 0.3) & (F.col("n") >= 2))]
    fired = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, _, test in rules]))
    confidence = F.greatest(F.lit(0.0), *[F.when(test, value).otherwise(0.0) for _, value, test in rules])
    dominant = F.when((F.col("n") == 1) | (F.col("top") > 0.8), F.col("m.node_id"))
    return best.select("state_id", F.array_join(fired, ",").alias("fired"), confidence.alias("confidence"), (confidence >= 0.5).alias("recommended"), dominant.alias("dominant"))


def faded(amplitudes: DataFrame, ages: DataFrame, coherence: float) -> DataFrame:
    """state_id, total, decayed: what is left of each state's probability after ages(state_id, age) beyond the coherence time, falling by e per coherence time; decayed under 1e-12."""
    total = amplitudes.groupBy("state_id").agg(F.sum(size_of()).alias("all")).join(ages, "state_id")
    left = F.when(F.col("age") > coherence, F.col("all") * F.exp(-2 * F.col("age") / coherence)).otherwise(F.col("all"))
    return total.select("state_id", left.alias("total"), (left < 1e-12).alias("decayed"))


def uniform(weights: DataFrame) -> DataFrame:
    """concept, outcome, p: the same probability for each outcome of a concept."""
    n = weights.groupBy("concept").agg(F.count("*").alias("n"))
    return weights.join(n, "concept").select("concept", "outcome", (1 / F.col("n")).alias("p"))


def bayes_factor(evidence: DataFrame, a: str, b: str) -> DataFrame:
    """concept, factor: the product over evidence(concept, seq, outcome, likelihood) of the likelihood of a over that of b, EPS at least."""
    logs = lambda x: F.sum(F.when(F.col("outcome") == x, F.log(F.greatest("likelihood", F.lit(EPS)))).otherwise(0.0))
    return evidence.groupBy("concept").agg(F.exp(logs(a) - logs(b)).alias("factor"))


def correlated(outcomes: DataFrame, correlations: DataFrame) -> DataFrame:
    """state_id, node_id of the states that outcomes(state_id, node_id) predict: per correlations(a_state, a_node, b_state, b_node, strength) the strongest, ties by id."""
    rows = outcomes.join(correlations, (F.col("state_id") == F.col("a_state")) & (F.col("node_id") == F.col("a_node")))
    best = rows.groupBy("b_state").agg(F.min(F.struct((-F.col("strength")).alias("s"), "b_node")).alias("m"))
    return best.select(F.col("b_state").alias("state_id"), F.col("m.b_node").alias("node_id"), (-F.col("m.s")).alias("strength"))


def entangled_groups(links: DataFrame) -> DataFrame:
    """id, component: the states connected by links(a, b)."""
    nodes = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), nodes)


def insights(amplitudes: DataFrame, least: float = 0.5) -> DataFrame:
    """node_id, kind, effect: contradiction where the states cancel by ``least`` or more, reinforcement where they add up by as much."""
    rows = interference(amplitudes).where(F.abs("effect") >= least)
    return rows.select("node_id", F.when(F.col("effect") < 0, "contradiction").otherwise("reinforcement").alias("kind"), "effect")
