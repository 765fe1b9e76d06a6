"""Spreading activation, rank fusion, vector similarity, recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.plans.graph import Graph
from weft.plans.iterate import checkpoint, rounds


def spread(g: Graph, seeds: DataFrame, n: int = 5, decay: float = 0.85, least: float = 0.01, back: float = 0.3, directional: bool = True) -> DataFrame:
    """id, energy: seeds (id, energy) spread for n rounds over each edge by its weight and decay, in equal parts to the other side.

    From source to target at full rate, back at ``back``; or, not directional, to all other members. After each round
    energies are scaled to the former maximum, and those under least go.
    """
    if directional:
        side = F.array(F.struct(F.col("source_ids").alias("a"), F.col("target_ids").alias("b"), F.lit(1.0).alias("r")), F.struct(F.array_except("target_ids", "source_ids").alias("a"), F.col("source_ids").alias("b"), F.lit(back).alias("r")))
        rows = g.edges.select("weight", F.explode(side).alias("s")).select(F.explode("s.a").alias("from"), F.col("s.b").alias("to"), (F.col("weight") * F.col("s.r")).alias("w"))
    else:
        ids = F.array_union("source_ids", "target_ids")
        rows = g.edges.select("weight", ids.alias("ids"), F.explode(ids).alias("from")).select("from", F.array_except("ids", F.array("from")).alias("to"), F.col("weight").alias("w"))
    rows = rows.where(F.size("to") > 0)
    rate = checkpoint(rows.select("from", F.explode("to").alias("id"), (F.col("w") * decay / F.size("to")).alias("w")).groupBy("from", "id").agg(F.sum("w").alias("w")))

    def step(now: DataFrame) -> DataFrame:
        more = now.join(rate, now["id"] == F.col("from")).select(rate["id"], (F.col("energy") * F.col("w")).alias("energy"))
        new = checkpoint(now.unionByName(more).groupBy("id").agg(F.sum("energy").alias("energy")))
        scale = now.agg(F.max("energy").alias("old")).join(F.broadcast(new.agg(F.max("energy").alias("new"))))
        return new.join(F.broadcast(scale)).select("id", (F.col("energy") * F.col("old") / F.col("new")).alias("energy")).where(F.col("energy") >= least)

    return rounds(checkpoint(seeds.select("id", "energy")), step, n, 1)


def diffuse(g: Graph, seeds: DataFrame, mode: str = "linear", n: int = 5, decay: float = 0.85, least: float = 0.01) -> DataFrame:
    """id, energy: an edge passes on what its gate lets through, in equal parts to its targets.

    linear: the mean over the sources; and: the same if all are active; or: the most; majority: the mean of the active if they
    are more than half. Energies under least go after each round.
    """
    sides = g.edges.where((F.size("source_ids") > 0) & (F.size("target_ids") > 0)).select("edge_id", "source_ids", "target_ids", "weight")
    sources = checkpoint(sides.select("edge_id", F.explode("source_ids").alias("id"), F.size("source_ids").alias("all")))
    targets = checkpoint(sides.select("edge_id", F.explode("target_ids").alias("id"), (F.col("weight") * decay / F.size("target_ids")).alias("w")))
    total, active, size = F.sum("energy"), F.count("*"), F.max("all")
    gate = {"linear": total / size, "and": F.when(active == size, total / size), "or": F.max("energy"), "majority": F.when(active > F.floor(size / 2), total / active)}[mode]

    def step(now: DataFrame) -> DataFrame:
        passed = sources.join(now.where("energy > 0"), "id").groupBy("edge_id").agg(gate.alias("g")).where("g is not null")
        more = passed.join(targets, "edge_id").select("id", (F.col("g") * F.col("w")).alias("energy"))
        return now.unionByName(more).groupBy("id").agg(F.sum("energy").alias("energy")).where(F.col("energy") >= least)

    return rounds(seeds.select("id", "energy"), step, n, 1)


def rank_fusion(ranked: DataFrame, k: int = 60) -> DataFrame:
    """id, score: the sum over lists of 1 / (k + rank + 1), rank from 0 by descending score, ties by id. ranked: list, id, score."""
    w = Window.partitionBy("list").orderBy(F.desc("score"), "id")
    return ranked.withColumn("r", F.row_number().over(w)).groupBy("id").agg(F.sum(1 / (k + F.col("r"))).alias("score"))


def retrieve(g: Graph, seeds: DataFrame, vectors: DataFrame | None = None, top_k: int = 10, n: int = 3, weights: dict[str, float] | None = None) -> DataFrame:
    """id, score: the top_k that activation from seeds.id (n rounds) and similarity to them by vectors(id, embedding) find, without the seeds.

    Fused by reciprocal ranks, or, with weights (of activation and similarity), by their weighted sum. Each list has 3 top_k at most; ties by id.
    """
    best = lambda rows: rows.join(seeds.select("id"), "id", "left_anti").orderBy(F.desc("score"), "id").limit(3 * top_k)
    lists = {"activation": best(spread(g, seeds.select("id", F.lit(1.0).alias("energy")), n).select("id", F.col("energy").alias("score")))}
    if vectors is not None:
        own = vectors.join(seeds.select("id"), "id", "left_semi")
        lists["similarity"] = best(similar(vectors, own, 3 * top_k, "id").groupBy("id").agg(F.max("cosine").alias("score")))
    ranked = None
    for name, rows in lists.items():
        rows = rows.withColumn("list", F.lit(name))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    if weights is None:
        found = rank_fusion(ranked)
    else:
        weight = F.create_map(*[F.lit(x) for k in lists for x in (k, float(weights.get(k, 0.0)))])
        found = ranked.groupBy("id").agg(F.sum(F.col("score") * weight[F.col("list")]).alias("score"))
    return found.orderBy(F.desc("score"), "id").limit(top_k)


def train_weights(records: DataFrame, features: list[str], rate: float = 0.1, epochs: int = 50) -> dict[str, float]:
    """Weights of features by gradient descent on the squared error to records.relevant (0 or 1), from equal ones on, then divided by the sum of their absolute values.

    The gradient needs only the features' second moments, which one aggregation over all records gives; the epochs run on these few numbers.
    """
    pairs = [(a, b) for a in features for b in features if a <= b]
    sums = [F.avg(F.col(a) * F.col(b)).alias(f"{a}*{b}") for a, b in pairs] + [F.avg(F.col(a) * F.col("relevant")).alias(a) for a in features]
    row = records.agg(*sums, F.count("*").alias("n")).first()
    w = dict.fromkeys(features, 1 / len(features))
    if row["n"]:
        for _ in range(epochs):
            slope = {a: sum(w[b] * row["*".join(sorted((a, b)))] for b in features) - row[a] for a in features}
            w = {a: w[a] - rate * slope[a] for a in features}
    total = sum(map(abs, w.values()))
    return {a: x / total if total else x for a, x in w.items()}


def feature_score(features: DataFrame, weights: dict[str, float]) -> DataFrame:
    """features with score, their weighted sum."""
    return features.withColumn("score", sum((F.col(a) * w for a, w in weights.items()), F.lit(0.0)))


def vector_pairs(vectors: DataFrame, pairs: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """a, b, cosine, distance of the given pairs(a, b): the product of the unit vectors and the length of their difference."""
    u = unit(vectors, column)
    side = lambda c: u.select(F.col(id_col).alias(c), F.col(column).alias(f"v{c}"))
    rows = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    apart = F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("a", "b", dot(F.col("va"), F.col("vb")).alias("cosine"), F.sqrt(apart).alias("distance"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vectors with the column as doubles of length 1; zero vectors stay."""
    size = F.sqrt(dot(F.col(column), F.col(column)))
    return vectors.withColumn("_size", size).withColumn(column, F.transform(column, lambda x: x.cast("double") / F.when(F.col("_size") > 0, F.col("_size")).otherwise(1.0))).drop("_size")


def similar(vectors: DataFrame, queries: DataFrame, top_k: int = 10, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query, id, rank, cosine: the top_k others nearest to each query, all vectors compared; ties by id."""
    u = unit(vectors, column).select(F.col(id_col).alias("id"), F.col(column).alias("embedding"))
    q = unit(queries, column).select(F.col(id_col).alias("query"), F.col(column).alias("embedding"))
    return nearest(u, q, F.array("query"), top_k).select("query", "id", "rank", "cosine")


def nearest(vectors: DataFrame, queries: DataFrame, without, top_k: int = 1, parts: int = 32, block: int = 256) -> DataFrame:
    """queries' columns without embedding, id, rank, cosine: the top_k vectors(id, embedding) nearest to each of queries(query, embedding, ..); ``without``: an array of ids left out.

    Vectors are dealt into parts and queries into blocks of about ``block``; each block meets each part, in a shuffle, so no side has to fit into
    a task, and each part keeps its own top_k of a query before these are combined.
    """
    blocks = max(1, -(-queries.count() // block))
    own = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    grouped = own.withColumn("out", without).groupBy("part", "block").agg(F.collect_list(F.struct(*[c for c in queries.columns if c != "embedding"], "out", F.col("embedding").alias("q"))).alias("qs"))
    dealt = vectors.select("id", F.col("embedding").alias("v"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
    rows = dealt.join(grouped, "part").select("id", "v", "part", F.explode("qs").alias("x")).where(~F.array_contains("x.out", F.col("id")))
    scored = rows.select("part", *[F.col(f"x.{c}") for c in queries.columns if c != "embedding"], "id", dot(F.col("v"), F.col("x.q")).alias("cosine"))
    best = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("cosine"), "id"))
    near = scored.withColumn("rank", best("query", "part")).where(F.col("rank") <= top_k)
    return near.withColumn("rank", best("query").cast("bigint")).where(F.col("rank") <= top_k).drop("part")


def analogy(vectors: DataFrame, a: int, b: int, c: int, top_k: int = 5, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id, cosine: the top_k nearest to c + b - a, without these three."""
    u = unit(vectors, column).select(F.col(id_col).alias("id"), F.col(column).alias("v"))
    pick = lambda k: F.max(F.when(F.col("id") == k, F.col("v")))
    goal = u.where(F.col("id").isin(a, b, c)).agg(pick(a).alias("a"), pick(b).alias("b"), pick(c).alias("c"))
    goal = goal.select(F.zip_with(F.zip_with("c", "b", lambda x, y: x + y), F.col("a"), lambda x, y: x - y).alias("embedding"))
    goal = unit(goal, "embedding").select(F.col("embedding").alias("q"))
    return u.where(~F.col("id").isin(a, b, c)).join(F.broadcast(goal)).select("id", dot(F.col("v"), F.col("q")).alias("cosine")).orderBy(F.desc("cosine"), "id").limit(top_k)


def recency(touches: DataFrame, decay: float = 0.9, most: float = 100.0) -> DataFrame:
    """id, score: in order of time, score becomes score * decay + 1, most at most. touches: id, ts.

    Without the cap the score is a weighted count, weights falling by decay from the last touch on; as that sum stays under
    1 / (1 - decay), the cap only counts below it.
    """
    w = Window.partitionBy("id").orderBy(F.desc("ts"))
    rows = touches.withColumn("age", F.row_number().over(w) - 1)
    return rows.groupBy("id").agg(F.least(F.sum(F.pow(F.lit(decay), F.col("age"))), F.lit(most)).alias("score"))


def hash_vectors(texts: DataFrame, size: int = 16, seed: int = 0, column: str = "text") -> DataFrame:
    """texts with embedding: a vector of length 1 that only the seed and the text decide."""
    from weft.functions.columns import chance

    raw = F.array(*[2 * chance(seed, F.lit(k), F.col(column)) - 1 for k in range(size)])
    return unit(texts.withColumn("embedding", raw))


def _blocks(vectors: DataFrame, id_col: str, column: str, block: int) -> DataFrame:
    """own, dim, ids, data: unit vectors of one dimension, about ``block`` in a row, one after another; written once. Vectors with a null, which have no cosine, are left out."""
    n = max(1, -(-vectors.count() // block))
    whole = F.col(column).isNotNull() & ~F.exists(F.coalesce(column, F.array()), lambda x: x.isNull())
    u = unit(vectors.where(whole), column).select(F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias("own"), F.size(column).alias("dim"), F.struct(F.col(id_col).alias("id"), F.col(column).alias("v")).alias("x"))
    rows = u.groupBy("own", "dim").agg(F.collect_list("x").alias("rows"))
    return checkpoint(rows.select("own", "dim", F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("data")).repartition(min(n, 16), "own"))


def _meetings(vectors: DataFrame, least: float, top_k: int | None, id_col: str, column: str, block: int) -> DataFrame:
    """a, b, cosine of pairs of ``least`` or more; a < b, or, with top_k, in both orders, each part of the table giving the top_k of each a that it finds.

    Blocks meet in a product of partitions, which reads what was written and shuffles nothing. Single precision tells which pairs can reach the bound; their
    cosines are then summed in double, in the order of places, so that equal vectors have equal ones.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    blocks = _blocks(vectors, id_col, column, block)
    side = lambda c: blocks.select(*[F.col(x).alias(f"{x}_{c}") for x in ("own", "dim", "ids", "data")])
    # no equality on dim, so that the two sides are not shuffled by it
    both = side("a").crossJoin(side("b")).where("dim_a <= dim_b and dim_a >= dim_b" + (" and own_a <= own_b" if top_k is None else ""))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def table(a, b, c):
            return pa.RecordBatch.from_arrays([a, b, pa.array(c, pa.float64())], ["a", "b", "cosine"])

        def best(rows):
            rows = pa.Table.from_batches(rows).combine_chunks()
            order = pc.sort_indices(rows.append_column("key", pc.if_else(pc.is_nan(rows["cosine"]), float("inf"), rows["cosine"])), [("a", "ascending"), ("key", "descending"), ("b", "ascending")])
            rows = rows.take(order).combine_chunks()
            ids = pc.rank(rows["a"], tiebreaker="dense").to_numpy()
            place = np.arange(len(ids)) - np.searchsorted(ids, ids)
            return rows.filter(pa.array(place < top_k)).combine_chunks().to_batches()

        now, pool, held = None, [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                at = {x: batch.column(i)[k] for i, x in enumerate(batch.schema.names)}
                dim, ids, own = at["dim_a"].as_py(), (at["ids_a"].values, at["ids_b"].values), at["own_a"].as_py()
                a, b = (at[f"data_{c}"].values.to_numpy().reshape(len(i), dim) for c, i in zip("ab", ids, strict=True))
                if top_k is not None and now is not None and (own, dim) != now:
                    yield from best(pool)
                    pool, held = [], 0
                now = (own, dim)
                low = least - 1e-5 - 2e-7 * dim
                near = a.astype("float32") @ b.astype("float32").T
                if top_k is not None and near.shape[1] > top_k + 1:
                    # a vector may meet itself, so one more than top_k is kept
                    own_low = np.partition(np.where(np.isnan(near), np.inf, near), near.shape[1] - top_k - 1, axis=1)[:, near.shape[1] - top_k - 1] - 2e-5 - 4e-7 * dim
                    i, j = np.nonzero(~(near < np.maximum(low, own_low)[:, None]))
                else:
                    i, j = np.nonzero(~(near < low))
                cosine = np.zeros(len(i))
                ta, tb = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
                for d in range(dim):
                    cosine += ta[d][i] * tb[d][j]
                keep = ~(cosine < least)
                left, right, cosine = ids[0].take(pa.array(i[keep])), ids[1].take(pa.array(j[keep])), cosine[keep]
                if top_k is not None:
                    other = pc.not_equal(left, right)
                    pool.append(table(left.filter(other), right.filter(other), pa.array(cosine).filter(other)))
                    held += pool[-1].num_rows
                    if held > 500_000:
                        pool = best(pool)
                        held = sum(x.num_rows for x in pool)
                    continue
                ordered = pc.less(left, right)
                if at["own_b"].as_py() == own:
                    yield table(left.filter(ordered), right.filter(ordered), pa.array(cosine).filter(ordered))
                else:
                    yield table(pc.if_else(ordered, left, right), pc.if_else(ordered, right, left), cosine)
        if top_k is not None and pool:
            yield from best(pool)

    return both.mapInArrow(run, f"a {kind}, b {kind}, cosine double")


def similar_pairs(vectors: DataFrame, least: float, id_col: str = "vec_id", column: str = "embedding", block: int = 1024) -> DataFrame:
    """a < b, cosine of all pairs of vectors with a cosine of ``least`` or more.

    Vectors are dealt into blocks of about ``block`` by a hash. Each two blocks meet once, in one task and in that only, so that all pairs are
    compared and no more than two blocks are in memory: work grows with the square of the table, as no order prunes vectors of any direction.
    """
    return _meetings(vectors, least, None, id_col, column, block)


def semantic_edges(vectors: DataFrame, top_k: int = 10, least: float = 0.7, id_col: str = "vec_id", column: str = "embedding", block: int = 1024) -> DataFrame:
    """src, tgt, weight: from each vector to its top_k nearest with a cosine of ``least`` or more; ties by id."""
    found = _meetings(vectors, least, top_k, id_col, column, block)
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top_k).select(F.col("a").alias("src"), F.col("b").alias("tgt"), F.col("cosine").alias("weight"))


def modality_profile(g: Graph, field: str) -> DataFrame:
    """id, tag, n, weight: the edges that lead from a node to nodes with a tag (a word of their field): how many, and their weights together."""
    tags = g.nodes.select(F.col("id").alias("tgt"), F.explode(F.array_distinct(F.split(F.col("data")[field], r"[\s,]+"))).alias("tag"))
    return g.pairs.join(tags, "tgt").groupBy(F.col("src").alias("id"), "tag").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def modality_gaps(g: Graph, ids: DataFrame, field: str, expected: list[str]) -> DataFrame:
    """id, tag: the expected tags that no edge of a node leads to."""
    want = ids.select("id", F.explode(F.array(*[F.lit(t) for t in expected])).alias("tag"))
    return want.join(modality_profile(g, field).select("id", "tag"), ["id", "tag"], "left_anti")


def cross_modality_edges(g: Graph, field: str) -> DataFrame:
    """id, n: how many edges lead from a node to a node that has no tag in common with it."""
    tags = g.nodes.select("id", F.split(F.col("data")[field], r"[\s,]+").alias("tags"))
    side = lambda c: tags.select(F.col("id").alias(c), F.col("tags").alias(f"t{c}"))
    rows = g.pairs.join(side("src"), "src").join(side("tgt"), "tgt").where(~F.arrays_overlap("tsrc", "ttgt"))
    return rows.groupBy(F.col("src").alias("id")).agg(F.countDistinct("edge_id").alias("n"))


def fuse_modalities(g: Graph, candidates: DataFrame, field: str, weights: dict[str, float], k: int = 60) -> DataFrame:
    """id, score: candidates.id by weighted reciprocal ranks, a list for each tag by the weight of a node's edges to it; ties by id."""
    rows = modality_profile(g, field).where(F.col("tag").isin(*weights)).join(candidates.select("id"), "id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc(F.round("weight", 9)), "id"))
    w = F.create_map(*[F.lit(x) for t, v in weights.items() for x in (t, float(v))])
    return rows.withColumn("r", rank).groupBy("id").agg(F.sum(w[F.col("tag")] / (k + F.col("r"))).alias("score"))
