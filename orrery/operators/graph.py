"""Property graphs: edge tables, k-hop reachability, weighted traversal, expansion of seeds, and fusion.

Edges are (src, edge_type, dst, weight). Each round is one join of the frontier with the edges; a node is
visited once for each seed, in the round that reaches it first. Rounds are few and each is an aggregate of
the frontier, which Spark combines before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.vectors import higher_is_nearer
from orrery.sources.files import kept

HOPS, DECAY, BUDGET = 1, 0.65, 64
FLOAT_MAX = 3.4028234663852886e38


def latest_edges(writes: DataFrame) -> DataFrame:
    """writes: src, edge_type, dst, weight, seq. The last write of each key."""
    return writes.groupBy("src", "edge_type", "dst").agg(F.max_by("weight", "seq").alias("weight"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct()


def counts(edges: DataFrame) -> DataFrame:
    """Nodes and edges; parallel edges count."""
    return nodes(edges).agg(F.count("*").alias("nodes")).join(edges.agg(F.count("*").alias("edges")), F.lit(True))  # a row each


def _followed(edges: DataFrame, edge_types: list[str] | None, visible: DataFrame | None) -> DataFrame:
    if edge_types is not None:
        edges = edges.where(F.col("edge_type").isin(edge_types))
    return edges if visible is None else edges.join(visible.select(F.col("name").alias("dst")).distinct(), "dst", "left_semi")


def k_hop(seeds: DataFrame, edges: DataFrame, hops: int, edge_type: str | None = None, visible: DataFrame | None = None) -> DataFrame:
    """seed, name, hops (the least) of all that outgoing edges reach; never the seed. Hidden nodes are not passed through."""
    # Parallel edges are left in: what is reached is made distinct, and that is less than all edges.
    steps = _followed(edges, None if edge_type is None else [edge_type], visible).select("src", "dst")
    if hops > 1:  # read once for each hop
        steps = kept(steps, "steps")
    frontier = seeds.select(F.col("name").alias("seed"), "name", F.lit(0).alias("hops")).distinct()
    found = frontier
    for hop in range(1, hops + 1):
        reached = frontier.join(steps, F.col("name") == F.col("src")).select("seed", F.col("dst").alias("name")).distinct()
        frontier = reached.join(found.select("seed", "name"), ["seed", "name"], "left_anti").withColumn("hops", F.lit(hop))
        if hop < hops:  # read by the next hop and by the answer
            frontier = kept(frontier, "frontier")
        found = found.unionByName(frontier)
    return found.where("hops > 0")


def expand(
    seeds: DataFrame, edges: DataFrame, hops: int = HOPS, decay: float = DECAY, budget: int = BUDGET, edge_types: list[str] | None = None, metric: str = "cosine", visible: DataFrame | None = None
) -> DataFrame:
    """Seeds (name, score) and what they reach: name, score, hops, via, nearest first.

    A reached node's score is its seed's, weakened by the decay for each hop (at its least distance); the best
    seed counts, not the sum. Seeds keep their own score. The first `budget` new nodes in the order of seed
    rank, hops and name are kept. Hidden seeds neither show nor lead anywhere.
    """
    high = higher_is_nearer(metric)
    if visible is not None:
        seeds = seeds.join(visible.select("name").distinct(), "name", "left_semi")
    best = seeds.groupBy("name").agg((F.max if high else F.min)("score").alias("score"))
    order = [F.col("score").desc() if high else F.col("score").asc(), F.col("name")]
    ranked = best.withColumn("seed_rank", F.row_number().over(Window.orderBy(*order)))  # seeds are a search result: few
    steps = _followed(edges, edge_types, visible)
    reached = k_hop(best, steps, hops).join(best.select("name"), "name", "left_anti")
    paths = reached.join(ranked.select(F.col("name").alias("seed"), F.col("score").alias("seed_score"), "seed_rank"), "seed")
    factor = F.pow(F.lit(float(decay)), F.col("hops"))
    far = F.col("seed_score") * factor if high else F.when(factor > 0, F.col("seed_score") / factor).otherwise(F.lit(FLOAT_MAX))
    paths = paths.withColumn("score", far)
    # The budget goes to new nodes by their first appearance.
    firsts = paths.groupBy("name").agg(F.min(F.struct("seed_rank", "hops")).alias("first"))
    kept = firsts.orderBy("first.seed_rank", "first.hops", "name").limit(budget).select("name")
    choose = F.struct((-F.col("score") if high else F.col("score")).alias("far"), "hops", "seed")
    new = paths.join(F.broadcast(kept), "name").groupBy("name").agg(F.min(choose).alias("b")).select("name", (-F.col("b.far") if high else F.col("b.far")).alias("score"), F.col("b.hops").cast("long").alias("hops"), F.col("b.seed").alias("via"))
    own = best.select("name", "score", F.lit(0).cast("long").alias("hops"), F.lit(None).cast("string").alias("via"))
    return own.unionByName(new).orderBy(*order)


def traverse(start: DataFrame, edges: DataFrame, hops: int, decay: float = 1.0, structural: list[str] | None = None, suppressed: Column | None = None, cap: int | None = None) -> DataFrame:
    """name, score, hops, path: weights multiply along a path, times the decay for each hop; the best path to each node.

    start: name. Structural edge types are not followed; suppressed edges are not passed.
    """
    if structural:
        edges = edges.where(~F.col("edge_type").isin(structural))
    if suppressed is not None:
        edges = edges.where(~suppressed)
    # Parallel edges are left in: the best path to a node takes the heaviest.
    steps = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    if hops > 1:
        steps = kept(steps, "steps")
    front = start.select("name", F.lit(1.0).alias("score"), F.lit(0).cast("long").alias("hops"), F.array("name").alias("path"))
    found = front
    for hop in range(1, hops + 1):
        on = front.join(steps, F.col("name") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        on = on.select(F.col("dst").alias("name"), (F.col("score") * F.col("weight") * decay).alias("score"), F.lit(hop).cast("long").alias("hops"), F.array_append("path", F.col("dst")).alias("path"))
        best = F.min_by(F.struct("score", "hops", "path"), F.struct(-F.col("score"), F.col("path")))
        front = on.groupBy("name").agg(best.alias("b")).select("name", "b.*")
        if hop < hops:
            front = kept(front, "front")
        found = found.unionByName(front)
    best = F.min_by(F.struct("score", "hops", "path"), F.struct(-F.col("score"), "hops", "path"))
    out = found.groupBy("name").agg(best.alias("b")).select("name", "b.*").where("hops > 0")
    return out if cap is None else out.orderBy(F.col("score").desc(), "name").limit(cap)


def suppressed_beside(reached: DataFrame, edges: DataFrame, suppressed: Column) -> DataFrame:
    """How many suppressed edges leave the nodes reached."""
    return edges.where(suppressed).join(reached.select(F.col("name").alias("src")), "src", "left_semi").agg(F.count("*").alias("suppressed"))


def strengths(travels: DataFrame, edges: DataFrame, now: Column, half_life_s: float, prior: float = 0.1) -> DataFrame:
    """edges with strength: travels (src, edge_type, dst, at) weigh less the older they are; a prior without any."""
    age = now.cast("double") - F.col("at").cast("double")
    sums = travels.groupBy("src", "edge_type", "dst").agg(F.sum(F.exp(-F.log(F.lit(2.0)) * age / half_life_s)).alias("strength"))
    return edges.join(sums, ["src", "edge_type", "dst"], "left").withColumn("strength", F.coalesce("strength", F.lit(prior)))


def fuse(lists: DataFrame, constant: int = 60, by: str | None = None) -> DataFrame:
    """Reciprocal rank fusion of lists (name, rank; any number of lists in one table), for each value of by."""
    return lists.groupBy(*([by] if by else []), "name").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))


def within_budget(ranked: DataFrame, tokens: str, most_tokens: int, most_fragments: int, order: list[Column], by: str | None = None) -> DataFrame:
    """The longest beginning of ranked rows (in each group of by) within both budgets."""
    if by is None:  # no more than that many rows can be within the budget
        ranked = ranked.orderBy(*order).limit(most_fragments)
    w = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy(*order)
    out = ranked.withColumn("position", F.row_number().over(w).cast("long")).withColumn("running_tokens", F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.where((F.col("running_tokens") <= most_tokens) & (F.col("position") <= most_fragments))


def assemble(
    seeds: DataFrame, edges: DataFrame, fragments: DataFrame, most_tokens: int, most_fragments: int, hops: int = HOPS, metric: str = "cosine", visible: DataFrame | None = None, suppressed: Column | None = None
) -> DataFrame:
    """Context for a question: what a search found (seeds: name, score), expanded along edges, with texts, within both budgets.

    fragments: name, text, tokens. name, text, score, hops, via, position, running_tokens and region_suppressed: whether
    suppressed edges, which are not followed, leave anything that was reached, so that the context may lack a region.
    """
    open_edges = edges if suppressed is None else edges.where(~suppressed)
    reached = kept(expand(seeds, open_edges, hops, metric=metric, visible=visible), "reached")
    missing = F.lit(False)
    if suppressed is not None:
        missing = F.lit(suppressed_beside(reached, edges, suppressed).first()["suppressed"] > 0)
    order = [F.col("score").desc() if higher_is_nearer(metric) else F.col("score").asc(), F.col("name").asc()]
    found = reached.join(fragments.select("name", "text", "tokens"), "name")
    return within_budget(found, "tokens", most_tokens, most_fragments, order).drop("tokens").withColumn("region_suppressed", missing)


def prompt(passages: DataFrame, by: str, text: str, order: str, question: Column) -> DataFrame:
    """Numbered passages and the question; one text for each group."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    lines = F.transform(rows, lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), r["t"]))
    return passages.groupBy(by).agg(lines.alias("lines")).select(by, F.concat(F.array_join("lines", "\n"), F.lit("\n\n"), question).alias("prompt"))
