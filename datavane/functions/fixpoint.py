"""Frontier loops: closures and components whose lineage is cut by a checkpoint in the cluster's shared folder each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def cut(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the folder of spark.checkpoint.dir; only a local master, as in tests, may do without one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared.base(df.sparkSession))
    return df.checkpoint()


def closure(edges: DataFrame, child: str = "child", parent: str = "parent", max_depth: int | None = None) -> DataFrame:
    """node, ancestor, depth: every ancestor at its shortest depth, up to max_depth if given; cycles end, and a node is never its
    own ancestor.

    Path doubling: when all pairs up to depth d are known, a pair at depth d + 1 to 2 d is one at exactly d followed by a known
    one, so the rounds follow the logarithm of the depth. Only the pairs at depth d are extended, and the
    shortest depth of a pair is combined before the shuffle."""
    e = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).where("node <> ancestor").distinct()
    seen, depth = cut(e.withColumn("depth", F.lit(1))), 1
    while max_depth is None or depth < max_depth:
        front = seen.where(F.col("depth") == depth)
        if front.isEmpty():
            break
        tail = seen.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("far"), F.col("depth").alias("more"))
        new = front.join(tail, "ancestor").select("node", F.col("far").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth")).where("node <> ancestor")
        seen, depth = cut(seen.unionByName(new).groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))), 2 * depth
    return seen if max_depth is None else seen.where(F.col("depth") <= max_depth)


def reach(edges: DataFrame, starts: DataFrame, child: str = "child", parent: str = "parent", max_depth: int | None = None) -> DataFrame:
    """request_id, node, depth: all that lies below the start (request_id, node) over child -> parent edges, the start left out;
    down to max_depth if given. Joins shuffle in every round (merge hints): a broadcast of each round's rows would pass the driver, round by round."""
    e = cut(edges.select(F.col(child).alias("c"), F.col(parent).alias("p")).where("c <> p").distinct())
    seen = front = cut(starts.select("request_id", "node", F.lit(0).alias("depth")).distinct())
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.hint("merge").join(e, F.col("node") == F.col("p")).select("request_id", F.col("c").alias("node")).distinct()
        front = cut(step.join(seen.hint("merge"), ["request_id", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front)) if depth % 8 == 0 else seen.unionByName(front)
    return seen.where("depth > 0")


def chain_tops(edges: DataFrame) -> DataFrame:
    """node, top, dist for nodes with exactly one parent (c, p): the nearest ancestor with none or several, and how far it is. Nodes whose
    chain ends in a cycle have no row.

    Pointers jump over pointers, so a chain of n nodes takes log n rounds; after as many rounds as the number of pointers has
    bits, what still points at a pointer goes in a circle."""
    one = edges.groupBy("c").agg(F.count("*").alias("n"), F.min("p").alias("p")).where("n = 1")
    now = cut(one.select(F.col("c").alias("node"), F.col("p").alias("top"), F.lit(1).cast("long").alias("dist")))
    for _ in range(now.count().bit_length() + 1):
        ahead = now.select(F.col("node").alias("top"), F.col("top").alias("next"), F.col("dist").alias("more"))
        moved = now.join(ahead, "top", "left")
        if moved.where("next is not null").isEmpty():
            return now
        now = cut(moved.select("node", F.coalesce("next", "top").alias("top"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist")))
    return cut(now.join(now.select(F.col("node").alias("top")), "top", "left_anti").select("node", "top", "dist"))


def longest_depth(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, depth for nodes (node, grounded): the longest chain down to grounded roots (depth 0), however long. Null where an
    ancestor is not in nodes, is a root that isn't grounded, or lies in a cycle.

    Chains of nodes with one parent are first cut short by chain_tops(), in rounds that follow the logarithm of their length. What is
    left are roots and nodes with several parents; such a node is resolved in the round after its last parent, each round
    handing on only the nodes of the one before, so these rounds follow the number of such nodes on a path."""
    e = cut(edges.select(F.col("child").alias("c"), F.col("parent").alias("p")).distinct())
    tops = chain_tops(e)
    need = e.groupBy("c").agg(F.count("*").alias("need"))
    todo = nodes.join(need, F.col("node") == F.col("c"), "left").select("node", "grounded", F.coalesce("need", F.lit(0)).alias("need"))
    known = front = cut(todo.where("need = 0 and grounded").select("node", F.lit(0).cast("long").alias("depth")))
    todo, rounds = cut(todo.where("need > 1").select("node", "need", F.lit(0).cast("long").alias("high"))), 0
    several = e.join(need.where("need > 1").select("c"), "c", "left_semi").join(need.where("need = 1").select(F.col("c").alias("p"), F.lit(True).alias("in_chain")), "p", "left")
    short = several.join(tops.select(F.col("node").alias("p"), "top", "dist"), "p", "left").where("in_chain is null or top is not null")
    core = cut(short.select("c", F.coalesce("top", "p").alias("p"), (F.lit(1) + F.coalesce("dist", F.lit(0))).alias("w")))
    while not front.isEmpty():
        rounds += 1
        up = core.join(front, F.col("p") == F.col("node")).groupBy(F.col("c").alias("node")).agg(F.count("*").alias("got"), F.max(F.col("depth") + F.col("w")).alias("d"))
        open_ = cut(todo.join(up, "node", "left").select("node", (F.col("need") - F.coalesce("got", F.lit(0))).alias("need"), F.greatest("high", "d").alias("high")))
        front = open_.where("need = 0").select("node", F.col("high").alias("depth"))
        todo = open_.where("need > 0")
        known = cut(known.unionByName(front)) if rounds % 8 == 0 else known.unionByName(front)
    chained = tops.join(known.select(F.col("node").alias("top"), "depth"), "top").select("node", (F.col("depth") + F.col("dist")).alias("depth"))
    return nodes.select("node").join(known.unionByName(chained), "node", "left").select("node", F.col("depth").cast("int").alias("depth"))


def components(nodes: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node): minima spread over the edges, and each round also jumps to the minimum's own
    minimum, so long chains take a logarithmic number of rounds."""
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    e = cut(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    now = cut(nodes.select(F.col("node"), F.col("node").alias("component")).distinct())
    while True:
        near = e.join(now, F.col("y") == F.col("node")).groupBy("x").agg(F.min("component").alias("m"))
        step = now.join(near, F.col("node") == F.col("x"), "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("was"))
        # hook the old root below the smaller component too, then jump
        hook = step.where("component < was").groupBy(F.col("was").alias("r")).agg(F.min("component").alias("h"))
        step = step.join(hook, F.col("component") == F.col("r"), "left").select("node", F.least("component", F.coalesce("h", "component")).alias("component"), "was")
        roots = step.select(F.col("node").alias("r2"), F.col("component").alias("c2"))
        step = cut(step.join(roots, F.col("component") == F.col("r2"), "left").select("node", F.least("component", F.coalesce("c2", "component")).alias("component"), "was"))
        if step.where("component <> was").isEmpty():
            return step.select("node", "component")
        now = step.select("node", "component")
