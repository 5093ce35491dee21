"""Lineage, vocabularies and connectivity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixpoint, shared


def shared_origins(closure: DataFrame, pairs: DataFrame) -> DataFrame:
    """request_id, origin, depth_a, depth_b for pairs (request_id, a, b): ancestors of both, neither of the two."""
    left = pairs.join(closure, F.col("a") == F.col("node")).select("request_id", "a", "b", F.col("ancestor").alias("origin"), F.col("depth").alias("depth_a"))
    right = pairs.join(closure, F.col("b") == F.col("node")).select("request_id", F.col("ancestor").alias("origin"), F.col("depth").alias("depth_b"))
    return left.join(right, ["request_id", "origin"]).where("origin <> a and origin <> b").select("request_id", "origin", "depth_a", "depth_b")


def nearest_origin(origins: DataFrame) -> DataFrame:
    """The origin of each request with the least nearer depth, then the least farther one, then the smallest name."""
    key = F.struct(F.least("depth_a", "depth_b").alias("n"), F.greatest("depth_a", "depth_b").alias("f"), "origin", "depth_a", "depth_b")
    return origins.groupBy("request_id").agg(F.min(key).alias("m")).select("request_id", "m.origin", "m.depth_a", "m.depth_b")


def lineage_neighbours(closure: DataFrame, nodes: DataFrame, block: int = 2048) -> DataFrame:
    """a < b of nodes (node) with a common ancestor-or-self, from the whole closure. Each pair is a row, so they are as many as the square of an
    origin's nodes; see the origin list instead where that is too much.

    Nodes that share an origin share its ancestors too, so an origin that has a root above it is left out. Pairs are made in tiles of `block`
    nodes by as many, each where the least of their common origins is, so no pair is made twice and none is shuffled."""
    roots = closure.select("ancestor").distinct().join(closure.select(F.col("node").alias("ancestor")), "ancestor", "left_anti")
    below = closure.join(roots, "ancestor", "left_semi").select(F.col("node").alias("ancestor")).distinct()
    own = closure.select("node", "ancestor").join(nodes.select("node"), "node", "left_semi").unionByName(nodes.select("node", F.col("node").alias("ancestor"))).distinct()
    own = shared.saved(own.join(below, "ancestor", "left_anti"), "origins")
    several = own.groupBy("node").agg(F.array_sort(F.collect_set("ancestor")).alias("all")).where(F.size("all") > 1)
    sizes = own.groupBy("ancestor").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = own.join(sizes, "ancestor").join(several, "node", "left").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    x = own.select("ancestor", F.col("node").alias("a"), F.col("all").alias("all_a"), F.col("mine").alias("i"), every.alias("j"))
    y = own.select("ancestor", F.col("node").alias("b"), F.col("all").alias("all_b"), F.col("mine").alias("j"), every.alias("i"))
    least = F.coalesce(F.col("ancestor") == F.array_min(F.array_intersect("all_a", "all_b")), F.lit(True))  # null: one side has a single origin
    n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return x.repartition(n, "ancestor", "i", "j").join(y.repartition(n, "ancestor", "i", "j"), ["ancestor", "i", "j"]).where((F.col("a") < F.col("b")) & least).select("a", "b")


def entailments(broader: DataFrame, related: DataFrame, in_scheme: DataFrame, exact: DataFrame, top_of: DataFrame | None = None) -> DataFrame:
    """rule, s, o: what follows from broader (narrower, broader), related (a, b), in_scheme (concept, scheme), exact (concept, external) and
    top_of (concept, scheme); a statement that is there already isn't repeated.

    The rules are stratified, so one pass in their order is the fixpoint: scheme membership reads the closure of broader and the
    tops, and no rule reads what membership or the matches add. Close matches are never chained."""
    trans = fixpoint.cut(fixpoint.closure(broader, "narrower", "broader").select(F.col("node").alias("s"), F.col("ancestor").alias("o")))
    back = broader.select(F.col("broader").alias("s"), F.col("narrower").alias("o")).distinct()
    sym = related.select(F.col("b").alias("s"), F.col("a").alias("o")).join(related.select(F.col("a").alias("s"), F.col("b").alias("o")), ["s", "o"], "left_anti").distinct()
    member = in_scheme.select(F.col("concept").alias("s"), F.col("scheme").alias("o"))
    tops = in_scheme if top_of is None else top_of
    from_top = tops.select(F.col("concept").alias("s"), F.col("scheme").alias("o")).distinct().join(member, ["s", "o"], "left_anti")
    inherited = trans.join(tops, F.col("o") == F.col("concept")).select("s", F.col("scheme").alias("o")).distinct().join(member, ["s", "o"], "left_anti")
    # a concept's matches are few, but a hot concept may have very many: both sides are shuffled for the join, so it can be split
    x, y = exact.select("concept", F.col("external").alias("s")), exact.select("concept", F.col("external").alias("o"))
    bridge = x.join(y, "concept").where("s <> o").select("s", "o").distinct()
    back_match = exact.select(F.col("external").alias("s"), F.col("concept").alias("o")).distinct()
    named = [("broaderTransitive", trans), ("narrower", back), ("related", sym), ("inScheme", inherited), ("exactMatch", bridge), ("exactMatchInverse", back_match)]
    if top_of is not None:
        has_top = tops.select(F.col("scheme").alias("s"), F.col("concept").alias("o")).distinct()
        named += [("inSchemeFromTop", from_top), ("hasTopConcept", has_top)]
    out = None
    for rule, rows in named:
        rows = rows.select(F.lit(rule).alias("rule"), F.col("s").cast("string").alias("s"), F.col("o").cast("string").alias("o"))
        out = rows if out is None else out.unionByName(rows)
    return out


def materialised(rows: DataFrame, records: DataFrame, name: str = "entailed") -> tuple[DataFrame, DataFrame]:
    """(the entailments as a written table, rule and n of each): the rebuild of what is stored beside the asserted statements. An error
    where a catalogue record (iri) is the subject of one: entailments speak of the vocabulary only."""
    kept = shared.saved(rows, name)
    bad = guard(kept, records).limit(1).collect()  # one row at most
    if bad:
        raise ValueError(f"rule {bad[0].rule} would write on a catalogue record: {bad[0].s}")
    return kept, kept.groupBy("rule").agg(F.count("*").alias("n"))


def guard(rows: DataFrame, records: DataFrame) -> DataFrame:
    """Entailments whose subject is a catalogue record; there must be none."""
    return rows.join(records.select(F.col("iri").alias("s")), "s", "left_semi")


def owned(contains: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, owner: the root that reaches a node over containment(parent, child), null for ancillary nodes."""
    down = fixpoint.reach(contains, roots.select(F.col("root").alias("request_id"), F.col("root").alias("node")))
    own = down.groupBy("node").agg(F.min("request_id").alias("owner")).unionByName(roots.select(F.col("root").alias("node"), F.col("root").alias("owner")))
    return nodes.join(own.groupBy("node").agg(F.min("owner").alias("owner")), "node", "left").select("node", "owner")


def largest_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, of the component with most nodes; ties go to the one with the smallest node."""
    comp = fixpoint.cut(fixpoint.components(nodes, edges))
    best = comp.groupBy("component").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", (-F.col("component")).alias("neg"))).alias("m")).select((-F.col("m.neg")).alias("component"))
    return comp.join(F.broadcast(best), "component", "left_semi").select("node")  # one row


def slack(buses: DataFrame, arcs: DataFrame) -> DataFrame:
    """The bus with the highest voltage, then most line ends, then the smallest id."""
    ends = arcs.select(F.explode(F.array("bus0", "bus1")).alias("bus_id")).groupBy("bus_id").agg(F.count("*").alias("degree"))
    d = buses.join(ends, "bus_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return d.agg(F.max(F.struct("voltage", "degree", (-F.col("bus_id")).alias("neg"))).alias("m")).select((-F.col("m.neg")).alias("bus_id"), "m.voltage", "m.degree")


def assumption_diff(fork: DataFrame, parent: DataFrame) -> DataFrame:
    """path, value, parent_value, status: set (only in the fork), dropped, changed or inherited."""
    a, b = fork.select("path", "value", F.lit(1).alias("x")), parent.select("path", F.col("value").alias("parent_value"), F.lit(1).alias("y"))
    status = F.when(F.col("y").isNull(), "set").when(F.col("x").isNull(), "dropped").when(F.col("value").eqNullSafe(F.col("parent_value")), "inherited").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", "value", "parent_value", status.alias("status"))
