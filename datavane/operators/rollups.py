"""Counts and summaries of a catalogue, each one aggregation over the tables it is given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Health from worst to best.
HEALTH = ("unreachable", "degraded", "redirected", "verified")


def level_matrix(datasets: DataFrame, by: str = "data_domain", level: str = "level", levels: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """by, l1, l2, ...: datasets of each value and completeness level, in one pass."""
    return datasets.groupBy(by).agg(*[F.count_if(F.col(level) == i).alias(f"l{i}") for i in levels])


def unplaced(rows: DataFrame, value: str, scheme: DataFrame) -> DataFrame:
    """value, n: rows whose value no concept of scheme (concept) has; nulls are not values."""
    known = scheme.select(F.col("concept").alias(value)).distinct()
    return rows.where(F.col(value).isNotNull()).join(known, value, "left_anti").groupBy(value).agg(F.count("*").alias("n"))


def counts_of_all(values: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """value, n for every listed value, 0 where no row has it."""
    n = rows.groupBy(value).agg(F.count("*").alias("n"))
    return values.select(value).distinct().join(n, value, "left").select(value, F.coalesce("n", F.lit(0)).alias("n"))


def members_per(memberships: DataFrame, member: str = "member", id_col: str = "id") -> DataFrame:
    """member, n: distinct records of each member; of concepts, of analyses, of lineage parents (inbound links)."""
    return memberships.groupBy(member).agg(F.count_distinct(id_col).alias("n"))


def concept_cards(broader: DataFrame, labels: DataFrame | None = None, matches: DataFrame | None = None) -> DataFrame:
    """concept, broader, narrower, alt_labels, external: sorted distinct arrays, empty where there are none. broader: narrower,
    broader; labels: concept, label; matches: concept, external."""
    long = broader.select(F.col("broader").alias("concept"), F.lit("narrower").alias("k"), F.col("narrower").alias("v"))
    long = long.unionByName(broader.select(F.col("narrower").alias("concept"), F.lit("broader").alias("k"), F.col("broader").alias("v")))
    for rows, kind, column in ((labels, "alt_labels", "label"), (matches, "external", "external")):
        if rows is not None:
            long = long.unionByName(rows.select("concept", F.lit(kind).alias("k"), F.col(column).alias("v")))
    kinds = ("broader", "narrower", "alt_labels", "external")
    return long.groupBy("concept").agg(*[F.array_sort(F.collect_set(F.when(F.col("k") == x, F.col("v")))).alias(x) for x in kinds])


def by_place(datasets: DataFrame, place: str, label: str = "title", id_col: str = "id") -> DataFrame:
    """place, n, label: records of each place, and the label of the one with the smallest id."""
    return datasets.groupBy(place).agg(F.count("*").alias("n"), F.min_by(label, id_col).alias("label"))


def acceptance(records: DataFrame, by: str, accepted: Column) -> DataFrame:
    """by, accepted, rejected; a record whose test is null counts as neither."""
    return records.groupBy(by).agg(F.count_if(accepted).alias("accepted"), F.count_if(~accepted).alias("rejected"))


def state_counts(rows: DataFrame, state: str) -> DataFrame:
    return rows.groupBy(state).agg(F.count("*").alias("n"))


def worst_health(distributions: DataFrame) -> DataFrame:
    """dataset_id, worst, none_left: the worst health of a dataset's distributions, and whether none can be reached."""
    rank = F.array_position(F.array(*map(F.lit, HEALTH)), F.col("health"))
    return distributions.groupBy("dataset_id").agg(F.min_by("health", rank).alias("worst"), F.every(F.col("health") == "unreachable").alias("none_left"))


def distribution_rollup(distributions: DataFrame) -> DataFrame:
    """dataset_id, formats (sorted array), ranges, bulk, n."""
    return distributions.groupBy("dataset_id").agg(F.array_sort(F.collect_set("media_type")).alias("formats"), F.bool_or("sliceable").alias("ranges"), F.bool_or("bulk").alias("bulk"), F.count("*").alias("n"))


def run_rollup(records: DataFrame, run: str, outcome: str, at: str, position: str, error: str = "error", unchanged: str = "unchanged") -> DataFrame:
    """run, seen, errors, unchanged, last_good, checkpoint: what a harvest run saw, when it last went well, and where it got to."""
    bad = F.col(outcome) == error
    return records.groupBy(run).agg(F.count("*").alias("seen"), F.count_if(bad).alias("errors"), F.count_if(F.col(outcome) == unchanged).alias("unchanged"), F.max(F.when(~bad, F.col(at))).alias("last_good"), F.max(position).alias("checkpoint"))


def operating_totals(points: DataFrame, by: str, demand: str, online: Column, digits: int = 2) -> DataFrame:
    """by, demand, online: total demand of an operating point, and how many units run."""
    return points.groupBy(by).agg(F.round(F.sum(demand), digits).alias("demand"), F.count_if(online).alias("online"))


def element_counts(**tables: DataFrame) -> DataFrame:
    """kind, n of each named table, also of empty ones."""
    out = None
    for kind, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def status(datasets: DataFrame, state: str = "review_state", draft: str = "draft") -> DataFrame:
    """metric, value: records in the catalogue and drafts."""
    return datasets.groupBy(F.when(F.col(state) == draft, "draft").otherwise("catalog").alias("metric")).agg(F.count("*").alias("value"))


def domain_summary(datasets: DataFrame, by: str = "data_domain", after: int | None = None) -> DataFrame:
    """by, n, first: records of a domain and their first title; after: only ids beyond it, where a run resumes."""
    rows = datasets if after is None else datasets.where(F.col("id") > after)
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.min("title").alias("first"))


def publisher_coverage(candidates: DataFrame, indexed: DataFrame) -> DataFrame:
    """publisher, candidates, indexed: how many of a publisher's records (publisher, id) the index (id) holds."""
    seen = indexed.select("id").distinct().withColumn("__s", F.lit(1))
    return candidates.join(seen, "id", "left").groupBy("publisher").agg(F.count("*").alias("candidates"), F.count("__s").alias("indexed"))


def blockers(violations: DataFrame, n: int = 8) -> DataFrame:
    """path, n: the paths that most violations name."""
    return violations.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(n)


def audit(events: DataFrame, kind: str, at: str, kinds: list[str]) -> DataFrame:
    """kind, n, newest of the kinds that an audit asks for."""
    return events.where(F.col(kind).isin(*kinds)).groupBy(kind).agg(F.count("*").alias("n"), F.max(at).alias("newest"))


def lag_seconds(events: DataFrame, at: str, done: Column) -> DataFrame:
    """lag: seconds between the newest event and the newest that is done."""
    second = lambda c: F.unix_seconds(c.cast("timestamp"))
    return events.agg((second(F.max(at)) - second(F.max(F.when(done, F.col(at))))).alias("lag"))


def active(rows: DataFrame, by: str, at: str, since, where: Column) -> DataFrame:
    """by, plans: rows of each principal that are still active."""
    return rows.where(where & (F.col(at) > F.lit(since))).groupBy(by).agg(F.count("*").alias("plans"))


def acts_for(datasets: DataFrame, publisher: str = "publisher", iri: str = "iri") -> DataFrame:
    """publisher, acts_for: sorted titles of the records with a web identifier that a publisher keeps."""
    return datasets.where(F.col(iri).rlike("^https?://")).groupBy(publisher).agg(F.array_sort(F.collect_set("title")).alias("acts_for"))


def bounds_meet(points: DataFrame, by: str, x: str, y: str, box: tuple[float, float, float, float]) -> DataFrame:
    """by of rings whose bounding box meets (west, south, east, north); the extremes are combined before the shuffle."""
    w, s, e, n = box
    d = points.groupBy(by).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    return d.where((F.col("x0") <= e) & (F.col("x1") >= w) & (F.col("y0") <= n) & (F.col("y1") >= s)).select(by)
