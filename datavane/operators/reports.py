"""Reports on a catalogue and its pipelines: coverage with gaps, concept pages, passes, harvest runs, arms of a replay, status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import rules, views


def coverage(datasets: DataFrame, gaps: DataFrame, today, by: str = "data_domain", level: str = "level", levels: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """by, l1, l2, ..., total, gaps, stale, placed: records of each domain and level with the register's gaps (by, review_after) of that domain; stale are
    those whose review is past. Domains of which the catalogue holds nothing have placed = false. Both sides are counted before they meet."""
    n = datasets.where(F.col(by).isNotNull()).groupBy(by).agg(*[F.count_if(F.col(level) == i).alias(f"l{i}") for i in levels], F.count("*").alias("total"))
    g = gaps.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("gaps"), F.count_if(F.col("review_after") < F.lit(today)).alias("stale"))
    both = n.join(g, by, "full_outer").withColumn("placed", F.col("total").isNotNull())
    return both.fillna(0, [*[f"l{i}" for i in levels], "total", "gaps", "stale"])


def gap_rows(datasets: DataFrame, gaps: DataFrame, by: str = "data_domain") -> DataFrame:
    """gaps with records (of their domain in the catalogue) and placed (is there one?), gaps without a domain included.

    A domain is one row on the right, so one with a third of all gaps is joined in parts by skew handling."""
    n = datasets.groupBy(F.col(by).alias("__by")).agg(F.count("*").alias("__n")).where("__by is not null")
    d = gaps.join(n, F.col(by) == F.col("__by"), "left")
    return d.withColumns({"records": F.coalesce("__n", F.lit(0)), "placed": F.col("__n").isNotNull()}).drop("__by", "__n")


def domain_list(scheme: DataFrame, datasets: DataFrame, synonyms: DataFrame, by: str = "data_domain") -> DataFrame:
    """place, concept, label, synonyms (sorted array), n of each concept of a scheme (concept, label): in the order of the number in its
    name (99 without one), then of the name, so that the tenth doesn't follow the first. n counts the records given, 0 where there are none."""
    n = datasets.groupBy(F.col(by).alias("concept")).agg(F.count("*").alias("n"))
    s = synonyms.groupBy("concept").agg(F.array_sort(F.collect_set("label")).alias("synonyms"))  # a concept's own labels
    d = scheme.select("concept", "label").join(n, "concept", "left").join(s, "concept", "left")
    digits = F.regexp_replace("concept", "[^0-9]", "")
    d = d.withColumns({"n": F.coalesce("n", F.lit(0)), "synonyms": F.coalesce("synonyms", F.array().cast("array<string>")), "order": F.when(digits == "", 99).otherwise(digits.try_cast("long"))})
    w = Window.orderBy("order", "concept")  # the concepts of one scheme
    return d.withColumn("place", F.row_number().over(w)).select("place", "concept", "label", "synonyms", "n")


def first_facet(concepts: DataFrame, *facets: tuple[str, DataFrame]) -> DataFrame:
    """concept, facet, n: how many records carry a concept in the first of the facets (name, (id, concept) rows) where any does; null and 0
    if none does. One pass: the facets are counted together."""
    rows = None
    for i, (name, df) in enumerate(facets):
        one = df.select("concept", "id", F.lit(i).alias("i"), F.lit(name).alias("facet"))
        rows = one if rows is None else rows.unionByName(one)
    n = rows.groupBy("concept", "i", "facet").agg(F.count_distinct("id").alias("n")).groupBy("concept").agg(F.min_by(F.struct("facet", "n"), "i").alias("m"))
    return concepts.select("concept").distinct().join(n, "concept", "left").select("concept", "m.facet", F.coalesce("m.n", F.lit(0)).alias("n"))


def concept_refs(broader: DataFrame, labels: DataFrame) -> DataFrame:
    """concept, kind (broader or narrower), place, ref, label: a concept's neighbours in the order of their label, or of their name
    without one. Rows, not arrays, numbered over ranges: a concept may have any number of narrower ones."""
    up = broader.select(F.col("narrower").alias("concept"), F.lit("broader").alias("kind"), F.col("broader").alias("ref"))
    down = broader.select(F.col("broader").alias("concept"), F.lit("narrower").alias("kind"), F.col("narrower").alias("ref"))
    one = labels.groupBy(F.col("concept").alias("ref")).agg(F.min("label").alias("label"))
    rows = up.unionByName(down).distinct().join(one, "ref", "left").withColumns({"shown": F.coalesce("label", "ref"), "page": F.struct("concept", "kind")})
    return views.surrogate_ids(rows, "page", "shown", "ref").select("concept", "kind", F.col("id").alias("place"), "ref", "label")


def matches_by_strength(matches: DataFrame) -> DataFrame:
    """concept, strength, targets: the sorted distinct crosswalk targets of matches (concept, strength, target), kept apart by strength, of which only the last
    part of its name counts: an exact match may be used in place of the concept, a close one may not."""
    kind = F.element_at(F.split("strength", "[#/]"), -1).alias("strength")
    return matches.select("concept", kind, "target").groupBy("concept", "strength").agg(F.array_sort(F.collect_set("target")).alias("targets"))


def inbound_links(*relations: DataFrame) -> DataFrame:
    """id, inbound: the number of different records that point to a record by any of the relations (source, target)."""
    rows = None
    for r in relations:
        one = r.where("target is not null").select("source", F.col("target").alias("id"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.distinct().groupBy("id").agg(F.count("*").alias("inbound"))


def pass_totals(outcomes: DataFrame) -> DataFrame:
    """records, changed, resolved, gaps of one pass over records (id, changed, resolved, gaps); zeros for no record."""
    return outcomes.agg(F.count("*").alias("records"), F.count_if("changed").alias("changed"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("resolved", "gaps")])


def grade_histogram(assessments: DataFrame) -> DataFrame:
    """key (facet:grade, not-assessed without a grade), n."""
    key = F.concat_ws(":", "facet", F.coalesce("grade", F.lit("not-assessed"))).alias("key")
    return assessments.groupBy(key).agg(F.count("*").alias("n"))


def link_totals(records: DataFrame, links: DataFrame) -> DataFrame:
    """records, links, warned, dropped of one pass over records (id), with scored links (source, score, has_reason, warned): a link counts if
    it has a score and a reason, and is dropped if it has a score but no reason. One row; both tables are counted on their own."""
    own = F.col("score") > 0
    kept = own & F.col("has_reason")
    a = links.agg(F.lit(0).cast("long").alias("records"), F.count_if(kept).alias("links"), F.count_if(kept & F.col("warned")).alias("warned"), F.count_if(own & ~F.col("has_reason")).alias("dropped"))
    zero = F.lit(0).cast("long")
    b = records.agg(F.count_distinct("id").alias("records")).select("records", zero.alias("links"), zero.alias("warned"), zero.alias("dropped"))
    return a.unionByName(b).agg(*[F.sum(c).alias(c) for c in a.columns])


#: Fixed value: a run that has gone on for longer than these hours is stuck.
STUCK_HOURS = 6


def run_history(runs: DataFrame, now, counts: tuple[str, ...] = ("seen", "accepted", "rejected", "updated", "unchanged", "flagged", "errors")) -> DataFrame:
    """source, runs, the sums of the counts, last_good and last_good_run (of the newest run that succeeded), checkpoint (of the newest run with one, failed
    or not, as a failed run is what one resumes), stuck (runs still going that began more than STUCK_HOURS ago), for runs (source, run_id,
    started_at, state, checkpoint and counts). Of runs that began together the larger run_id is newer. All is combined before one shuffle."""
    when = F.struct("started_at", "run_id")
    good, at = F.when(F.col("state") == "succeeded", when), F.when(F.col("checkpoint").isNotNull(), when)
    stuck = (F.col("state") == "running") & (F.col("started_at") < F.lit(now) - F.make_dt_interval(F.lit(0), F.lit(STUCK_HOURS)))
    d = runs.groupBy("source").agg(F.count("*").alias("runs"), *[F.sum(c).alias(c) for c in counts], F.max(good).alias("g"), F.max_by("checkpoint", at).alias("checkpoint"), F.count_if(stuck).alias("stuck"))
    return d.select("source", "runs", *counts, F.col("g.started_at").alias("last_good"), F.col("g.run_id").alias("last_good_run"), "checkpoint", "stuck")


def stuck_runs(runs: DataFrame, now) -> DataFrame:
    """The runs that run_history() counts as stuck."""
    return runs.where((F.col("state") == "running") & (F.col("started_at") < F.lit(now) - F.make_dt_interval(F.lit(0), F.lit(STUCK_HOURS))))


def replay(records: DataFrame, arms: dict[str, Callable[[DataFrame], DataFrame]], checks: list[rules.Rule], level: str = "level", top: int = 3) -> DataFrame:
    """arm, id, level, paths (of the rules that failed, one each rule; empty if the record conforms) of every record in every arm.

    An arm is what would be done to the records before they are checked: nothing (as built), repairs, or repairs and fillings that show what other
    problems wait behind the filled ones (the ceiling). Records are held to the rules up to their own level. No shuffle: an arm is a projection."""
    out = None
    for name, change in arms.items():
        d = change(records)
        own = F.coalesce(F.col(level), F.lit(1))
        failed = F.array_compact(F.array(*[F.when((own >= r.level) & ~F.coalesce(r.ok, F.lit(True)), F.lit(r.path)) for r in checks if r.level <= top]))
        one = d.select(F.lit(name).alias("arm"), "id", own.alias("level"), failed.alias("paths"))
        out = one if out is None else out.unionByName(one)
    return out


def arm_counts(replayed: DataFrame, levels: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """arm, seen, queued, flagged, queued_l1, ...: how many records of an arm conform, at which level, and how many don't."""
    fine = F.size("paths") == 0
    return replayed.groupBy("arm").agg(F.count("*").alias("seen"), F.count_if(fine).alias("queued"), F.count_if(~fine).alias("flagged"), *[F.count_if(fine & (F.col("level") == i)).alias(f"queued_l{i}") for i in levels])


def arm_blockers(replayed: DataFrame, n: int = 8) -> DataFrame:
    """arm, rank, path, n: the n paths that most failures of an arm name."""
    c = replayed.select("arm", F.explode("paths").alias("path")).groupBy("arm", "path").agg(F.count("*").alias("n"))
    w = Window.partitionBy("arm").orderBy(F.desc("n"), "path")  # a row a path
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("arm", "rank", "path", "n")


def operating_summary(units: DataFrame, loads: DataFrame, by: str) -> DataFrame:
    """by, demand, dispatch, capacity, online, units of units (by, p, pmax, online) and loads (by, p): dispatch and the units online count those that
    run, capacity counts all."""
    runs = F.col("online")
    u = units.groupBy(by).agg(F.sum(F.when(runs, F.col("p")).otherwise(0)).alias("dispatch"), F.sum("pmax").alias("capacity"), F.count_if(runs).alias("online"), F.count("*").alias("units"))
    d = loads.groupBy(by).agg(F.sum("p").alias("demand"))
    return u.join(d, by, "full_outer").fillna(0, ["demand", "dispatch", "capacity", "online", "units"]).select(by, "demand", "dispatch", "capacity", "online", "units")


def reconciled(elements: DataFrame, declared: DataFrame, kind: str = "kind") -> DataFrame:
    """kind, n, declared, agrees: elements of each kind (one table of all) against what the document says it holds (kind, declared); a kind that only one side
    names doesn't agree unless the other says 0."""
    n = elements.groupBy(kind).agg(F.count("*").alias("n"))
    d = n.join(declared.select(kind, "declared"), kind, "full_outer").fillna(0, ["n", "declared"])
    return d.withColumn("agrees", F.col("n") == F.col("declared"))


def status_report(datasets: DataFrame, indexed: DataFrame, events: DataFrame, queue: DataFrame, recorded: DataFrame, live: DataFrame, done: Column) -> DataFrame:
    """metric, value: catalog_records and draft_records (of datasets: review_state), indexed_documents (id), projector_lag_s (from the newest of events (at) that
    is done to the newest), queue_<state> (queue: state) and entailments_current (1 if recorded and live, both (hash), are the same, else 0; 0 too where
    nothing is recorded)."""
    long = lambda c: c.cast("long")
    counts = datasets.agg(F.count_if(F.col("review_state") != "draft").alias("catalog_records"), F.count_if(F.col("review_state") == "draft").alias("draft_records"))
    lag = events.agg(F.coalesce(F.unix_seconds(F.max("at").cast("timestamp")) - F.unix_seconds(F.max(F.when(done, F.col("at"))).cast("timestamp")), F.lit(0)).alias("projector_lag_s"))
    same = live.select("hash").join(recorded.select("hash"), "hash", "left_semi").agg(F.least(F.count("*"), F.lit(1)).alias("entailments_current"))
    out = queue.groupBy(F.concat(F.lit("queue_"), F.col("state")).alias("metric")).agg(long(F.count("*")).alias("value"))
    for df in (counts, indexed.agg(F.count_distinct("id").alias("indexed_documents")), lag, same):
        out = out.unionByName(df.select(F.explode(F.create_map(*[x for c in df.columns for x in (F.lit(c), long(F.col(c)))])).alias("metric", "value")))
    return out


def issue_counts(issues: DataFrame, open_states: tuple[str, ...] = ("open",)) -> DataFrame:
    """target, n, open, oldest_open of issues (target, state, at)."""
    is_open = F.col("state").isin(*open_states)
    return issues.groupBy("target").agg(F.count("*").alias("n"), F.count_if(is_open).alias("open"), F.min(F.when(is_open, F.col("at"))).alias("oldest_open"))


def acceptance_by_stage(judged: DataFrame) -> DataFrame:
    """stage, accepted, rejected, rate of judgements (stage, accepted); a null judgement counts as neither, and a stage with none has no rate."""
    yes, no = F.count_if("accepted"), F.count_if(~F.col("accepted"))
    return judged.groupBy("stage").agg(yes.alias("accepted"), no.alias("rejected"), F.round(yes / F.nullif(yes + no, F.lit(0)), 6).alias("rate"))
