"""More registered queries: lookups, audits, state and streams."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import changes, filters, meaning, rollups, views
from ..sources import loaders
from ..streaming import jobs
from . import demo
from .catalog import _HEALTH, _OUT, QUERIES, SQL, query
from .catalog import H12_SQL as _REVISIONS


def stream(name: str, sql: str | None = None):
    """Register a streaming job of (spark, sf_dir)."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = demo.oracle(sql)
        return f

    return add


@query("S11_counts_by_graph", "SELECT source, count(*) AS n FROM documents GROUP BY 1")
def s11(t):
    return rollups.state_counts(t("documents"), "source")


@query("S12_checksum", """WITH h AS (SELECT ('0x' || substr(md5(coalesce('=' || doc_id, '-') || chr(31) || coalesce('=' || lang, '-') || chr(31) || coalesce('=' || n_chars, '-') || chr(31) || coalesce('=' || source, '-') || chr(31) || coalesce('=' || text, '-')), 1, 15))::BIGINT AS h FROM documents)
    SELECT count(*) AS n, CAST(sum(h::HUGEINT) AS VARCHAR) || ':' || CAST(bit_xor(h) AS VARCHAR) AS hash FROM h""")
def s12(t):
    return loaders.checksum(t("documents"))


@query("S13_envelope", "SELECT count(*) AS rows, count(*) FILTER (cadence IS NULL) AS missing_cadence, count(*) FILTER (west IS NULL) AS missing_west FROM datasets")
def s13(t):
    return loaders.envelope(t("datasets"), ["cadence", "west"])


@query("N20_schema_fields", """SELECT p_partkey, f AS field FROM (SELECT p_partkey, unnest([p_type, p_brand]) AS f FROM part)""")
def n20(t):
    files = t("part").select(F.col("p_partkey").cast("string").alias("path"), F.concat_ws("\n", F.concat_ws(", ", "p_type", "p_brand"), F.lit("1,2")).alias("text"))
    return loaders.schema_fields(files).select(F.col("path").cast("long").alias("p_partkey"), "field")


@query("A13_pass_summary", "SELECT 'currency' AS facet, cadence AS grade, count(*) AS n FROM datasets GROUP BY 1, 2")
def a13(t):
    return meaning.pass_summary(t("datasets").select(F.lit("currency").alias("facet"), F.col("cadence").alias("grade")))


@query("A14_resolution_coverage", "SELECT id, count(*) FILTER (value_basis = 'measured') AS confirmed, count(*) FILTER (value_basis = 'modeled') AS label, count(*) FILTER (value_basis IS NULL OR value_basis NOT IN ('measured', 'modeled')) AS gap FROM parts GROUP BY 1")
def a14(t):
    basis = F.when(F.col("value_basis") == "measured", "confirmed").when(F.col("value_basis") == "modeled", "label").otherwise("gap")
    return meaning.resolution_coverage(t("parts").withColumn("basis", basis)).select("id", "confirmed", "label", "gap")


@query("J2_question_classes", "SELECT id, string_agg(label || part, '|' ORDER BY CASE value_basis WHEN 'measured' THEN 1 WHEN 'modeled' THEN 2 ELSE 3 END, label || part) AS classes FROM parts WHERE definition IS NOT NULL GROUP BY 1")
def j2(t):
    d = t("parts").select("id", F.concat("label", F.col("part").cast("string")).alias("name"), F.col("definition").alias("basis"), F.when(F.col("value_basis") == "measured", "robust").when(F.col("value_basis") == "modeled", "fragile").alias("verdict"))
    return meaning.question_classes(d).select("id", F.array_join("classes", "|").alias("classes"))


@query("J6_unit_audit", "SELECT p_type AS scheme, p_brand AS concept, p_partkey AS external FROM part a WHERE p_size % 2 = 0 AND (p_size % 10 = 0 OR EXISTS (SELECT 1 FROM part b WHERE b.p_type = a.p_type AND b.p_brand = a.p_brand AND b.p_size = 49))")
def j6(t):
    s = F.col("p_size")
    c = t("part").select(F.col("p_type").alias("scheme"), F.col("p_brand").alias("concept"), F.col("p_partkey").alias("external"), F.when(s % 2 == 0, "exact").otherwise("close").alias("strength"), F.when(s == 49, "differs").alias("note"), F.lit("MW").alias("unit_a"), F.when(s % 10 == 0, "kW").otherwise("MW").alias("unit_b"))
    return meaning.unit_audit(c)


@query("J7_federated_join", "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey ")
def j7(t):
    rows = t("lineitem").select(F.col("l_partkey").alias("part"), "l_orderkey", "l_linenumber")
    return views.labelled(rows, "part", t("part"), "p_partkey", "p_brand").select("l_orderkey", "l_linenumber", "p_brand")


@query("J9_labels", "SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey ")
def j9(t):
    rows = t("lineitem").select(F.col("l_suppkey").alias("supplier"), "l_orderkey", "l_linenumber")
    return views.labelled(rows, "supplier", t("supplier"), "s_suppkey", "s_name").select("l_orderkey", "l_linenumber", "s_name")


@query("J10_component_rows", "SELECT p_partkey, coalesce(s_name, 'unnamed') AS name FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
def j10(t):
    named = views.labelled(t("part").select("p_partkey"), "p_partkey", t("supplier"), "s_suppkey", "s_name", "unnamed")
    return named.select("p_partkey", F.col("s_name").alias("name"))


@query("E9_active_plans", "SELECT user_id, count(*) AS plans FROM events WHERE event_type = 'purchase' AND ts > TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1")
def e9(t):
    return rollups.active(t("events"), "user_id", "ts", datetime(2024, 1, 20), F.col("event_type") == "purchase")


@query("E10_custodians", "SELECT publisher, string_agg(title, '|' ORDER BY title) AS acts_for FROM datasets WHERE regexp_matches(iri, '^https?://') GROUP BY 1")
def e10(t):
    return rollups.acts_for(t("datasets")).withColumn("acts_for", F.array_join("acts_for", "|"))


@query("H6_conflicts", "SELECT p_partkey AS id, 'brand' AS p FROM part WHERE p_size % 5 = 0 AND p_size % 2 = 0")
def h6(t):
    p = t("part").select(F.col("p_partkey").alias("id"), F.lit("brand").alias("p"), F.col("p_brand").alias("o"), "p_size")
    diff = changes.predicate_diff(p, p.withColumn("o", F.when(F.col("p_size") % 5 == 0, "x").otherwise(F.col("o"))))
    return changes.conflicts(diff, p.where("p_size % 2 = 0").select("id", F.array(F.lit("brand"), F.lit("type")).alias("fields")))


@query("H14_overdue_copies", "SELECT id FROM datasets WHERE modified < DATE '2000-01-01'")
def h14(t):
    return views.overdue(t("datasets"), "modified", date(2000, 1, 1)).select("id")


@query("H20_caveats", """SELECT distribution_id, array_to_string(list_filter([CASE WHEN NOT reachable THEN 'unreachable at the last probe' END, CASE WHEN NOT anonymous THEN 'needs an account' END, CASE WHEN requester_pays THEN 'the requester pays for transfer' END, CASE WHEN sliceable AND chunk_index IS NULL THEN 'ranges without a chunk index' END], lambda x: x IS NOT NULL), '; ') AS caveats FROM distributions""")
def h20(t):
    return changes.caveats(t("distributions")).select("distribution_id", F.array_join("caveats", "; ").alias("caveats"))


@query("H21_download_target", "SELECT dataset_id, distribution_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY reachable DESC, coalesce(anonymous, true) DESC, bulk DESC, distribution_id) AS n FROM distributions WHERE url LIKE 'http://%' OR url LIKE 'https://%') WHERE n = 1")
def h21(t):
    return changes.download_target(t("distributions"))


@query("P13_temporal_sort_page", "SELECT id, title FROM datasets ORDER BY modified DESC NULLS LAST, id LIMIT 30")
def p13(t):
    return filters.page(filters.ordered(t("datasets"), ("modified", True), tie="id"), 0, 30).select("id", "title")


def _probe_stream(spark, sf_dir):
    e = jobs.opened(spark, f"{sf_dir}/events.parquet")
    kind = F.col("event_type")
    status = F.when(kind == "error", 500).when(kind == "purchase", 301).when(kind == "signup", 403).when(kind == "click", 302).otherwise(200)
    to = F.when(kind.isin("purchase", "click"), F.concat(F.lit("https://new.example.org/"), (F.col("event_id") % 2).cast("string")))
    url = F.concat(F.when(F.col("user_id") % 9 == 4, "s3://bucket/").otherwise("https://old.example.org/"), F.col("user_id").cast("string"))
    return jobs.classified(e.select(F.col("event_id").alias("probe_id"), F.col("user_id").alias("distribution_id"), F.col("ts").cast("timestamp").alias("probed_at"), status.alias("status"), to.alias("location"), url.alias("url")))


def _health_told(spark, sf_dir):
    return jobs.health_now(jobs.drained(jobs.health_states(_probe_stream(spark, sf_dir).where("outcome is not null")), "st2", "update"))


@stream("ST1_probe_stream", f"SELECT probe_id, {_OUT} AS outcome FROM probes")
def st1(spark, sf_dir):
    return jobs.drained(_probe_stream(spark, sf_dir).select("probe_id", "outcome"), "st1").select("probe_id", "outcome")


@stream("ST2_health_state", _HEALTH + "SELECT distribution_id, CAST(failures AS INT) AS failures, failures >= 3 AS excluded FROM h")
def st2(spark, sf_dir):
    return _health_told(spark, sf_dir)[0].select("distribution_id", "failures", "excluded")


@stream("ST2_heals", _REVISIONS)
def st2h(spark, sf_dir):
    revisions = _health_told(spark, sf_dir)[1]
    n = F.row_number().over(Window.partitionBy("distribution_id").orderBy("probed_at", "probe_id"))
    return revisions.select("distribution_id", n.alias("n"), "probe_id", "new_value")


def _events(spark, sf_dir):
    return jobs.opened(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@stream("ST4_request_windows", "SELECT user_id, time_bucket(INTERVAL 60 SECOND, ts) AS window_start, count(*) AS n, count(*) <= 1 AS allowed FROM events GROUP BY 1, 2")
def st4(spark, sf_dir):
    out = jobs.drained(jobs.request_counts(_events(spark, sf_dir), 1), "st4", "update")
    return out.groupBy("user_id", "window_start").agg(F.max("n").alias("n")).withColumn("allowed", F.col("n") <= 1)


@stream("ST5_new_payloads", """SELECT event_type AS hash, event_id AS seq, user_id AS id, CASE WHEN before IS NULL THEN 'created' ELSE 'changed' END AS action
    FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type""")
def st5(spark, sf_dir):
    p = _events(spark, sf_dir).select(F.lit("log").alias("source"), F.col("user_id").alias("id"), F.col("event_type").alias("hash"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("seq"))
    return jobs.drained(jobs.payload_changes(p), "st5").select("hash", "seq", "id", "action")


@stream("ST6_refusals", "SELECT event_type AS action, s AS window_start, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR, time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 12 HOUR, time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 18 HOUR]) AS s FROM events WHERE event_type IN ('error', 'signup')) GROUP BY 1, 2")
def st6(spark, sf_dir):
    out = jobs.drained(jobs.refusals(_events(spark, sf_dir), ["error", "signup"]), "st6", "update")
    return out.groupBy("action", "window_start").agg(F.max("n").alias("n"))


@stream("ST3_reproject", "SELECT id, deleted, concepts FROM (SELECT l_suppkey AS id, false AS deleted, count(DISTINCT l_partkey) AS concepts FROM lineitem WHERE l_suppkey IN (SELECT user_id FROM events) GROUP BY 1)")
def st3(spark, sf_dir):
    c = demo.table(spark, sf_dir, "concept_of")
    commits = _events(spark, sf_dir).select(F.col("user_id").alias("id"), F.lit(True).alias("published"), F.col("ts").alias("at"))
    project = lambda ids: c.join(ids, "id", "left_semi").groupBy("id").agg(F.count("*").alias("concepts"))
    out = jobs.reprojected(commits, project, "st3")
    return out.groupBy("id").agg(F.max_by("deleted", "batch").alias("deleted"), F.max_by("concepts", "batch").alias("concepts"))
