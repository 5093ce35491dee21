"""Registered queries of the reports and of the check of an operating point."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ..operators import document, filters, network, reports, seed
from ..sources import loaders
from . import catalog
from .catalog import query

TODAY, LATE = date(2003, 6, 1), datetime(2024, 1, 20)


@query("A3_coverage", """
    WITH n AS (SELECT data_domain, count(*) FILTER (level = 1) AS l1, count(*) FILTER (level = 2) AS l2, count(*) FILTER (level = 3) AS l3, count(*) AS total FROM datasets WHERE review_state <> 'draft' GROUP BY 1),
    g AS (SELECT data_domain, count(*) AS gaps, count(*) FILTER (review_after < DATE '2003-06-01') AS stale FROM gap_register WHERE data_domain IS NOT NULL GROUP BY 1)
    SELECT coalesce(n.data_domain, g.data_domain) AS data_domain, coalesce(l1, 0) AS l1, coalesce(l2, 0) AS l2, coalesce(l3, 0) AS l3, coalesce(total, 0) AS total, coalesce(gaps, 0) AS gaps, coalesce(stale, 0) AS stale, total IS NOT NULL AS placed FROM n FULL JOIN g ON n.data_domain = g.data_domain""")
def a3(t):
    return reports.coverage(t("datasets").where(filters.published(F.col("review_state"))), t("gap_register"), TODAY)


@query("A3_gap_rows", "SELECT g.*, coalesce(n, 0) AS records, n IS NOT NULL AS placed FROM gap_register g LEFT JOIN (SELECT data_domain AS d, count(*) AS n FROM datasets GROUP BY 1) ON d = g.data_domain")
def a3_gaps(t):
    return reports.gap_rows(t("datasets"), t("gap_register"))


_SCHEME = "SELECT 'DD' || CAST(n_nationkey % 13 AS VARCHAR(9)) AS concept, min(n_name) AS label FROM nation GROUP BY 1 UNION ALL SELECT 'other', 'Other'"


@query("A4_domain_list", f"""
    WITH s AS ({_SCHEME}), k AS (SELECT 'DD' || CAST(nation % 13 AS VARCHAR(9)) AS concept, count(*) AS n FROM datasets WHERE nation % 13 <> 4 GROUP BY 1),
    y AS (SELECT 'DD' || CAST(n_nationkey % 13 AS VARCHAR(9)) AS concept, string_agg(DISTINCT n_name, '|' ORDER BY n_name) AS synonyms FROM nation WHERE n_nationkey >= 13 GROUP BY 1)
    SELECT row_number() OVER (ORDER BY coalesce(TRY_CAST(regexp_replace(s.concept, '[^0-9]', '', 'g') AS BIGINT), 99), s.concept) AS place, s.concept, label, coalesce(synonyms, '') AS synonyms, coalesce(n, 0) AS n FROM s LEFT JOIN k ON k.concept = s.concept LEFT JOIN y ON y.concept = s.concept""")
def a4(t):
    code = lambda c: F.concat(F.lit("DD"), (F.col(c) % 13).cast("string"))
    n = t("nation")
    scheme = n.groupBy(code("n_nationkey").alias("concept")).agg(F.min("n_name").alias("label"))
    scheme = scheme.unionByName(n.sparkSession.createDataFrame([("other", "Other")], "concept string, label string"))
    words = n.where("n_nationkey >= 13").select(code("n_nationkey").alias("concept"), F.col("n_name").alias("label"))
    d = t("datasets").where("nation % 13 <> 4").select("id", code("nation").alias("data_domain"))
    return reports.domain_list(scheme, d, words).withColumn("synonyms", F.array_join("synonyms", "|"))


@query("A5_first_facet", """
    WITH c AS (SELECT DISTINCT p_brand AS concept FROM part UNION SELECT r_name FROM region UNION SELECT 'unused'),
    f AS (SELECT p_brand AS concept, 1 AS i, 'concept' AS facet, count(DISTINCT m.id) AS n FROM concept_of m JOIN part ON p_partkey = member WHERE p_size < 3 GROUP BY 1 UNION ALL SELECT data_domain, 2, 'data_domain', count(DISTINCT id) FROM datasets GROUP BY 1 UNION ALL SELECT member, 3, 'analysis', count(DISTINCT id) FROM analysis_of GROUP BY 1),
    b AS (SELECT concept, arg_min(facet, i) AS facet, arg_min(n, i) AS n FROM f GROUP BY 1)
    SELECT c.concept, facet, coalesce(n, 0) AS n FROM c LEFT JOIN b ON b.concept = c.concept""")
def a5(t):
    p = t("part")
    own = t("concept_of").join(p.where("p_size < 3"), F.col("p_partkey") == F.col("member")).select(F.col("p_brand").alias("concept"), "id")
    domain = t("datasets").select(F.col("data_domain").alias("concept"), "id")
    analysis = t("analysis_of").select(F.col("member").alias("concept"), "id")
    concepts = p.select(F.col("p_brand").alias("concept")).union(t("region").select("r_name")).union(p.sparkSession.createDataFrame([("unused",)], "concept string"))
    return reports.first_facet(concepts, ("concept", own), ("data_domain", domain), ("analysis", analysis))


@query("A6_concept_refs", """
    WITH l AS (SELECT 'N' || n_nationkey AS ref, n_name AS label FROM nation UNION ALL SELECT 'R' || r_regionkey, r_name FROM region),
    e AS (SELECT narrower AS concept, 'broader' AS kind, broader AS ref FROM broader UNION SELECT broader, 'narrower', narrower FROM broader)
    SELECT concept, kind, row_number() OVER (PARTITION BY concept, kind ORDER BY coalesce(label, e.ref), e.ref) AS place, e.ref, label FROM e LEFT JOIN l ON l.ref = e.ref""")
def a6(t):
    named = t("nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("concept"), F.col("n_name").alias("label"))
    named = named.union(t("region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")), "r_name"))
    return reports.concept_refs(t("broader"), named)


@query("A6_matches_by_strength", """
    WITH m AS (SELECT p_brand AS concept, CASE p_size % 3 WHEN 0 THEN 'exactMatch' WHEN 1 THEN 'closeMatch' ELSE 'broadMatch' END AS strength, p_name AS target FROM part)
    SELECT concept, strength, string_agg(DISTINCT target, '|' ORDER BY target) AS targets FROM m GROUP BY 1, 2""")
def a6_matches(t):
    k = F.col("p_size") % 3
    m = t("part").select(F.col("p_brand").alias("concept"), F.when(k == 0, "http://w.example.org/core#exactMatch").when(k == 1, "http://w.example.org/core/closeMatch").otherwise("broadMatch").alias("strength"), F.col("p_name").alias("target"))
    return reports.matches_by_strength(m).withColumn("targets", F.array_join("targets", "|"))


@query("A12_inbound_by_relation", """
    WITH r AS (SELECT child AS source, parent AS target FROM derivations UNION SELECT id, superseded_by FROM datasets WHERE superseded_by IS NOT NULL UNION SELECT superseded_by, id FROM datasets WHERE superseded_by IS NOT NULL UNION SELECT source, target FROM referrers UNION SELECT child, parent FROM lineage WHERE kind = 'upstream')
    SELECT target AS id, count(DISTINCT source) AS inbound FROM r GROUP BY 1""")
def a12(t):
    newer = t("datasets").select(F.col("id").alias("source"), F.col("superseded_by").alias("target"))
    older = newer.where("target is not null").select(F.col("target").alias("source"), F.col("source").alias("target"))
    pair = lambda d: d.select(F.col("child").alias("source"), F.col("parent").alias("target"))
    return reports.inbound_links(pair(t("derivations")), newer, older, t("referrers"), pair(t("lineage").where("kind = 'upstream'")))


@query("A13_pass_totals", "WITH o AS (SELECT id, id % 3 = 0 AS changed, count(*) FILTER (value_basis IN ('measured', 'modeled')) AS resolved, count(*) FILTER (value_basis IS NULL) AS gaps FROM parts GROUP BY id) SELECT count(*) AS records, count(*) FILTER (changed) AS changed, sum(resolved)::BIGINT AS resolved, sum(gaps)::BIGINT AS gaps FROM o")
def a13(t):
    o = t("parts").groupBy("id").agg(F.count_if(F.col("value_basis").isin("measured", "modeled")).alias("resolved"), F.count_if(F.col("value_basis").isNull()).alias("gaps")).withColumn("changed", F.col("id") % 3 == 0)
    return reports.pass_totals(o)


@query("A13_grade_histogram", "SELECT facet || ':' || coalesce(grade, 'not-assessed') AS key, count(*) AS n FROM (SELECT 'currency' AS facet, cadence AS grade FROM datasets UNION ALL SELECT 'level', CAST(level AS VARCHAR) FROM datasets) GROUP BY 1")
def a13_grades(t):
    d = t("datasets")
    return reports.grade_histogram(d.select(F.lit("currency").alias("facet"), F.col("cadence").alias("grade")).union(d.select(F.lit("level"), F.col("level").cast("string"))))


@query("A13_link_totals", catalog._STR + "SELECT (SELECT count(*) FROM datasets) AS records, count(*) FILTER (score > 0 AND has_reason) AS links, count(*) FILTER (score > 0 AND has_reason AND target % 4 = 0) AS warned, count(*) FILTER (score > 0 AND NOT has_reason) AS dropped FROM st")
def a13_links(t):
    return reports.link_totals(t("datasets"), catalog._scored(t).withColumn("warned", F.col("target") % 4 == 0))


_COUNTS = ("seen", "accepted", "rejected", "updated", "unchanged", "flagged", "errors")


@query("A16_run_history", f"""
    SELECT source, count(*) AS runs, {", ".join(f"sum({c})::BIGINT AS {c}" for c in _COUNTS)}, max(started_at) FILTER (state = 'succeeded') AS last_good, arg_max(run_id, (started_at, run_id)) FILTER (state = 'succeeded') AS last_good_run,
        arg_max(checkpoint, (started_at, run_id)) FILTER (checkpoint IS NOT NULL) AS checkpoint, count(*) FILTER (state = 'running' AND started_at < TIMESTAMP '2024-01-19 18:00:00') AS stuck FROM runs GROUP BY 1""")
def a16(t):
    return reports.run_history(t("runs"), LATE)


@query("A16_stuck_runs", "SELECT source, run_id FROM runs WHERE state = 'running' AND started_at < TIMESTAMP '2024-01-19 18:00:00'")
def a16_stuck(t):
    return reports.stuck_runs(t("runs"), LATE).select("source", "run_id")


def _arms():
    repair = lambda d: d.withColumns({"cadence": F.coalesce("cadence", F.when(F.col("id") % 2 == 0, "P1Y")), "title": F.concat("title", F.lit("0"))})
    fill = lambda d: repair(d).withColumns({"cadence": F.coalesce("cadence", F.lit("irregular")), "west": F.coalesce("west", F.lit(0.0))})
    return {"as-built": lambda d: d, "repaired": repair, "ceiling": fill}


_ARMS = """
    WITH d3 AS (SELECT 'as-built' AS arm, * FROM datasets UNION ALL SELECT 'repaired', * REPLACE (coalesce(cadence, CASE WHEN id % 2 = 0 THEN 'P1Y' END) AS cadence, title || '0' AS title) FROM datasets
        UNION ALL SELECT 'ceiling', * REPLACE (coalesce(cadence, CASE WHEN id % 2 = 0 THEN 'P1Y' END, 'irregular') AS cadence, title || '0' AS title, coalesce(west, 0) AS west) FROM datasets),
    v AS (SELECT arm, id, level, unnest(list_filter([CASE WHEN cadence IS NULL THEN 'cadence' END, CASE WHEN data_domain NOT IN ('AFRICA', 'ASIA', 'EUROPE', 'AMERICA') THEN 'data_domain' END, CASE WHEN level >= 2 AND west IS NULL THEN 'west' END, CASE WHEN level >= 2 AND north NOT BETWEEN -50 AND 50 THEN 'north' END,
        CASE WHEN level >= 3 AND NOT regexp_matches(title, '[02468]$') THEN 'title' END, CASE WHEN level >= 2 AND modified IS NULL AND superseded_by IS NULL THEN 'modified|superseded_by' END, CASE WHEN level >= 3 AND visibility = 'public' AND west IS NULL THEN 'west' END, CASE WHEN superseded_by = id THEN 'superseded_by' END], lambda x: x IS NOT NULL)) AS path FROM d3)"""


@query("A15_arms", _ARMS + """, ok AS (SELECT arm, level, id, (arm, id) IN (SELECT (arm, id) FROM v) AS bad FROM d3)
    SELECT arm, count(*) AS seen, count(*) FILTER (NOT bad) AS queued, count(*) FILTER (bad) AS flagged, count(*) FILTER (NOT bad AND level = 1) AS queued_l1, count(*) FILTER (NOT bad AND level = 2) AS queued_l2, count(*) FILTER (NOT bad AND level = 3) AS queued_l3 FROM ok GROUP BY 1""")
def a15(t):
    return reports.arm_counts(reports.replay(t("datasets"), _arms(), catalog._rules()))


@query("A15_arm_blockers", _ARMS + ", c AS (SELECT arm, path, count(*) AS n FROM v GROUP BY 1, 2), r AS (SELECT arm, row_number() OVER (PARTITION BY arm ORDER BY n DESC, path) AS rank, path, n FROM c) SELECT * FROM r WHERE rank <= 8")
def a15_blockers(t):
    return reports.arm_blockers(reports.replay(t("datasets"), _arms(), catalog._rules()))


@query("A17_operating_summary", """
    WITH u AS (SELECT system, sum(CASE WHEN online THEN p ELSE 0 END) AS dispatch, sum(pmax) AS capacity, count(*) FILTER (online) AS online, count(*) AS units FROM thermal_units GROUP BY 1), d AS (SELECT system, sum(p) AS demand FROM power_loads GROUP BY 1)
    SELECT coalesce(u.system, d.system) AS system, round(coalesce(demand, 0), 3) AS demand, round(coalesce(dispatch, 0), 3) AS dispatch, coalesce(capacity, 0) AS capacity, online, units FROM u FULL JOIN d ON u.system = d.system""")
def a17(t):
    return reports.operating_summary(t("thermal_units"), t("power_loads"), "system").withColumns({c: F.round(c, 3) for c in ("demand", "dispatch")})


@query("A18_reconciled", """
    WITH e AS (SELECT 'type:' || p_type AS kind FROM part UNION ALL SELECT 'nation:' || CAST(s_nationkey AS VARCHAR) FROM supplier), n AS (SELECT kind, count(*) AS n FROM e GROUP BY 1),
    w AS (SELECT 'nation:' || CAST(n_nationkey AS VARCHAR) AS kind, n_nationkey % 3 AS declared FROM nation UNION ALL SELECT 'type:PROMO', count(*) FROM part WHERE p_type = 'PROMO')
    SELECT coalesce(n.kind, w.kind) AS kind, coalesce(n, 0) AS n, coalesce(declared, 0) AS declared, coalesce(n, 0) = coalesce(declared, 0) AS agrees FROM n FULL JOIN w ON n.kind = w.kind""")
def a18(t):
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string")).alias("kind")
    elements = t("part").select(name("type:", "p_type")).union(t("supplier").select(name("nation:", "s_nationkey")))
    said = t("nation").select(name("nation:", "n_nationkey"), (F.col("n_nationkey") % 3).cast("long").alias("declared")).union(t("part").where("p_type = 'PROMO'").groupBy(name("type:", "p_type")).count())
    return reports.reconciled(elements, said)


@query("A19_status_report", """
    SELECT 'catalog_records' AS metric, count(*) FILTER (review_state <> 'draft') AS value FROM datasets UNION ALL SELECT 'draft_records', count(*) FILTER (review_state = 'draft') FROM datasets UNION ALL SELECT 'indexed_documents', count(DISTINCT id) FROM analysis_of
    UNION ALL SELECT 'projector_lag_s', CAST(floor(epoch(max(ts))) - floor(epoch(max(ts) FILTER (event_id % 5 = 0))) AS BIGINT) FROM events UNION ALL SELECT 'queue_' || review_state, count(*) FROM datasets GROUP BY 1 UNION ALL SELECT 'entailments_current', 1""")
def a19(t):
    d, v = t("datasets"), loaders.checksum(t("broader"))
    events = t("events").select(F.col("ts").alias("at"), "event_id")
    return reports.status_report(d, t("analysis_of"), events, d.select(F.col("review_state").alias("state")), v, loaders.checksum(t("broader").orderBy(F.desc("narrower"))), F.col("event_id") % 5 == 0)


@query("A9_issue_counts", "SELECT user_id AS target, count(*) AS n, count(*) FILTER (event_type IN ('error', 'signup')) AS open, min(ts) FILTER (event_type IN ('error', 'signup')) AS oldest_open FROM events GROUP BY 1")
def a9(t):
    return reports.issue_counts(t("events").select(F.col("user_id").alias("target"), F.col("event_type").alias("state"), F.col("ts").alias("at")), ("error", "signup"))


@query("A8_rates_by_stage", "SELECT event_type AS stage, count(*) FILTER (value >= 10) AS accepted, count(*) FILTER (value < 10) AS rejected, round(count(*) FILTER (value >= 10)::DOUBLE / count(value), 6) AS rate FROM events GROUP BY 1")
def a8(t):
    return reports.acceptance_by_stage(t("events").select(F.col("event_type").alias("stage"), (F.col("value") >= 10).alias("accepted")))


@query("V12_operating_point", """
    WITH s AS (SELECT u.system AS us, l.system AS ls, made, used FROM (SELECT system, sum(p) AS made FROM thermal_units GROUP BY 1) u FULL JOIN (SELECT system, sum(p) AS used FROM power_loads GROUP BY 1) l ON u.system = l.system),
    f AS (SELECT system, 'voltage-range' AS rule, name, v AS value FROM bus_state WHERE v IS NULL OR v < vmin - 1e-6 OR v > vmax + 1e-6
    UNION ALL SELECT system, 'branch-rating', name, sqrt(p * p + q * q) FROM line_flows WHERE rating IS NULL OR sqrt(p * p + q * q) > rating * 1.0001
    UNION ALL SELECT system, 'dispatch-range', name, p FROM thermal_units WHERE online AND (p IS NULL OR pmax IS NULL OR p < pmin - 1e-6 OR p > pmax + 1e-6)
    UNION ALL SELECT system, 'offline-output', name, p FROM thermal_units WHERE NOT online AND (p IS NULL OR p <> 0) UNION ALL SELECT system, 'unavailable', name, p FROM thermal_units WHERE NOT coalesce(available, false)
    UNION ALL SELECT coalesce(us, ls), 'loss', NULL, (coalesce(made, 0) - used) / nullif(used, 0) FROM s WHERE NOT coalesce((made - used) / nullif(used, 0) > 0 AND (made - used) / nullif(used, 0) < 0.05, false))
    SELECT system, rule, name, round(value, 6) AS value FROM f""")
def v12(t):
    return network.operating_faults(t("bus_state"), t("line_flows"), t("thermal_units"), t("power_loads")).withColumn("value", F.round("value", 6))


_SEED = """
    SELECT CASE WHEN p_size % 31 = 30 THEN '' ELSE p_name || ' ' || p_partkey END AS name, CASE WHEN p_size % 9 = 0 THEN 'own-' || p_partkey END AS slug, p_brand AS domain, CASE WHEN p_size % 4 > 0 THEN p_type END AS domain_name, p_size % 5 < 3 AS verified, CAST(CASE p_size % 6 WHEN 0 THEN 3 WHEN 1 THEN 1 END AS INT) AS tier,
        CASE WHEN p_size % 3 = 1 THEN '  two   words ' WHEN p_size % 3 = 2 THEN ' ' END AS note, CASE WHEN p_size % 8 = 5 THEN 'for a reason' END AS pointer_rationale, CASE WHEN p_size % 5 > 1 THEN 'https://d.example.org/' || p_partkey WHEN p_size % 5 = 1 THEN '' END AS access,
        CASE WHEN p_size % 7 > 3 THEN 'CSV' END AS format, p_size % 2 = 0 AS bulk, CASE WHEN p_size % 4 = 0 THEN true WHEN p_size % 4 = 1 THEN false END AS anonymous, CASE p_size % 10 WHEN 3 THEN 'restricted' WHEN 4 THEN 'fragmented' END AS access_barrier, CASE WHEN p_size % 11 = 2 THEN 'https://api.example.org' END AS api, CASE WHEN p_size % 7 = 2 THEN 'https://b.example.org' END AS secondary_access,
        CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_type END AS license, CASE p_size % 4 WHEN 0 THEN 'doi:10.1/' || p_partkey WHEN 1 THEN 'https://doi.org/10.2/x' WHEN 2 THEN '10.3/y' END AS doi, CASE p_size % 7 WHEN 0 THEN 'Annual' WHEN 1 THEN 'P1M' WHEN 2 THEN 'PT15M' WHEN 3 THEN 'no further support planned' WHEN 4 THEN 'p1m' WHEN 5 THEN 'often' END AS update_frequency,
        CASE p_size % 3 WHEN 0 THEN '2016' WHEN 1 THEN '2019-04' END AS last_update, CASE p_size % 12 WHEN 0 THEN 'nodal' WHEN 1 THEN 'village' WHEN 2 THEN '' END AS spatial_granularity, CASE WHEN p_size % 16 > 0 THEN 'because' END AS curator_note FROM part"""


@query("N14_records", f"""
    WITH s AS ({_SEED}), a AS (SELECT * REPLACE (nullif(trim(regexp_replace(note, '\\s+', ' ', 'g')), '') AS note, nullif(access, '') AS access, nullif(spatial_granularity, '') AS spatial_granularity),
            CASE WHEN regexp_matches(update_frequency, '^P(T?[0-9]+[YMWDHS])+$') THEN update_frequency ELSE CASE lower(update_frequency) WHEN 'annual' THEN 'P1Y' WHEN 'no further support planned' THEN 'discontinued' END END AS cadence,
            coalesce(slug, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-')) AS sl, coalesce(tier = 3, false) AS ref FROM s WHERE name <> '' AND coalesce(spatial_granularity, '') <> 'village'),
    b AS (SELECT *, anonymous IS NULL AND coalesce(cadence, '') <> 'discontinued' AND coalesce(access_barrier, '') <> 'restricted' AS assumed, coalesce(api, secondary_access) AS second FROM a)
    SELECT 'https://c.example.org/' || sl AS id, name AS title, name || ', a ' || coalesce(domain_name, 'grid') || ' dataset' || coalesce(', published as ' || format, '') || coalesce(', available at ' || access, '') || '.' || coalesce(' ' || note, '') || coalesce(' ' || pointer_rationale, '') || CASE WHEN verified THEN '' ELSE ' Licence and access have not been reviewed.' END AS description,
        CASE WHEN ref OR note IS NULL THEN 'none' ELSE 'partial' END AS documentation_status, CASE WHEN verified THEN 'confirmed' ELSE 'draft' END AS review_state, CASE last_update WHEN '2016' THEN TIMESTAMP '2016-01-01' WHEN '2019-04' THEN TIMESTAMP '2019-04-01' END AS modified, cadence AS update_cadence, spatial_granularity, ref AS reference_only,
        coalesce(pointer_rationale, CASE WHEN access IS NULL THEN coalesce('No access path is recorded; the inventory names this barrier: ' || access_barrier || '.', 'No access path is recorded, and no reason for it.') END) AS pointer_rationale,
        CASE WHEN doi LIKE 'http%' THEN doi ELSE 'https://doi.org/' || replace(doi, 'doi:', '') END AS persistent_id, CASE WHEN license IS NULL THEN 'LicenseRef-Unstated' WHEN license = 'ECONOMY' THEN 'MIT' WHEN license = 'STANDARD' THEN 'LicenseRef-Open' ELSE 'LicenseRef-Unreviewed-' || lower(license) END AS license_id,
        CASE license WHEN 'STANDARD' THEN true WHEN 'ECONOMY' THEN NULL ELSE false END AS redistribution_allowed, CASE WHEN license = 'STANDARD' THEN false END AS commercial_use_allowed, CASE WHEN license = 'STANDARD' THEN true END AS share_alike,
        CASE WHEN access_barrier = 'restricted' THEN 'ceii' WHEN cadence = 'discontinued' THEN 'discontinued' WHEN anonymous THEN 'none' ELSE 'accountRequired' END AS restriction, coalesce(anonymous, false) AS anonymous_access,
        CASE WHEN access IS NULL AND second IS NULL THEN NULL ELSE concat_ws('|', 'primary ' || access || ' ' || coalesce(format, '?'), 'secondary ' || second || ' ' || CASE WHEN api IS NOT NULL THEN 'API' ELSE '?' END) END AS distributions,
        concat_ws('|', CASE WHEN NOT verified THEN 'Not reviewed: the licence and the tier are a first guess.' END, 'There is a barrier (' || access_barrier || '): listed so that it can be found, not because it can be had.', CASE WHEN assumed THEN 'Access has not been checked: an account is assumed.' END,
            CASE WHEN NOT ref AND note IS NULL THEN 'The inventory has nothing on documentation; that it is said to have none is no finding.' END, CASE WHEN ref THEN 'For reference only: without fields and links.' END) AS caveats FROM b""")
def n14(t):
    p = t("part")
    rows = p.sparkSession.sql(_SEED.replace("FROM part", "FROM {part}"), part=p)
    known = p.sparkSession.createDataFrame([("ECONOMY", "MIT", None, None, None, None), ("STANDARD", "LicenseRef-Open", "terms", True, False, True)], "raw string, id string, note string, redistribution boolean, commercial boolean, share_alike boolean")
    r = seed.records(rows, known, "https://c.example.org/")[0]
    ways = F.array_join(F.transform("distributions", lambda x: F.concat_ws(" ", x["kind"], x["access_url"], F.coalesce(x["format_label"], F.lit("?")))), "|")
    r = r.withColumns({"distributions": ways, "caveats": F.array_join("caveats", "|")})
    return r.select("id", "title", "description", "documentation_status", "review_state", "modified", "update_cadence", "spatial_granularity", "reference_only", "pointer_rationale", "persistent_id", "license_id", "redistribution_allowed", "commercial_use_allowed", "share_alike", "restriction", "anonymous_access", "distributions", "caveats")


@query("N14_rejected", f"WITH s AS ({_SEED}) SELECT name AS title, CASE WHEN name = '' THEN 'no-name' ELSE 'granularity:' || spatial_granularity END AS problem FROM s WHERE name = '' OR spatial_granularity = 'village'")
def n14_rejected(t):
    p = t("part")
    rows = p.sparkSession.sql(_SEED.replace("FROM part", "FROM {part}"), part=p)
    known = p.sparkSession.createDataFrame([], "raw string, id string, note string, redistribution boolean")
    return seed.records(rows, known, "https://c.example.org/")[1].select("title", "problem")


_DOC = """
    WITH d AS (SELECT id, title, level, CASE WHEN id % 4 > 0 THEN 'none' END AS restriction, CASE WHEN id % 3 > 0 THEN id % 3 = 1 END AS bulk, CAST(NULL AS BOOLEAN) AS reference_only, CAST(id % 4 AS INT) AS tier, CASE WHEN review_state <> 'draft' THEN review_state END AS review_state FROM datasets),
    f AS (SELECT id, part, CASE WHEN part % 5 > 0 THEN 'c/' || label END AS concept FROM parts), l AS (SELECT 'c/' || p_name AS iri, min(p_name || '!') AS label FROM part WHERE p_size % 3 = 0 GROUP BY 1),
    up AS (SELECT DISTINCT 'c/' || p_name AS node, 'b/' || p_type AS ancestor FROM part),
    x AS (SELECT dataset_id AS id, distribution_id, media_type, CASE WHEN distribution_id % 3 = 0 THEN 'own' END AS restriction, bulk, sliceable AS ranges, protocol, CASE WHEN distribution_id % 7 > 0 THEN health END AS health FROM distributions),
    g AS (SELECT id, 'provenance' AS facet, 'A' AS grade FROM datasets WHERE id % 5 > 0 UNION ALL SELECT id, 'documentation', 'C' FROM datasets WHERE id % 7 > 0 UNION ALL SELECT id, 'currency', 'B' FROM datasets WHERE id % 2 > 0)"""


@query("J1_whole_document", _DOC + """,
    cs AS (SELECT id, string_agg(lb, '|' ORDER BY lb, concept) AS concepts FROM (SELECT DISTINCT id, concept, coalesce(label, substr(concept, 3)) AS lb FROM f LEFT JOIN l ON l.iri = f.concept WHERE concept IS NOT NULL) GROUP BY 1),
    ex AS (SELECT id, string_agg(i, '|' ORDER BY i) AS expanded FROM (SELECT id, concept AS i FROM f WHERE concept IS NOT NULL UNION SELECT id, ancestor FROM f JOIN up ON node = concept) GROUP BY 1),
    fc AS (SELECT id, count(*) AS n FROM f GROUP BY 1), an AS (SELECT id, string_agg(member, '|' ORDER BY member) AS a FROM analysis_of GROUP BY 1),
    px AS (SELECT x.id, count(*) AS n, string_agg(DISTINCT media_type, '|' ORDER BY media_type) AS formats, string_agg(DISTINCT protocol, '|' ORDER BY protocol) AS protocols, bool_or(ranges) AS r, bool_or(x.bulk) AS b, min(CASE health WHEN 'unreachable' THEN 0 WHEN 'degraded' THEN 1 WHEN 'redirected' THEN 2 WHEN 'verified' THEN 3 END) AS h,
        bool_and(coalesce(health = 'unreachable', false)) AS dead, string_agg(coalesce(x.restriction, d.restriction, '?'), '|' ORDER BY distribution_id) AS rs FROM x JOIN d ON d.id = x.id GROUP BY 1),
    gr AS (SELECT id, max(grade) FILTER (facet = 'provenance') AS p, max(grade) FILTER (facet = 'documentation') AS o, max(grade) FILTER (facet = 'currency') AS c FROM g GROUP BY 1),
    us AS (SELECT child AS id, count(DISTINCT parent) AS n FROM derivations GROUP BY 1), ib AS (SELECT target AS id, count(DISTINCT source) AS n FROM referrers GROUP BY 1), en AS (SELECT dataset_id AS id, string_agg(DISTINCT principal_id, '|' ORDER BY principal_id) AS e FROM grants GROUP BY 1)
    SELECT d.id, d.title, coalesce(concepts, '') AS concepts, coalesce(expanded, '') AS expanded, coalesce(a, '') AS analyses, coalesce(fc.n, 0) AS field_count, CASE WHEN fc.n IS NULL THEN 'none' WHEN fc.n < 10 THEN '1-9' WHEN fc.n < 50 THEN '10-49' ELSE '50+' END AS field_count_bucket,
        coalesce(px.n, 0) AS distribution_count, coalesce(formats, '') AS formats, coalesce(protocols, '') AS protocols, coalesce(rs, '') AS restrictions, coalesce(r, false) AS has_range_requests, CASE WHEN b THEN true ELSE d.bulk END AS bulk_download, CASE h WHEN 0 THEN 'unreachable' WHEN 1 THEN 'degraded' WHEN 2 THEN 'redirected' WHEN 3 THEN 'verified' END AS worst_link_health, coalesce(dead, false) AS all_unreachable,
        coalesce(level >= 2 AND p IS NOT NULL AND o IS NOT NULL, false) AS quality_assessed, CASE WHEN level >= 2 AND o IS NOT NULL THEN p END AS provenance, CASE WHEN level >= 2 AND p IS NOT NULL THEN o END AS documentation, c AS currency, coalesce(us.n, 0) AS upstream_count, coalesce(ib.n, 0) AS inbound_link_count, coalesce(e, '') AS principals, tier = 3 AS reference_only, coalesce(review_state, 'draft') AS review_state
    FROM d LEFT JOIN cs ON cs.id = d.id LEFT JOIN ex ON ex.id = d.id LEFT JOIN fc ON fc.id = d.id LEFT JOIN an ON an.id = d.id LEFT JOIN px ON px.id = d.id LEFT JOIN gr ON gr.id = d.id LEFT JOIN us ON us.id = d.id LEFT JOIN ib ON ib.id = d.id LEFT JOIN en ON en.id = d.id""")
def j1(t):
    d, k, p = t("datasets"), F.col("id") % 4, t("part")
    s = d.select("id", "title", "level", F.when(k > 0, "none").alias("restriction"), F.when(F.col("id") % 3 > 0, F.col("id") % 3 == 1).alias("bulk"), F.lit(None).cast("boolean").alias("reference_only"), k.cast("int").alias("tier"), F.when(F.col("review_state") != "draft", F.col("review_state")).alias("review_state"))
    fields = t("parts").select("id", "part", F.when(F.col("part") % 5 > 0, F.concat(F.lit("c/"), "label")).alias("concept"))
    iri = F.concat(F.lit("c/"), "p_name")
    labels = p.where("p_size % 3 = 0").select(iri.alias("iri"), F.concat("p_name", F.lit("!")).alias("label"), F.lit(None).cast("string").alias("notation"))
    closure = p.select(iri.alias("node"), F.concat(F.lit("b/"), "p_type").alias("ancestor")).distinct()
    paths = t("distributions").select(F.col("dataset_id").alias("id"), "distribution_id", "media_type", F.when(F.col("distribution_id") % 3 == 0, "own").alias("restriction"), "bulk", F.col("sliceable").alias("ranges"), "protocol", F.when(F.col("distribution_id") % 7 > 0, F.col("health")).alias("health"))
    grade = lambda f, g, m: d.where(F.col("id") % m > 0).select("id", F.lit(f).alias("facet"), F.lit(g).alias("grade"))
    grades = grade("provenance", "A", 5).union(grade("documentation", "C", 7)).union(grade("currency", "B", 2))
    refs = t("analysis_of").select("id", F.lit("supported_analysis").alias("kind"), F.col("member").alias("iri"))
    up = t("derivations").select(F.col("child").alias("id"), F.col("parent").alias("target"))
    out = document.whole_documents(s, fields, refs, labels, closure, paths, grades, up, reports.inbound_links(t("referrers")), t("grants").select(F.col("dataset_id").alias("id"), F.col("principal_id").alias("principal")))
    text = lambda c, f=None: F.array_join(F.transform(c, lambda x: F.coalesce(x[f], F.lit("?"))) if f else F.col(c), "|")
    return out.select(
        "id", "title", text("concepts", "label").alias("concepts"), text("concept_iris_expanded").alias("expanded"), text("supported_analysis", "iri").alias("analyses"), "field_count", "field_count_bucket", "distribution_count", text("formats").alias("formats"), text("protocols").alias("protocols"),
        text("distributions", "restriction").alias("restrictions"), "has_range_requests", "bulk_download", "worst_link_health", "all_unreachable", "quality_assessed", "provenance", "documentation", "currency", "upstream_count", "inbound_link_count", text("entitled_principals").alias("principals"), "reference_only", "review_state",
    )
