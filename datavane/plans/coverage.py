"""Registered queries for the inventory entries that stand for one rule or one signal of a larger operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixpoint, norm, shared
from ..operators import filters, graph, linkage, meaning, rollups, rules, views
from ..streaming import jobs, relink
from . import catalog
from .catalog import NOW, query


@query("N4_normalise", catalog.SQL["N3_name_tokens"].replace(" || 'Value' || CAST(part AS VARCHAR)", ""))
def n4(t):
    return t("parts").select("part", norm.name_key(F.col("label")).alias("key"))


@query("N14_seed_record", """
    SELECT p_partkey, lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '-', 'g')) AS slug, CASE WHEN p_size % 2 = 0 THEN 'confirmed' ELSE 'draft' END AS review_state,
        CASE p_type WHEN 'ECONOMY' THEN 'modeled' ELSE 'curated' END AS provenance, 1 + CAST(p_size % 3 = 0 AS INT) AS distributions FROM part""")
def n14(t):
    dist = F.array_compact(F.array(F.struct(F.lit("primary").alias("kind"), F.col("p_brand").alias("url")), F.when(F.col("p_size") % 3 == 0, F.struct(F.lit("secondary").alias("kind"), F.col("p_type").alias("url")))))
    rec = t("part").select("p_partkey", norm.slugify(F.col("p_name")).alias("slug"), F.when(F.col("p_size") % 2 == 0, "confirmed").otherwise("draft").alias("review_state"), norm.provenance_class(F.when(F.col("p_type") == "ECONOMY", "modelled")).alias("provenance"), dist.alias("d"))
    return rec.select("p_partkey", "slug", "review_state", "provenance", F.size("d").alias("distributions"))


@query("R8_relevance_order", "SELECT id, row_number() OVER (ORDER BY round(acctbal, 0) DESC NULLS LAST, lower(title), id) AS place FROM datasets")
def r8(t):
    d = t("datasets").select("id", "title", F.round("acctbal", 0).alias("relevance"))
    return filters.placed(d, ("relevance", True), ("title", False), tie="id").select("id", "place")


def _signal(name: str, column: str, sql: str, *overlaps: str):
    @query(name, catalog._SIG + f"SELECT source, target, round({sql}, 6) AS value FROM sg")
    def one(t):
        return catalog._signals(t, overlaps).select("source", "target", F.round(column, 6).alias("value"))


_signal("L2_concept_overlap", "concept_overlap", "concept_overlap", "concept_overlap")
_signal("L3_geographic_overlap", "geographic_overlap", "geographic_overlap", "place")
_signal("L4_temporal_overlap", "temporal_overlap", "temporal_overlap")
_signal("L5_joinable_key", "joinable_key_present", "joinable_key_present", "keys")
_signal("L6_workflow_overlap", "workflow_tag_overlap", "workflow_tag_overlap", "workflow_tag_overlap")
_signal("L7_quality_contribution", "quality_contribution", "quality_contribution")


@query("L13_surfaced", catalog._STR + "SELECT source, target FROM st WHERE correlated OR (score > 0 AND has_reason)")
def l13(t):
    return linkage.surfaced(catalog._scored(t)).select("source", "target")


@query("M3_near_ties", """
    WITH s AS (SELECT dataset_id AS part, distribution_id AS concept, round(0.2 + (distribution_id % 9) * 0.03, 6) AS score FROM distributions),
    r AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY part ORDER BY score DESC, concept))
    SELECT part, CASE WHEN score >= 0.25 AND (second IS NULL OR round(score - second, 9) >= 0.05) THEN concept END AS concept, score FROM r WHERE n = 1""")
def m3(t):
    s = t("distributions").select(F.col("dataset_id").alias("part"), F.col("distribution_id").alias("concept"), F.round(0.2 + (F.col("distribution_id") % 9) * 0.03, 6).alias("score"))
    return meaning.resolve_by_score(s).select("part", "concept", "score")


@query("M5_lexical_score", """
    WITH q AS (SELECT part, list_distinct(string_split(label || CASE WHEN definition IS NULL THEN '' ELSE ' ' || lower(definition) END, ' ')) AS q FROM parts),
    c AS (SELECT p_name AS concept, list_distinct(string_split(p_name || ' alt', ' ')) AS l, list_distinct([lower(min(p_type))]) AS d FROM part GROUP BY 1)
    SELECT part, concept, round(0.7 * len(list_intersect(q, l)) / (len(q) + len(l) - len(list_intersect(q, l))) + 0.3 * len(list_intersect(q, d)) / len(q), 5) AS score FROM q JOIN c ON len(list_intersect(q, list_concat(l, d))) > 0""")
def m5(t):
    return meaning.lexical_scores(catalog._asked_parts(t), catalog._concepts(t)).withColumn("score", F.round("score", 5))


@query("M11_traced", "SELECT d.id, coalesce(n, CASE WHEN d.id = 0 THEN 1 ELSE 0 END) AS traced FROM datasets d LEFT JOIN (SELECT child, count(DISTINCT parent) AS n FROM lineage GROUP BY 1) ON child = d.id")
def m11(t):
    d = t("datasets").select("id", "level", F.when(F.col("id") == 0, False).alias("uncaptured"))
    return meaning.provenance_grades(d, t("lineage").select(F.col("child").alias("id"), F.col("parent").alias("source")), t("parts")).select("id", "traced")


@query("M15_rationale", catalog._DOC + "SELECT d.id, printf('%d of %d fields are fully documented', coalesce(ok, 0), coalesce(n, 0)) AS rationale FROM datasets d LEFT JOIN p ON p.id = d.id")
def m15(t):
    d = t("datasets").select("id", "level", F.lit(None).cast("string").alias("status"), F.lit(False).alias("conforms"))
    return meaning.documentation_grades(d, t("parts")).select("id", F.format_string("%d of %d fields are fully documented", "documented", "fields").alias("rationale"))


def _rule(name: str, rule, sql: str):
    @query(name, f"SELECT id FROM datasets WHERE {sql}")
    def one(t):
        return rules.violations(t("datasets").withColumns({"tags": F.when(F.col("level") > 1, F.array("title")), "nation_id": F.col("nation"), "shifted": F.col("id") % 25, "touched": F.when(F.col("id") % 3 > 0, F.col("modified"))}), [rule()]).select("id")


_rule("V2_cardinality", lambda: rules.min_count("tags", 1), "level = 1")
_rule("V3_value_rules", lambda: rules.between("resolution_m", 10, 500), "resolution_m NOT BETWEEN 10 AND 500")
_rule("V5_either_or", lambda: rules.either("cadence", "touched"), "cadence IS NULL AND (modified IS NULL OR id % 3 = 0)")
_rule("V6_conditional", lambda: rules.implies("extent", "west", F.col("level") == 3, F.col("west").isNotNull() & F.col("cadence").isNotNull()), "level = 3 AND (west IS NULL OR cadence IS NULL)")
_rule("V7_self_reference", lambda: rules.not_self("nation_id", "shifted"), "nation = id % 25")
_rule("V8_registry_rules", lambda: rules.pattern("iri", "[02468]$"), "NOT regexp_matches(iri, '[02468]$')")


@query("V11_located", "SELECT bus_id FROM buses WHERE bus_id NOT IN (SELECT bus0 FROM arcs) AND bus_id NOT IN (SELECT bus1 FROM arcs)")
def v11(t):
    return views.unlocated(t("buses"), t("arcs"))


@query("V13_recomputed", "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'missing' ELSE 'differs' END AS why FROM part WHERE p_size % 7 = 0 OR p_size % 5 = 0")
def v13(t):
    p = t("part").select("p_partkey", "p_size", F.col("p_retailprice").alias("v"))
    stated = p.where("p_size % 7 <> 0").withColumn("v", F.when(F.col("p_size") % 5 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return views.recomputed(p, stated, "p_partkey", "v")


@query("X2_main_component", catalog._COMP + ", z AS (SELECT component, count(*) AS c FROM k GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1), m AS (SELECT node FROM k WHERE component = (SELECT component FROM z)) SELECT arc_id FROM arcs WHERE bus0 IN (SELECT node FROM m) AND bus1 IN (SELECT node FROM m)")
def x2(t):
    main = fixpoint.cut(graph.largest_component(*catalog._net(t)))
    return t("arcs").join(main.withColumnRenamed("node", "bus0"), "bus0", "left_semi").join(main.withColumnRenamed("node", "bus1"), "bus1", "left_semi").select("arc_id")


@query("X6_per_unit", "SELECT p_partkey, round(p_size / 100.0, 6) AS p_pu, round(p_retailprice / 1000.0, 6) AS q_pu FROM part")
def x6(t):
    d = t("part").select("p_partkey", F.col("p_size").alias("p"), F.col("p_retailprice").alias("q"))
    return views.per_unit(d, {"p": 100.0, "q": 1000.0}).select("p_partkey", "p_pu", "q_pu")


@query("X11_ring_prefilter", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING min(l_quantity) <= 20 AND max(l_quantity) >= 10 AND min(l_discount) <= 0.03 AND max(l_discount) >= 0.01")
def x11(t):
    return rollups.bounds_meet(t("lineitem"), "l_orderkey", "l_quantity", "l_discount", (10, 0.01, 20, 0.03))


@query("G5_lineage_neighbours", "WITH RECURSIVE c(n, a) AS (SELECT narrower, broader FROM broader UNION SELECT c.n, b.broader FROM c JOIN broader b ON c.a = b.narrower), s AS (SELECT n, a FROM c WHERE n LIKE 'S%' UNION SELECT 'S' || id, 'S' || id FROM datasets) SELECT DISTINCT x.n AS a, y.n AS b FROM s x JOIN s y ON x.a = y.a AND x.n < y.n")
def g5(t):
    c = fixpoint.closure(t("broader"), "narrower", "broader")
    return graph.lineage_neighbours(c, t("datasets").select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("node")))


@query("G5_origin_lists", """WITH RECURSIVE c(n, a) AS (SELECT narrower, broader FROM broader UNION SELECT c.n, b.broader FROM c JOIN broader b ON c.a = b.narrower),
    own AS (SELECT a AS origin, n AS node FROM c UNION SELECT n, n FROM c UNION SELECT 'S' || id, 'S' || id FROM datasets), k AS (SELECT origin, node, node IN (SELECT n FROM c) AS derived FROM own)
    SELECT origin, count(*) AS members, count(*) FILTER (derived) AS derived, count(*) * count(*) FILTER (derived) - count(*) FILTER (derived) AS pairs FROM k GROUP BY 1""")
def g5o(t):
    c = fixpoint.closure(t("broader"), "narrower", "broader")
    return linkage.origin_counts(linkage.lineage_origins(c, t("datasets").select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("id"))))


@query("G10_materialised", catalog._ENT + "SELECT rule, s, o FROM e")
def g10(t):
    return catalog._entailed(t)[0]


@query("U2_embedding_backend", "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 4) AS self FROM embeddings")
def u2(t):
    return t("embeddings").select("vec_id", F.round(meaning.cosine(F.col("embedding"), F.col("embedding")), 4).alias("self"))


@query("U4_named_query", "SELECT id, title FROM datasets WHERE level = 2 AND data_domain = 'ASIA'")
def u4(t):
    d = t("datasets")
    return d.sparkSession.sql("SELECT id, title FROM {d} WHERE level = :level AND data_domain = :domain", {"level": 2, "domain": "ASIA"}, d=d)


@query("ST8_scheduled_regrade", catalog.SQL["M8_currency"].replace("2003-06-01", "2001-06-01"))
def st8(t):
    d = t("datasets").join(t("coverage"), "id", "left")
    return d.select("id", meaning.currency_grade(F.col("superseded_by"), F.col("cadence"), F.col("modified"), F.lit(None).cast("date"), F.col("t_end"), NOW.replace(year=2001)).alias("grade"))


_TOLD = "concept_of AS (SELECT DISTINCT l_suppkey AS id, l_partkey AS member FROM lineitem WHERE l_suppkey IN (SELECT user_id FROM events)), "


@query("ST7_relink_targets", catalog._STR.replace("WITH RECURSIVE", f"WITH RECURSIVE {_TOLD}", 1) + "SELECT source, target, rank FROM top")
def st7(t):
    """Records whose concepts become known only with their first commit; the log comes in four parts."""
    events = t("events").select(F.col("user_id").alias("id"))
    spark = events.sparkSession
    at = shared.folder(spark, "commits")
    for k in range(4):
        events.where(F.pmod("id", F.lit(4)) == k).coalesce(1).write.mode("append").parquet(at)
    up = shared.saved(catalog._upstream(t), "upstream")

    def tables_at(known):
        now = lambda name: t(name).join(known, "id", "left_semi") if name == "concept_of" else t(name)
        return relink.LinkTables(catalog._keys(now), t("datasets").select("id", "title"), up, t("referrers").select("source", "target"), catalog._profiles(now, up))

    commits = jobs.opened(spark, at, 1)
    return relink.latest(relink.relinked(commits, tables_at, lambda pairs, profile: catalog._strong(catalog._signalled(pairs, profile)), "st7"))


@query("X1_both_ends", "SELECT a.country, count(*) AS arcs FROM arcs JOIN buses a ON a.bus_id = bus0 JOIN buses b ON b.bus_id = bus1 WHERE a.country = b.country GROUP BY 1")
def x1b(t):
    b = t("buses").select("bus_id", "country")
    d = t("arcs").join(b.select(F.col("bus_id").alias("bus0"), "country"), "bus0").join(b.select(F.col("bus_id").alias("bus1"), F.col("country").alias("other")), "bus1")
    return d.where("country = other").groupBy("country").agg(F.count("*").alias("arcs"))

