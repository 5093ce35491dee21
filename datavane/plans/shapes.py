"""Registered queries of the rules over nodes; their SQL states each violation as a condition on the views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import shared
from ..operators import nodes
from .catalog import query


def _nodes(rows, record: Column, node: Column, of_type: str, /, **props: Column):
    """Nodes from a table; a null column states nothing."""
    pairs = [x for k, v in props.items() for x in (F.lit(k), F.array_compact(F.array(v.cast("string"))))]
    return rows.select(record.alias("record"), node.alias("node"), F.lit(of_type).alias("type"), F.create_map(*pairs).alias("props"))


def _written(out, more):
    """All nodes as a written table, as a catalogue holds them: the rules read it several times."""
    for m in more:
        out = out.unionByName(m)
    return shared.saved(out, "nodes")


def _if(condition: str, value) -> Column:
    return F.when(F.expr(condition), value if isinstance(value, Column) else F.lit(value))


def _catalogue(t):
    d, x, p = t("datasets"), t("distributions"), t("parts")
    ref = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    title = F.col("title")
    out = _nodes(
        d, F.col("id"), ref("D", "id"), "Dataset", title=title, description=_if("id % 6 <> 0", title), domain=F.col("data_domain"), provenance_class=_if("id % 5 <> 1", "curated"), provenance_gap=_if("id % 10 = 1", ref("G", "id")),
        license=_if("id % 4 <> 1", F.when(F.expr("id % 4 = 0"), "CC BY").otherwise("https://example.org/licence")), access_restriction=F.lit("none"), anonymous_access=F.lit("true"), documentation_status=F.lit("partial"), completeness_level=F.expr("id % 5"),
        review_state=F.col("review_state"), harvest_source=F.lit("curated"), distribution=_if("id % 3 <> 0", ref("X", "id")), reference_only=_if("id % 6 = 0", "true"), pointer_rationale=_if("id % 12 = 0", "closed"), geospatial_primary=_if("id % 2 = 0", "true"),
        west=F.col("west"), south=F.col("south"), east=F.col("east"), north=F.col("north"), native_crs=_if("id % 4 <> 2", "EPSG:4326"), geometry_types=F.lit("raster"), superseded_by=_if("id % 9 = 4", ref("D", "id")),
        spatial_granularity=F.expr("CASE id % 8 WHEN 0 THEN 'nodal' WHEN 1 THEN 'zonal' WHEN 2 THEN 'gridded' WHEN 3 THEN 'hourly' END"), cadence=F.col("cadence"), visibility=F.col("visibility"), field=_if("id % 2 = 0", ref("F", "id")),
        resolution_m=F.expr("CASE WHEN id % 10 = 9 THEN '0' ELSE '250.5' END"), enrichment_basis=F.expr("CASE id % 10 WHEN 3 THEN 'inferred' WHEN 5 THEN 'guess' END"), enrichment_model=F.lit("m"), enrichment_prompt_version=_if("id % 20 <> 3", "2"),
    )
    more = [
        _nodes(d.where("id % 10 = 1"), F.col("id"), ref("G", "id"), "ProvenanceGap", reason=_if("id % 20 = 1", "not told")),
        _nodes(d, F.col("id"), ref("E", "id"), "QualityGrade", facet=F.expr("CASE id % 4 WHEN 0 THEN 'provenance' WHEN 1 THEN 'documentation' WHEN 2 THEN 'currency' ELSE 'composite' END"), grade=F.expr("CASE id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'C' ELSE 'E' END"), rationale=_if("id % 5 <> 0", "seen")),
        _nodes(
            x, F.col("dataset_id"), ref("X", "distribution_id"), "Distribution", access_url=F.col("url"), byte_size=F.expr("CASE distribution_id % 7 WHEN 0 THEN '-3' WHEN 1 THEN 'many' ELSE '10' END"), protocol=F.expr("CASE WHEN distribution_id % 11 = 5 THEN 'ftp' ELSE protocol END"),
            range_requests=_if("sliceable", "true"), chunk_index=F.col("chunk_index"), hosted=_if("bulk", "true"), refresh_owner=_if("reachable", "owner"), hosting_reason=F.expr("CASE distribution_id % 3 WHEN 0 THEN 'registered' WHEN 1 THEN 'because' END"),
        ),
        _nodes(x, F.col("dataset_id"), ref("H", "distribution_id"), "LinkHealth", status=F.expr("CASE distribution_id % 13 WHEN 2 THEN 'broken' WHEN 3 THEN NULL ELSE health END")),
        _nodes(
            p, F.col("id"), ref("F", "part"), "Field", local_name=F.col("label"), label=F.col("label"), definition=F.col("definition"), data_type=F.col("data_type"), value_basis=F.col("value_basis"), unit=F.col("unit"), field_source=_if("part % 2 = 0", "source"),
            concept=F.expr("'K' || CAST(part % 9 AS STRING)"), concept_gap=_if("part % 9 = 8", ref("Q", "part")), inferred_assignment=_if("part % 10 = 4", "true"), inference_basis=_if("part % 20 = 4", "label"),
        ),
        _nodes(p.where("part % 9 = 8"), F.col("id"), ref("Q", "part"), "ConceptGap", reason=_if("part % 2 = 0", "none fits")),
    ]
    return _written(out, more)


def _schemes(spark):
    rows = [("data-domain", c) for c in ("AFRICA", "AMERICA", "ASIA", "EUROPE")] + [("provenance-class", "curated"), ("access-restriction", "none")] + [("grid-concept", f"K{i}") for i in range(7)]
    return spark.createDataFrame(rows, "scheme string, concept string")


def _stated(faults) -> str:
    """SQL that lists (source, record, letter of the node, key, target, level, constraint, path, value, condition) as rows."""
    q = lambda v: "NULL" if v is None else f"'{v}'"
    return " UNION ALL ".join(f"SELECT {rec} AS record, '{letter}' || {key} AS node, '{target}' AS target, {level} AS level, '{kind}' AS \"constraint\", {q(path)} AS path, CAST({value} AS VARCHAR) AS value FROM {src} WHERE {cond}" for src, rec, letter, key, target, level, kind, path, value, cond in faults)


_D, _X, _H, _F = ("datasets", "id", "D", "id", "Dataset"), ("distributions", "dataset_id", "X", "distribution_id", "Distribution"), ("distributions", "dataset_id", "H", "distribution_id", "LinkHealth"), ("parts", "id", "F", "part", "Field")
_E = ("datasets", "id", "E", "id", "QualityGrade")
_FAULTS = _stated([
    (*_D, 1, "MinCount", "description", "NULL", "id % 6 = 0"), (*_D, 1, "MinCount", "license", "NULL", "id % 4 = 1"), (*_D, 1, "Pattern", "license", "'CC BY'", "id % 4 = 0"), (*_D, 1, "In", "visibility", "visibility", "visibility NOT IN ('public', 'restricted-metadata', 'allowlisted-existence')"),
    (*_D, 1, "In", "spatial_granularity", "'hourly'", "id % 8 = 3"), (*_D, 1, "MinInclusive", "completeness_level", "'0'", "id % 5 = 0"), (*_D, 1, "MaxInclusive", "completeness_level", "'4'", "id % 5 = 4"), (*_D, 3, "MinCount", "field", "NULL", "id % 2 = 1"),
    (*_D, 1, "SPARQL", None, "NULL", "id % 3 = 0 AND id % 6 <> 0"), (*_D, 1, "SPARQL", None, "NULL", "id % 6 = 0 AND id % 12 <> 0"), (*_D, 2, "SPARQL", None, "NULL", "id % 9 = 4"), *[(*_D, 1, "MinCount", p, "NULL", f"id % 2 = 0 AND {p} IS NULL") for p in ("west", "south", "east", "north")],
    (*_D, 1, "MinCount", "native_crs", "NULL", "id % 4 = 2"), (*_D, 1, "MinExclusive", "resolution_m", "'0'", "id % 10 = 9"), (*_D, 1, "In", "enrichment_basis", "'guess'", "id % 10 = 5"), (*_D, 1, "SPARQL", None, "NULL", "id % 20 = 3"),
    (*_D, 1, "Node", "domain", "data_domain", "data_domain NOT IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE')"), (*_D, 1, "Or", None, "NULL", "id % 5 = 1 AND id % 20 <> 1"), ("datasets", "id", "G", "id", "ProvenanceGap", 1, "MinCount", "reason", "NULL", "id % 10 = 1 AND id % 20 <> 1"),
    (*_E, 2, "In", "facet", "'composite'", "id % 4 = 3"), (*_E, 2, "In", "grade", "'E'", "id % 3 = 2"), (*_E, 2, "MinCount", "rationale", "NULL", "id % 5 = 0"), (*_E, 2, "SPARQL", None, "NULL", "id % 4 = 2 AND id % 3 = 1"),
    (*_X, 1, "MinCount", "access_url", "NULL", "url IS NULL"), (*_X, 1, "MinInclusive", "byte_size", "'-3'", "distribution_id % 7 = 0"), (*_X, 1, "Datatype", "byte_size", "'many'", "distribution_id % 7 = 1"), (*_X, 1, "In", "protocol", "'ftp'", "distribution_id % 11 = 5"),
    (*_X, 1, "MinCount", "chunk_index", "NULL", "sliceable AND chunk_index IS NULL"), (*_X, 1, "MinCount", "refresh_owner", "NULL", "bulk AND NOT reachable"), (*_X, 1, "MinCount", "hosting_reason", "NULL", "bulk AND distribution_id % 3 = 2"), (*_X, 1, "In", "hosting_reason", "'because'", "bulk AND distribution_id % 3 = 1"),
    (*_H, 1, "In", "status", "'broken'", "distribution_id % 13 = 2"), (*_H, 1, "MinCount", "status", "NULL", "distribution_id % 13 = 3"),
    (*_F, 2, "MinCount", "definition", "NULL", "definition IS NULL"), (*_F, 2, "MinCount", "value_basis", "NULL", "value_basis IS NULL"), (*_F, 2, "In", "value_basis", "value_basis", "value_basis NOT IN ('measured', 'estimated', 'modeled', 'synthetic')"), (*_F, 3, "Pattern", "unit", "unit", "unit IS NOT NULL"),
    (*_F, 2, "SPARQL", None, "NULL", "value_basis = 'modeled' AND part % 2 = 1"), (*_F, 3, "MinCount", "inference_basis", "NULL", "part % 20 = 14"), (*_F, 3, "Or", None, "NULL", "part % 9 = 7 OR (part % 9 = 8 AND part % 2 = 1)"), ("parts", "id", "Q", "part", "ConceptGap", 3, "MinCount", "reason", "NULL", "part % 9 = 8 AND part % 2 = 1"),
])


def _judged(t):
    every = _catalogue(t)
    return every, nodes.violations(every, [*nodes.record_rules(), *nodes.reference_rules(every, _schemes(every.sparkSession))])


@query("V1_nodes", _FAULTS)
def v1_nodes(t):
    return _judged(t)[1].drop("message", "severity")


@query("V6_conditional_report", f"WITH v AS ({_FAULTS}) SELECT row_number() OVER (ORDER BY record, node, coalesce(path, ''), value) AS place, record, node, path FROM v WHERE \"constraint\" = 'MinCount' AND (path IN ('west', 'south', 'east', 'north', 'native_crs', 'chunk_index', 'refresh_owner', 'hosting_reason', 'inference_basis'))")
def v6_report(t):
    wanted = ("west", "south", "east", "north", "native_crs", "chunk_index", "refresh_owner", "hosting_reason", "inference_basis")
    return nodes.report(nodes.violations(_catalogue(t), [r for r in nodes.record_rules() if r.constraint == "MinCount" and r.path in wanted])).select("place", "record", "node", "path")


@query("V9_record_conformance", f"WITH v AS ({_FAULTS}), r AS (SELECT id AS record FROM datasets UNION SELECT dataset_id FROM distributions UNION SELECT id FROM parts) SELECT r.record, count(v.level) AS violations, 0::BIGINT AS warnings, count(v.level) = 0 AS conforms, coalesce(min(v.level), 4) - 1 AS passing FROM r LEFT JOIN v ON v.record = r.record GROUP BY 1")
def v9_conformance(t):
    return nodes.conformance(*_judged(t))


def _registry(t):
    lit, key = F.lit, lambda letter, k: F.concat(F.lit(letter), F.col(k).cast("string"))
    tables = [
        _nodes(
            t("customer"), F.col("c_custkey"), key("S", "c_custkey"), "Study", title=F.col("c_name"), kind=F.expr("CASE c_custkey % 5 WHEN 0 THEN 'filing' WHEN 1 THEN 'intervention' WHEN 2 THEN 'academic' WHEN 3 THEN 'reanalysis' ELSE 'blog' END"), publisher=_if("c_custkey % 7 <> 0", "p"), analysis_type=lit("irp"),
            assumption_set=_if("c_custkey % 6 <> 0", "A1"), frozen_at=_if("c_custkey % 3 = 0", "2003-01-01"), citation=_if("c_custkey % 4 <> 0", "c"), parent_study=F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'S' || CAST(floor(c_custkey / 2) AS STRING) WHEN c_custkey % 22 = 11 THEN 'S' || CAST(c_custkey AS STRING) END"),
        ),
        _nodes(t("supplier"), F.col("s_suppkey"), key("A", "s_suppkey"), "AssumptionSet", title=F.col("s_name"), schema_pin=F.expr("CASE WHEN s_suppkey % 4 = 1 THEN 'v1.2' ELSE sha1(s_name) END"), assumption=lit("P1"), receipt_errors=F.expr("CASE WHEN s_suppkey % 5 = 0 THEN '2' ELSE '0' END"), forked_from=_if("s_suppkey % 6 = 2", key("A", "s_suppkey"))),
        _nodes(t("part"), F.col("p_partkey"), key("P", "p_partkey"), "Assumption", path=F.col("p_name"), value=F.col("p_retailprice"), value_basis=F.expr("CASE WHEN p_partkey % 6 = 0 THEN 'guessed' ELSE 'modeled' END"), field_source=_if("p_partkey % 5 <> 3", "s")),
        _nodes(t("nation"), F.col("n_nationkey"), key("M", "n_nationkey"), "ReferenceModel", fidelity=F.expr("CASE n_nationkey % 4 WHEN 0 THEN 'authoritative' WHEN 1 THEN 'screening' WHEN 2 THEN 'indicative' ELSE 'good' END"), question_class=key("Q", "n_nationkey")),
        _nodes(t("nation"), F.col("n_nationkey"), key("Q", "n_nationkey"), "QuestionClass", question=F.col("n_name"), robustness=F.expr("CASE n_nationkey % 3 WHEN 0 THEN 'robust' WHEN 1 THEN 'fragile' ELSE 'sure' END"), basis=_if("n_nationkey % 5 <> 0", "b")),
        _nodes(
            t("orders"), F.col("o_orderkey"), key("R", "o_orderkey"), "RunRecord", assumption_set=lit("A1"), reference_model=lit("M1"), executed_by=_if("o_orderkey % 8 <> 0", "e"), case_hash=F.expr("CASE WHEN o_orderkey % 9 = 0 THEN md5(CAST(o_orderkey AS STRING)) ELSE sha2(CAST(o_orderkey AS STRING), 256) END"), tool=lit("t"),
            tool_version=_if("o_orderkey % 10 <> 0", "1"), executed_at=F.col("o_orderdate"), objective=_if("o_orderkey % 2 = 0", F.col("o_totalprice")), objective_unit=_if("o_orderkey % 3 = 0", "EUR"), wall_seconds=F.expr("CASE WHEN o_orderkey % 11 = 0 THEN '-1' ELSE '1.5' END"),
        ),
    ]
    return _written(tables[0], tables[1:])


_S, _A, _P = ("customer", "c_custkey", "S", "c_custkey", "Study", 1), ("supplier", "s_suppkey", "A", "s_suppkey", "AssumptionSet", 1), ("part", "p_partkey", "P", "p_partkey", "Assumption", 1)
_M, _Q, _R = ("nation", "n_nationkey", "M", "n_nationkey", "ReferenceModel", 1), ("nation", "n_nationkey", "Q", "n_nationkey", "QuestionClass", 1), ("orders", "o_orderkey", "R", "o_orderkey", "RunRecord", 1)


@query("V8_registry_entries", _stated([
    (*_S, "In", "kind", "'blog'", "c_custkey % 5 = 4"), (*_S, "MinCount", "publisher", "NULL", "c_custkey % 7 = 0"), (*_S, "MinCount", "assumption_set", "NULL", "c_custkey % 6 = 0"), (*_S, "SPARQL", None, "NULL", "c_custkey % 12 = 0"), (*_S, "SPARQL", None, "NULL", "c_custkey % 5 = 1 AND c_custkey % 2 = 1 AND c_custkey % 22 <> 11"), (*_S, "SPARQL", None, "NULL", "c_custkey % 22 = 11 OR c_custkey = 0"),
    (*_A, "Pattern", "schema_pin", "'v1.2'", "s_suppkey % 4 = 1"), (*_A, "MaxInclusive", "receipt_errors", "'2'", "s_suppkey % 5 = 0"), (*_A, "SPARQL", None, "NULL", "s_suppkey % 6 = 2"), (*_P, "In", "value_basis", "'guessed'", "p_partkey % 6 = 0"), (*_P, "MinCount", "field_source", "NULL", "p_partkey % 5 = 3"),
    (*_M, "In", "fidelity", "'good'", "n_nationkey % 4 = 3"), (*_M, "SPARQL", None, "NULL", "n_nationkey % 20 = 0"), (*_Q, "In", "robustness", "'sure'", "n_nationkey % 3 = 2"), (*_Q, "SPARQL", None, "NULL", "n_nationkey % 15 = 0"),
    (*_R, "MinCount", "executed_by", "NULL", "o_orderkey % 8 = 0"), (*_R, "Pattern", "case_hash", "md5(CAST(o_orderkey AS VARCHAR))", "o_orderkey % 9 = 0"), (*_R, "MinCount", "tool_version", "NULL", "o_orderkey % 10 = 0"), (*_R, "SPARQL", None, "NULL", "o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0"), (*_R, "MinInclusive", "wall_seconds", "'-1'", "o_orderkey % 11 = 0"),
]))
def v8_entries(t):
    every = _registry(t)
    return nodes.violations(every, [*nodes.registry_rules(), nodes.authority_rule(every)]).drop("message", "severity")
