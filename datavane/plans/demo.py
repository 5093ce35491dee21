"""Catalogue-shaped views of the driver's tables, as SQL that both Spark and DuckDB understand."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "datasets": """
        SELECT s_suppkey AS id, s_name AS title, n_name AS publisher, r_name AS data_domain, s_nationkey AS nation, s_acctbal AS acctbal,
            CAST(1 + s_suppkey % 3 AS INT) AS level,
            CASE s_suppkey % 5 WHEN 0 THEN 'draft' WHEN 1 THEN 'auto-confirmed' ELSE 'confirmed' END AS review_state,
            CASE s_suppkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'allowlisted-metadata' ELSE 'allowlisted-existence' END AS visibility,
            CASE WHEN s_suppkey % 7 <> 0 THEN CAST((s_nationkey * 37) % 300 - 170 AS DOUBLE) END AS west,
            CASE WHEN s_suppkey % 7 <> 0 THEN CAST((s_nationkey * 37) % 300 - 170 + 5 + s_suppkey % 20 AS DOUBLE) END AS east,
            CASE WHEN s_suppkey % 7 <> 0 THEN CAST((s_nationkey * 11) % 100 - 60 AS DOUBLE) END AS south,
            CASE WHEN s_suppkey % 7 <> 0 THEN CAST((s_nationkey * 11) % 100 - 60 + 3 + s_suppkey % 15 AS DOUBLE) END AS north,
            CASE s_suppkey % 7 WHEN 0 THEN 'P1Y' WHEN 1 THEN 'P1M' WHEN 2 THEN 'irregular' WHEN 3 THEN 'discontinued' WHEN 4 THEN 'P7D' WHEN 5 THEN 'P' END AS cadence,
            CASE WHEN s_suppkey % 13 <> 0 THEN DATE '1998-01-01' + CAST(s_suppkey * 37 % 2500 AS INT) END AS modified,
            CASE WHEN s_suppkey % 17 = 3 THEN s_suppkey + 1 END AS superseded_by,
            CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey * 10 END AS resolution_m,
            'https://data.example.org/dataset/' || s_name AS iri
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "coverage": """
        SELECT l_suppkey AS id, CASE WHEN l_suppkey % 11 <> 0 THEN CAST(min(l_shipdate) AS DATE) END AS t_start,
            CASE WHEN l_suppkey % 19 <> 0 THEN CAST(max(l_shipdate) AS DATE) END AS t_end FROM lineitem GROUP BY l_suppkey""",
    "concept_of": "SELECT DISTINCT l_suppkey AS id, l_partkey AS member FROM lineitem",
    "analysis_of": "SELECT DISTINCT l_suppkey AS id, p_brand AS member FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity >= 45",
    "lineage": """
        SELECT p_partkey AS child, CAST(floor(p_partkey / 2) AS BIGINT) AS parent, 'derived' AS kind FROM part WHERE p_partkey > 1
        UNION ALL SELECT p_partkey AS child, CAST(floor(p_partkey / 3) AS BIGINT) AS parent, 'upstream' AS kind FROM part WHERE p_partkey > 2 AND p_partkey % 5 = 0""",
    "derivations": "SELECT s_suppkey AS child, CAST(floor(s_suppkey / 6) AS BIGINT) AS parent FROM supplier WHERE s_suppkey > 5 AND s_suppkey % 3 <> 0",
    "referrers": "SELECT s_suppkey AS source, CAST(floor(s_suppkey / 6) AS BIGINT) AS target FROM supplier WHERE s_suppkey > 5 AND s_suppkey % 3 <> 0 UNION SELECT s_suppkey, CAST(s_suppkey + 1 AS BIGINT) FROM supplier WHERE s_suppkey % 17 = 3",
    "place_of": "SELECT s_suppkey AS id, 'place' || CAST(s_suppkey % 4 AS VARCHAR(20)) AS member FROM supplier UNION SELECT s_suppkey, 'place' || CAST(s_nationkey % 6 AS VARCHAR(20)) FROM supplier WHERE s_suppkey % 7 <= 3",
    "granularity": "SELECT s_suppkey AS id, CASE s_suppkey % 8 WHEN 0 THEN 'nodal' WHEN 1 THEN 'zonal' WHEN 2 THEN 'gridded' WHEN 3 THEN 'hourly' END AS granularity FROM supplier",
    "broader": """
        SELECT 'N' || n_nationkey AS narrower, 'R' || n_regionkey AS broader FROM nation
        UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier
        UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer""",
    "buses": "SELECT p_partkey AS bus_id, CASE p_size % 4 WHEN 0 THEN 220.0E0 WHEN 1 THEN 275.0E0 WHEN 2 THEN 380.0E0 ELSE 400.0E0 END AS voltage, p_type AS country, CAST(p_partkey % 97 AS DOUBLE) AS x, CAST(p_partkey % 89 AS DOUBLE) AS y FROM part",
    "arcs": "SELECT DISTINCT o_orderkey AS arc_id, CAST(o_custkey AS BIGINT) AS bus0, l_partkey AS bus1, l_quantity * 1013.37E0 AS length, CAST(l_linenumber AS INT) AS circuits FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1 AND l_discount < 0.015 AND o_totalprice > 250000",
    "probes": """
        SELECT event_id AS probe_id, user_id AS distribution_id, ts AS probed_at,
            CASE event_type WHEN 'error' THEN 500 WHEN 'purchase' THEN 301 WHEN 'signup' THEN 403 WHEN 'click' THEN 302 ELSE 200 END AS status,
            CASE user_id % 9 WHEN 4 THEN 's3://bucket/' ELSE 'https://old.example.org/' END || CAST(user_id AS VARCHAR(20)) AS url,
            CASE event_type WHEN 'purchase' THEN 'https://new.example.org/' || CAST(event_id % 2 AS VARCHAR(20)) WHEN 'click' THEN 'https://new.example.org/' || CAST(event_id % 2 AS VARCHAR(20)) END AS location FROM events""",
    "grants": """
        SELECT s_suppkey AS dataset_id, 'user' || CAST(s_suppkey % 10 AS VARCHAR(20)) AS principal_id, CASE WHEN s_suppkey % 4 = 0 THEN 'A' || CAST(s_nationkey AS VARCHAR(20)) || '@Example.org' END AS email,
            CASE WHEN s_suppkey % 6 = 0 THEN TIMESTAMP '2000-01-01 00:00:00' WHEN s_suppkey % 6 = 1 THEN TIMESTAMP '2030-01-01 00:00:00' END AS expires_at,
            CASE WHEN s_suppkey % 9 = 0 THEN TIMESTAMP '1999-01-01 00:00:00' END AS revoked_at FROM supplier""",
    "distributions": """
        SELECT p_partkey AS distribution_id, CAST(floor(p_partkey / 4) AS BIGINT) AS dataset_id, p_type AS format_label, CASE WHEN p_size % 3 = 0 THEN 'application/x-parquet' WHEN p_size % 3 = 1 THEN 'text/csv' ELSE 'application/geo+json' END AS media_type,
            p_size % 5 <> 0 AS reachable, p_size % 7 = 0 AS sliceable, CASE WHEN p_size % 10 <> 3 THEN p_size % 2 = 0 END AS anonymous, p_size % 11 = 0 AS requester_pays, p_size % 6 = 0 AS bulk,
            CASE WHEN p_size % 13 = 0 THEN 'opendap' END AS protocol, CASE WHEN p_size % 14 = 0 THEN 'kerchunk' END AS chunk_index,
            CASE WHEN p_size % 17 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 's3://bucket/' || CAST(p_partkey AS VARCHAR(20)) ELSE 'https://data.example.org/' || CAST(p_partkey AS VARCHAR(20)) END AS url,
            CASE p_size % 4 WHEN 0 THEN 'unreachable' WHEN 1 THEN 'degraded' WHEN 2 THEN 'redirected' ELSE 'verified' END AS health FROM part""",
    "parts": """
        SELECT p_partkey AS part, CAST(floor(p_partkey / 10) AS BIGINT) AS id, p_name AS label, CASE WHEN p_size % 3 <> 0 THEN p_type END AS definition, CASE WHEN p_size % 4 <> 0 THEN 'MW' END AS unit,
            CASE WHEN p_size % 5 = 0 THEN 'string' ELSE 'double' END AS data_type, p_size % 9 = 0 AS has_codes, p_size % 6 = 0 AS is_geometry,
            CASE WHEN p_size % 12 = 0 THEN 'point' END AS geometry_type, CASE WHEN p_size % 24 = 0 THEN 'EPSG:4326' END AS crs,
            CASE p_size % 8 WHEN 0 THEN 'measured' WHEN 1 THEN 'modeled' WHEN 2 THEN 'guess' WHEN 3 THEN NULL ELSE 'observed' END AS value_basis FROM part""",
    "runs": """
        SELECT user_id AS source, event_id AS run_id, ts AS started_at, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'succeeded' END AS state,
            CASE WHEN event_id % 3 = 0 THEN 'page' || CAST(event_id AS VARCHAR(20)) END AS checkpoint, event_id % 50 AS seen, event_id % 20 AS accepted, event_id % 7 AS rejected, event_id % 5 AS updated,
            event_id % 11 AS unchanged, event_id % 3 AS flagged, CASE WHEN event_type = 'error' THEN 1 + event_id % 4 ELSE 0 END AS errors FROM events""",
    "gap_register": """
        SELECT p_partkey AS gap, CASE p_size % 7 WHEN 0 THEN 'SPACE' WHEN 1 THEN NULL WHEN 2 THEN 'OCEANS' ELSE r_name END AS data_domain, p_name AS title, DATE '2003-01-01' + CAST(p_partkey % 400 AS INT) AS review_after
        FROM part JOIN region ON r_regionkey = p_size % 5""",
    "thermal_units": """
        SELECT p_type AS system, p_partkey AS name, CASE WHEN p_size % 3 = 0 AND p_size % 4 <> 0 THEN 0.0E0 WHEN p_size % 23 = 5 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS p, 4.0E0 AS pmin, CASE WHEN p_size % 19 = 0 THEN NULL ELSE 45.0E0 END AS pmax,
            p_size % 3 <> 0 AS online, CASE WHEN p_size % 17 = 0 THEN false WHEN p_size % 29 = 0 THEN NULL ELSE true END AS available FROM part""",
    "power_loads": "SELECT p_type AS system, p_partkey AS name, CASE p_type WHEN 'PROMO' THEN 40.0E0 WHEN 'STANDARD' THEN 0.0E0 ELSE p_size * 0.66E0 END AS p FROM part WHERE p_type <> 'ECONOMY'",
    "bus_state": "SELECT p_type AS system, p_partkey AS name, CASE WHEN p_size % 16 = 0 THEN NULL ELSE 0.9E0 + p_size * 0.004E0 END AS v, 0.92E0 AS vmin, 1.08E0 AS vmax FROM part",
    "line_flows": "SELECT o_orderstatus AS system, o_orderkey AS name, CAST(o_orderkey % 30 AS DOUBLE) AS p, CAST(o_custkey % 40 AS DOUBLE) AS q, CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE 40.0E0 END AS rating FROM orders",
}


def with_clauses(sql: str) -> list[str]:
    """The views that a statement needs, those that others build on first."""
    out: list[str] = []

    def add(text):
        for name, body in VIEWS.items():
            if re.search(rf"\b(FROM|JOIN)\s+{name}\b", text) and name not in out:
                add(body)
                out.append(name)

    add(sql)
    return out


def oracle(sql: str) -> str:
    """The statement with its views, for DuckDB."""
    named = ", ".join(f"{n} AS ({VIEWS[n]})" for n in with_clauses(sql) if not re.search(rf"\b{n} AS \(", sql))
    sql = sql.strip()
    if not named:
        return sql
    if sql.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {named}, {sql[len('WITH RECURSIVE'):]}"
    return f"WITH {named}, {sql[4:]}" if sql.upper().startswith("WITH ") else f"WITH {named} {sql}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or one of the driver's tables."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    body = VIEWS[name]
    used = [t for t in BASE if re.search(rf"\b(FROM|JOIN)\s+{t}\b", body)]
    for t in used:
        body = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", body)
    return spark.sql(body, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
