"""Registered queries of readers and writers: each writes files derived from the tables to the shared folder and reads them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import shared
from ..operators import meaning
from ..sources import documents, loaders
from . import catalog, demo
from .records import stream


def _documents(df, wrap, each: int = 500):
    """JSON documents of the rows' structs, about `each` rows to a document, so their number follows the rows and none grows; each is
    written with a partition of its own."""
    buckets = df.count() // each + 1
    d = df.select(F.pmod(F.xxhash64(df.columns[0]), F.lit(buckets)).alias("bucket"), F.struct(*df.columns).alias("r"))
    return d.groupBy("bucket").agg(wrap(F.collect_list("r")).alias("value"))


def _write_documents(docs, path: str) -> None:
    docs.write.partitionBy("bucket").text(path)  # a folder, and so a file, a bucket


@stream("S1_load_records", "SELECT s_name AS id, s_name || ' title' AS title, CAST(s_suppkey % 3 + 1 AS INT) AS level, 1 AS distributions FROM supplier")
def s1(spark, sf_dir):
    at = shared.folder(spark, "s1")
    s = demo.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("id"), F.lit("Dataset").alias("type"), F.concat("s_name", F.lit(" title")).alias("title"), (F.col("s_suppkey") % 3 + 1).cast("int").alias("completenessLevel"), F.array(F.struct(F.col("s_name").alias("id"), F.lit("http://x").alias("accessURL"))).alias("distribution"))
    _write_documents(_documents(s, F.to_json), at)
    got = loaders.load_records(spark, f"{at}/bucket=*")
    n = got["distributions"].groupBy("dataset_iri").agg(F.count("*").cast("int").alias("distributions"))
    d = got["datasets"].select("id", "title", F.col("completenessLevel").alias("level"))
    return d.join(n, d.id == n.dataset_iri).select("id", "title", "level", "distributions")


@stream("S2_load_seed", "SELECT CAST(s_nationkey AS VARCHAR) AS domain, s_name AS name FROM supplier")
def s2(spark, sf_dir):
    at = shared.folder(spark, "s2")
    rows = F.collect_list(F.struct(F.col("s_name").alias("name"), F.lit("for curators").alias("curator_note")))
    own = F.struct(F.concat(F.lit("N"), F.first("s_nationkey").cast("string")).alias("name"), rows.alias("datasets"))
    # a document has some rows of one domain
    s = demo.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("d"), F.floor(F.col("s_suppkey") / 5000).alias("k")).agg(own.alias("v"))
    s.select(F.concat_ws("-", "d", "k").alias("bucket"), F.to_json(F.struct(F.create_map("d", "v").alias("domains"))).alias("value")).write.partitionBy("bucket").text(at)
    return loaders.load_seed(spark, f"{at}/bucket=*").select("domain", "name")


@stream("S3_load_payloads", "SELECT 'ckan' AS source, CAST(p_partkey AS VARCHAR) AS source_record_id FROM part")
def s3(spark, sf_dir):
    at = shared.folder(spark, "s3")
    p = demo.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    _write_documents(_documents(p, lambda c: F.to_json(F.struct(F.struct(c.alias("results")).alias("result")))), at)
    return loaders.load_payload_pages(spark, "ckan", f"{at}/bucket=*").select("source", "source_record_id")


@stream("S4_load_vocabulary", "SELECT narrower, broader, n_name AS unit FROM broader JOIN nation ON broader = 'N' || n_nationkey")
def s4(spark, sf_dir):
    at = shared.folder(spark, "s4")
    demo.table(spark, sf_dir, "broader").write.parquet(f"{at}/concept_edges")
    demo.table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("concept"), F.col("n_name").alias("unit")).write.parquet(f"{at}/units")
    v = loaders.load_vocabulary(spark, at, ["concept_edges", "units"])
    return v["concept_edges"].join(v["units"], F.col("broader") == F.col("concept")).select("narrower", "broader", "unit")


@stream("S5_load_network", "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS voltage FROM part")
def s5(spark, sf_dir):
    at = shared.folder(spark, "s5")
    b = demo.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("double").alias("voltage"))
    _write_documents(_documents(b, lambda c: F.to_json(F.struct(F.struct(c.alias("buses")).alias("components")))), at)
    return loaders.load_network(spark, f"{at}/bucket=*")["buses"].select("id", "voltage")


@stream("S6_load_wide_csv", "SELECT CAST(bus_id AS VARCHAR) AS line_id, CAST(voltage AS VARCHAR) AS voltage, 'LINESTRING (' || x || ' ' || y || ', 1 2)' AS geometry FROM buses")
def s6(spark, sf_dir):
    at = shared.folder(spark, "s6")
    b = demo.table(spark, sf_dir, "buses")
    line = F.concat_ws(",", F.col("bus_id").cast("string"), F.col("voltage").cast("string"), F.concat(F.lit("LINESTRING ("), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"), F.lit(", 1 2)")))
    b.select(line.alias("value")).write.text(at)
    return loaders.load_wide_csv(spark, at, ["line_id", "voltage", "geometry"])


@stream("S7_load_matpower", "SELECT CAST(p_partkey AS DOUBLE) AS id, CAST(p_size AS DOUBLE) AS pd FROM part")
def s7(spark, sf_dir):
    at = shared.folder(spark, "s7")
    p = demo.table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 500).alias("bucket"), F.concat_ws(" ", F.col("p_partkey").cast("string"), F.col("p_size").cast("string")).alias("row"))
    case = p.groupBy("bucket").agg(F.concat(F.lit("mpc.bus = [\n"), F.array_join(F.collect_list("row"), ";\n"), F.lit("\n];")).alias("value"))
    _write_documents(case, at)
    return loaders.load_matpower(spark, f"{at}/bucket=*", "bus", ["id", "pd"]).select("id", "pd")


@stream("S8_export_snapshot", "SELECT id, title FROM datasets WHERE visibility = 'public'")
def s8(spark, sf_dir):
    at = shared.folder(spark, "s8")
    loaders.export_snapshot({"index": demo.table(spark, sf_dir, "datasets").where("visibility = 'public'").select("id", "title")}, at)
    return spark.read.schema("id long, title string").json(f"{at}/index").select("id", "title")


@stream("S10_replace_output", "SELECT p_partkey, 'second' AS pass FROM part")
def s10(spark, sf_dir):
    at = shared.folder(spark, "s10")
    p = demo.table(spark, sf_dir, "part").select("p_partkey")
    for name in ("first", "second"):
        loaders.replace_output(p.withColumn("pass", F.lit(name)), at, "p_partkey", 8)
    return spark.read.schema("p_partkey long, pass string, bucket long").parquet(at).select("p_partkey", "pass")


@catalog.query("R12_explain_connection", catalog._STR + "SELECT a.id AS source, b.id AS target, CASE WHEN st.source IS NULL THEN 'no connection recorded' ELSE 'linked' END AS connection FROM datasets a JOIN datasets b ON b.id = a.id + 3 LEFT JOIN st ON st.source = a.id AND st.target = b.id")
def r12(t):
    d = t("datasets").select(F.col("id").alias("source"))
    asked = d.select("source", (F.col("source") + 3).alias("target")).join(d.select(F.col("source").alias("target")), "target", "left_semi")
    links = catalog._cand(t).select("source", "target", F.lit("linked").alias("c"))  # a candidate has a score, whatever it is
    return asked.join(links, ["source", "target"], "left").select("source", "target", F.coalesce("c", F.lit("no connection recorded")).alias("connection"))


@catalog.query("U1_similarity_backend", "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 4) AS score FROM embeddings")
def u1(t):
    e = t("embeddings")
    return e.select("vec_id", F.round(meaning.BACKENDS["embedding-cosine"].score(F.col("embedding"), F.col("embedding")), 4).alias("score"))



@stream("S1_record_tables", """
    SELECT 'datasets' AS kind, 'd:' || s_suppkey AS dataset_iri, 'd:' || s_suppkey AS id, s_name AS a, 'confirmed' AS b FROM supplier WHERE s_suppkey % 11 <> 0
    UNION ALL SELECT 'distributions', 'd:' || s_suppkey, 'x:' || s_suppkey, 'http://x/' || s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'text/csv' END FROM supplier WHERE s_suppkey % 11 <> 0
    UNION ALL SELECT 'parts', 'd:' || s_suppkey, 'f:' || s_suppkey, 'balance', 'EUR' FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 2 = 1 UNION ALL SELECT 'grades', 'd:' || s_suppkey, NULL, 'currency', 'B' FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 3 = 0
    UNION ALL SELECT 'bad', NULL, NULL, CASE WHEN s_suppkey % 2 = 0 THEN 'unreadable' ELSE 'no-dataset' END, NULL FROM supplier WHERE s_suppkey % 11 = 0""")
def s1_tables(spark, sf_dir):
    k, word = F.col("s_suppkey"), lambda x: F.concat(F.lit(x), F.col("s_suppkey").cast("string"))
    fields = F.when(k % 2 == 1, F.array(F.struct(word("f:").alias("id"), F.lit("Field").alias("type"), F.lit("balance").alias("localName"), F.lit("EUR").alias("unit"))))
    way = F.struct(word("x:").alias("id"), F.lit("Distribution").alias("type"), word("http://x/").alias("accessURL"), F.when(k % 2 == 0, "text/csv").alias("mediaType"), fields.alias("hasField"))
    own = F.struct(word("d:").alias("id"), F.lit("Dataset").alias("type"), F.col("s_name").alias("title"), F.lit("confirmed").alias("reviewState"))
    grade = F.when(k % 3 == 0, F.to_json(F.struct(F.lit("QualityGrade").alias("type"), F.lit("currency").alias("facet"), F.lit("B").alias("grade"))))
    whole = F.concat(F.lit('{"@graph": ['), F.concat_ws(",", F.to_json(own), F.to_json(way), grade), F.lit("]}"))
    text = F.when(k % 22 == 0, "{broken").when(k % 11 == 0, F.concat(F.lit('{"@graph": ['), F.to_json(way), F.lit("]}"))).otherwise(whole)
    nodes, bad = documents.record_nodes(demo.table(spark, sf_dir, "supplier").select(word("file").alias("file"), text.alias("text")))
    nodes, none = shared.saved(nodes, "nodes"), F.lit(None).cast("string")
    out = bad.select(F.lit("bad").alias("kind"), none.alias("dataset_iri"), none.alias("id"), F.col("problem").alias("a"), none.alias("b"))
    for name, a, b in (("datasets", "title", "review_state"), ("distributions", "access_url", "media_type"), ("parts", "name", "unit"), ("grades", "facet", "grade")):
        out = out.unionByName(documents.table_of(nodes, name).select(F.lit(name).alias("kind"), "dataset_iri", "id", F.col(a).alias("a"), F.col(b).alias("b")))
    return out


@stream("S5_network_elements", """
    WITH b AS (SELECT p_partkey AS id, 'bus' || p_partkey AS name, CASE WHEN p_size % 5 > 0 THEN p_size * 10.0E0 END AS kv, p_size % 3 > 0 AS located, p_partkey // 500 AS sys FROM part),
    l AS (SELECT a.id, greatest(coalesce(a.kv, 0), coalesce(b.kv, 0)) AS kv, a.located AND b.located AS both_at, a.id % 4 AS k FROM b a JOIN b ON b.id = a.id + 1 AND b.sys = a.sys)
    SELECT 'bus-' || id AS key, 'buses' AS layer, name, kv AS voltage, CAST(NULL AS DOUBLE) AS rating, 0 AS points, located FROM b
    UNION ALL SELECT 'line-' || (id + 1000000000), 'lines', 'line', nullif(kv, 0), CASE k WHEN 0 THEN 20.0 WHEN 1 THEN 200.0 END, CASE WHEN k = 2 THEN 3 WHEN both_at THEN 2 ELSE 0 END, false FROM l
    UNION ALL SELECT 'load-' || (id + 2000000000), 'load', '', NULL, 7.0, 0, located FROM b""")
def s5_elements(spark, sf_dir):
    at, k = shared.folder(spark, "s5"), F.col("p_partkey")
    p = demo.table(spark, sf_dir, "part")
    p = p.join(p.select((k - 1).alias("p_partkey"), F.lit(True).alias("more")), "p_partkey", "left").withColumns({"sys": F.floor(k / 500), "k": k % 4})
    some = lambda ok, x: F.array_sort(F.collect_list(F.when(ok, x)))  # noqa: E731  a system has 500 buses
    joined = F.col("more") & (F.floor((k + 1) / 500) == F.col("sys"))
    located, curved = F.col("p_size") % 3 > 0, joined & (F.col("k") == 2)
    bus = F.struct(k.alias("id"), F.concat(F.lit("bus"), k.cast("string")).alias("name"), F.when(F.col("p_size") % 5 > 0, F.col("p_size") * 10.0).alias("base_voltage"))
    unit = F.when(F.col("k") == 0, "NATURAL_UNITS").when(F.col("k") == 1, "COMPONENT_BASE").otherwise("SYSTEM_BASE")
    line = F.struct((k + 1000000000).alias("id"), F.lit("line").alias("name"), (k + 3000000000).alias("arc"), F.when(F.col("k") == 0, 20.0).otherwise(2.0).alias("rating"), unit.alias("power_units"), F.lit(100.0).alias("base_power"))
    arc = F.struct((k + 3000000000).alias("id"), k.alias("from_id"), (k + 1).alias("to_id"))
    load = F.struct((k + 2000000000).alias("id"), k.alias("bus"), F.lit(7.0).alias("max_active_power"), F.lit("NATURAL_UNITS").alias("power_units"))
    shape = lambda i, kind, c: F.struct(i.alias("id"), F.struct(F.lit(kind).alias("type"), c.alias("coordinates")).alias("geo_json"))
    tie = lambda i: F.struct(F.lit("GeographicInfo").alias("attribute_type"), i.alias("attribute_id"), i.alias("component_id"))
    bend = F.array(*[F.array(k * 1.0, F.lit(y)) for y in (1.0, 2.0, 3.0)])
    one = p.groupBy("sys").agg(
        some(F.lit(True), bus).alias("ACBus"), some(joined, line).alias("Line"), some(joined, arc).alias("Arc"), some(F.lit(True), load).alias("PowerLoad"),
        some(located, shape(k, "Point", F.array(k * 1.0, F.lit(2.0)))).alias("spots"), some(curved, shape(k + 1000000000, "LineString", bend)).alias("ways"),
        F.concat(some(located, tie(k)), some(curved, tie(k + 1000000000))).alias("ties"),
    )
    shapes = F.concat(F.lit("["), F.concat_ws(",", F.transform("spots", lambda x: F.to_json(x)), F.transform("ways", lambda x: F.to_json(x))), F.lit("]"))
    text = F.concat(F.lit('{"components":'), F.to_json(F.struct("ACBus", "Line", "Arc", "PowerLoad")), F.lit(',"supplemental_attributes":'), shapes, F.lit(',"supplemental_attribute_associations":'), F.to_json("ties"), F.lit("}"))
    _write_documents(one.select(F.col("sys").alias("bucket"), text.alias("value")), at)
    e = documents.network_elements(documents.network_tables(spark, f"{at}/bucket=*"))
    return e.select("key", "layer", "name", "voltage", "rating", F.coalesce(F.size("route"), F.lit(0)).alias("points"), F.col("x").isNotNull().alias("located")).withColumn("points", F.greatest("points", F.lit(0)))


@catalog.query("N20_probed_fields", """
    SELECT p_partkey AS path, CASE p_size % 4 WHEN 0 THEN 'array-metadata' WHEN 1 THEN 'table-package' WHEN 2 THEN 'cube' ELSE 'csv-header' END AS surface, p_brand AS field, CASE WHEN p_size % 4 < 3 THEN p_name END AS label, CASE p_size % 4 WHEN 0 THEN '<f4' WHEN 1 THEN 'number' END AS type, CASE WHEN p_size % 4 < 3 THEN 'MW' END AS unit FROM part
    UNION ALL SELECT p_partkey, 'csv-header', p_type, NULL, NULL, NULL FROM part WHERE p_size % 4 = 3""")
def n20(t):
    k, b, n = F.col("p_size") % 4, F.col("p_brand"), F.col("p_name")
    array = F.concat(F.lit('{"metadata": {"'), b, F.lit('/.zarray": {"dtype": "<f4"}, "lat/.zarray": {"dtype": "<f8"}, "'), b, F.lit('/.zattrs": {"units": "MW", "long_name": "'), n, F.lit('"}}}'))
    package = F.concat(F.lit('{"resources": [{"name": "r"}, {"schema": {"fields": [{"name": "'), b, F.lit('", "title": "'), n, F.lit('", "type": "number", "unit": "MW"}]}}]}'))
    cube = F.concat(F.lit('{"cube:variables": {"'), b, F.lit('": {"description": "'), n, F.lit('", "unit": "MW"}}}'))
    text = F.when(k == 0, array).when(k == 1, package).when(k == 2, cube).otherwise(F.concat(F.lit('"'), b, F.lit('",,'), "p_type", F.lit("\n1,2,3")))
    return documents.probed_fields(t("part").select(F.col("p_partkey").alias("path"), text.alias("text"))).drop("definition", "read_from")
