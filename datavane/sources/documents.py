"""Readers of documents made of nodes: catalogue records, network systems, and files that describe the fields of a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shared

_MAP = "map<string,string>"


def _nodes_in(node: Column) -> Column:
    """The objects that an object's values are or list, as JSON texts."""
    values = F.map_values(F.from_json(node, _MAP))
    lists = F.transform(values, lambda v: F.when(F.startswith(v, F.lit("{")), F.array(v)).when(F.startswith(v, F.lit("[")), F.from_json(v, "array<string>")))
    return F.filter(F.flatten(F.filter(lists, lambda x: x.isNotNull())), lambda v: F.startswith(v, F.lit("{")))


def _value(key: str, node: str = "node") -> Column:
    return F.get_json_object(node, f"$.{key}")


def record_nodes(files: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, bad) of record documents (file, text): an object, or one with its nodes in @graph; nodes within nodes are found to
    the given depth.

    nodes: file, dataset_iri, type, id, node (JSON) of documents with one identified Dataset. bad: file, problem of all others (unreadable,
    no-dataset, many-datasets), which do not stop the rest. A document is one record, so it is taken apart where its row is; nothing is shuffled."""
    graph = F.get_json_object("text", "$['@graph']")
    d = files.select("file", "text", F.when(graph.isNotNull(), F.from_json(graph, "array<string>")).when(F.from_json("text", _MAP).isNotNull() & F.startswith(F.trim("text"), F.lit("{")), F.array("text")).alias("level0"))
    for i in range(depth):
        d = d.withColumn(f"level{i + 1}", F.flatten(F.transform(f"level{i}", _nodes_in)))
    kind = lambda n: F.get_json_object(n, "$.type")
    # a type may be one word or a list of them
    is_dataset = lambda n: (kind(n) == "Dataset") | F.coalesce(F.array_contains(F.from_json(kind(n), "array<string>"), "Dataset"), F.lit(False))
    own = F.array_compact(F.transform(F.filter("level0", is_dataset), lambda n: F.get_json_object(n, "$.id")))
    every = F.flatten(F.array(*[f"level{i}" for i in range(depth + 1)]))
    d = d.withColumns({"iris": own, "every": every})
    problem = F.when(F.col("level0").isNull(), "unreadable").when(F.size("iris") == 0, "no-dataset").when(F.size("iris") > 1, "many-datasets")
    d = d.withColumn("problem", problem)
    nodes = d.where("problem is null").select("file", F.col("iris")[0].alias("dataset_iri"), F.explode("every").alias("node"))
    nodes = nodes.withColumns({"type": F.coalesce(F.get(F.from_json(_value("type"), "array<string>"), 0), _value("type")), "id": _value("id")}).where("type is not null")
    return nodes.select("file", "dataset_iri", "type", "id", "node"), d.where("problem is not null").select("file", "problem")


#: The columns of each table of a record, and the properties that they are read from.
TABLES = {
    "datasets": ("Dataset", {"title": "title", "description": "description", "license": "license", "completeness_level": "completenessLevel", "review_state": "reviewState", "visibility": "visibility", "update_cadence": "updateCadence"}),
    "distributions": ("Distribution", {"access_url": "accessURL", "media_type": "mediaType", "format_label": "formatLabel", "anonymous_access": "anonymousAccess"}),
    "parts": ("Field", {"name": "localName", "label": "label", "definition": "definition", "unit": "unit", "data_type": "dataType", "concept": "concept"}),
    "grades": ("QualityGrade", {"facet": "facet", "grade": "grade", "rationale": "rationale"}),
}


def table_of(nodes: DataFrame, name: str) -> DataFrame:
    """dataset_iri, id and the columns of one of TABLES from record_nodes()."""
    kind, columns = TABLES[name]
    return nodes.where(F.col("type") == kind).select("dataset_iri", "id", *[_value(p).alias(c) for c, p in columns.items()])


def record_tables(spark: SparkSession, glob: str) -> dict[str, DataFrame]:
    """datasets, distributions, parts, grades and bad of the record documents under a path, a file each; columns are texts as they are
    written (norm.to_bool and try_cast read them)."""
    files = spark.read.text(glob, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    nodes, bad = record_nodes(files)
    return {"bad": bad, **{name: table_of(nodes, name) for name in TABLES}}


_ROW = "id bigint, name string"
_RATED = "power_units string, base_power double"
#: The components of a network system that are read, and their properties.
COMPONENTS = {
    "ACBus": f"{_ROW}, base_voltage double",
    "Arc": "id bigint, from_id bigint, to_id bigint",
    "Line": f"{_ROW}, arc bigint, rating double, {_RATED}",
    "TapTransformer": f"{_ROW}, arc bigint, rating double, {_RATED}",
    "TwoTerminalGenericHVDCLine": f"{_ROW}, arc bigint, active_power_limits_from struct<max double>, {_RATED}",
    "ThermalStandard": f"{_ROW}, bus bigint, rating double, active_power_limits struct<max double>, fuel string, status string, {_RATED}",
    "RenewableDispatch": f"{_ROW}, bus bigint, rating double, active_power_limits struct<max double>, {_RATED}",
    "PowerLoad": f"{_ROW}, bus bigint, max_active_power double, {_RATED}",
}


def network_tables(spark: SparkSession, glob: str) -> dict[str, DataFrame]:
    """A table for each of COMPONENTS, and points (component_id, x, y) and corridors (component_id, path) of system documents
    {components: {kind: [...]}, supplemental_attributes, supplemental_attribute_associations}; each with system, the document's file.

    A document's geometry reaches its components through the associations, whose attribute_id and system are joined; of several of a component the
    last association counts. Kinds that a document lacks give no rows. Documents are small files that all tables and their joins need, so they are
    opened and parsed once and their parts written as columns. They are parsed as texts: a reader of multi-line JSON goes back to the file for each of the coordinates."""
    parts = ", ".join(f"`{k}` array<struct<{v}>>" for k, v in COMPONENTS.items())
    schema = f"components struct<{parts}>, supplemental_attributes array<struct<id bigint, geo_json struct<type string, coordinates string>>>, supplemental_attribute_associations array<struct<attribute_type string, attribute_id bigint, component_id bigint>>"
    text = spark.read.text(glob, wholetext=True).select(F.ltrim("value", F.lit("\ufeff")).alias("text"), F.input_file_name().alias("system"))
    d = shared.saved(text.select(F.from_json("text", schema).alias("d"), "system").select("d.*", "system"), "systems")
    out = {k: d.select("system", F.inline(f"components.{k}")) for k in COMPONENTS}
    shape = d.select("system", F.inline("supplemental_attributes")).select("system", F.col("id").alias("attribute_id"), F.col("geo_json.type").alias("type"), F.col("geo_json.coordinates").alias("at"))
    link = d.select("system", F.posexplode("supplemental_attribute_associations").alias("n", "a")).select("system", "n", "a.*").where("attribute_type = 'GeographicInfo'")
    met = link.join(shape, ["system", "attribute_id"])
    last = lambda kind: met.where(F.col("type") == kind).groupBy("system", "component_id").agg(F.max_by("at", "n").alias("at"))
    xy = F.from_json("at", "array<double>")
    out["points"] = last("Point").select("system", "component_id", xy[0].alias("x"), xy[1].alias("y"))
    out["corridors"] = last("LineString").select("system", "component_id", F.from_json("at", "array<array<double>>").alias("path"))
    return out


def network_elements(tables: dict[str, DataFrame]) -> DataFrame:
    """system, key, kind, layer, id, name, x, y, route, voltage, rating, from_name, to_name, fuel, status of all elements of network_tables().

    A branch lies along its corridor, or straight between its buses where both are located; a branch whose arc is unknown goes. Its voltage is the higher
    of its buses', none for a direct-current line. Ratings are in natural units; a rating in any other unit than those or the component's base is not shown.
    An injection lies where its bus does. All joins are by system and id, so documents never meet."""
    rating = lambda v: F.when(F.col("power_units") == "NATURAL_UNITS", v).when(F.col("power_units") == "COMPONENT_BASE", v * F.col("base_power"))
    nothing = {"x": "double", "y": "double", "route": "array<array<double>>", "voltage": "double", "rating": "double", "from_name": "string", "to_name": "string", "fuel": "string", "status": "string"}
    columns = ["system", "key", "kind", "layer", "id", "name", *nothing]

    def shaped(d: DataFrame, kind: str, layer: str) -> DataFrame:
        d = d.withColumns({"kind": F.lit(kind), "layer": F.lit(layer), "key": F.concat(F.lit(f"{kind}-"), F.col("id").cast("string")), "name": F.coalesce("name", F.lit("")), **{c: F.lit(None).cast(t) for c, t in nothing.items() if c not in d.columns}})
        return d.select(*columns)

    points, corridors = tables["points"], tables["corridors"]
    located = tables["ACBus"].join(points.withColumnRenamed("component_id", "id"), ["system", "id"], "left")
    out = shaped(located.withColumnRenamed("base_voltage", "voltage"), "bus", "buses")
    end = lambda side: located.select("system", F.col("id").alias(f"{side}_id"), F.lit(True).alias(f"{side}_known"), F.nullif("name", F.lit("")).alias(f"{side}_name"), F.coalesce("base_voltage", F.lit(0.0)).alias(f"{side}_kv"), F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.array("x", "y")).alias(f"{side}_at"))
    arcs = tables["Arc"].withColumnRenamed("id", "arc").join(end("from"), ["system", "from_id"], "left").join(end("to"), ["system", "to_id"], "left")
    arcs = arcs.drop("from_id", "to_id")
    for kind, table, limit in (("line", "Line", "rating"), ("transformer", "TapTransformer", "rating"), ("hvdc", "TwoTerminalGenericHVDCLine", "active_power_limits_from.max")):
        d = tables[table].withColumn("rating", rating(F.col(limit))).join(arcs, ["system", "arc"])
        d = d.join(corridors.select("system", F.col("component_id").alias("id"), "path"), ["system", "id"], "left")
        straight = F.when(F.col("from_at").isNotNull() & F.col("to_at").isNotNull(), F.array("from_at", "to_at"))
        kv = F.nullif(F.greatest(F.coalesce("from_kv", F.lit(0.0)), F.coalesce("to_kv", F.lit(0.0))), F.lit(0.0))
        both = F.col("from_name").isNotNull() & F.col("to_name").isNotNull()
        names = {side: F.when(both, F.col(side)) for side in ("from_name", "to_name")}
        d = d.withColumns({"route": F.when(F.size("path") > 1, F.col("path")).otherwise(straight), "voltage": F.lit(None).cast("double") if kind == "hvdc" else kv, **names})
        out = out.unionByName(shaped(d, kind, "lines"))
    for kind, table, layer, limit in (("thermal", "ThermalStandard", "generation", None), ("renewable", "RenewableDispatch", "generation", None), ("load", "PowerLoad", "load", "max_active_power")):
        value = F.col(limit) if limit else F.coalesce("active_power_limits.max", "rating")
        d = tables[table].withColumn("rating", rating(value)).join(points.withColumnRenamed("component_id", "bus"), ["system", "bus"], "left")
        out = out.unionByName(shaped(d, kind, layer))
    return out


#: Names of arrays that are coordinates, not fields.
COORDINATES = ("time", "latitude", "longitude", "lat", "lon", "level", "depth", "x", "y")


def probed_fields(files: DataFrame) -> DataFrame:
    """path, surface, field, label, definition, type, unit, read_from of the files (path, text) that describe a dataset's fields, with
    only what they state.

    array-metadata: consolidated metadata of arrays (in `metadata`, or at the top); arrays that are coordinates by name, or whose only dimension is
    themselves, are left out. table-package: all resources' fields. cube: cube:variables, at the top or in properties. csv-header: the names in the
    first line, quoted ones too; empty names are left out. A file of none of these kinds gives no rows."""
    j = files.select("path", "text", F.when(F.startswith(F.trim("text"), F.lit("{")), F.from_json("text", _MAP)).alias("top"))
    has = lambda k: F.col("top")[k].isNotNull()
    none = lambda name: F.lit(None).cast("string").alias(name)

    arrays = j.where("top is not null").withColumn("meta", F.coalesce(F.from_json(F.col("top")["metadata"], _MAP), F.col("top")))
    a = arrays.select("path", "meta", F.explode("meta").alias("key", "spec")).where(F.endswith("key", F.lit("/.zarray"))).withColumn("array", F.split("key", "/")[0])
    a = a.withColumn("attrs", F.col("meta")[F.concat("array", F.lit("/.zattrs"))])
    dims = F.from_json(_value("_ARRAY_DIMENSIONS", "attrs"), "array<string>")
    own_axis = F.coalesce((F.size(dims) == 1) & (dims[0] == F.col("array")), F.lit(False))
    a = a.where(~F.lower("array").isin(*COORDINATES) & ~own_axis)
    first = lambda *keys: F.coalesce(*[F.nullif(_value(k, "attrs"), F.lit("")) for k in keys])
    out = a.select("path", F.lit("array-metadata").alias("surface"), F.coalesce(first("short_name"), "array").alias("field"), first("long_name", "standard_name").alias("label"), first("description", "comment").alias("definition"), _value("dtype", "spec").alias("type"), first("units").alias("unit"), F.concat("array", F.lit("/.zattrs")).alias("read_from"))

    fields = "array<struct<name string, schema struct<fields array<struct<name string, title string, description string, type string, unit string>>>>>"
    t = j.where(has("resources")).select("path", F.explode(F.from_json(F.col("top")["resources"], fields)).alias("r")).select("path", F.coalesce("r.name", F.lit("")).alias("resource"), F.explode("r.schema.fields").alias("f"))
    out = out.unionByName(t.select("path", F.lit("table-package").alias("surface"), F.coalesce("f.name", F.lit("")).alias("field"), F.col("f.title").alias("label"), F.col("f.description").alias("definition"), F.col("f.type").alias("type"), F.col("f.unit").alias("unit"), F.concat(F.lit("resources["), "resource", F.lit("].schema.fields")).alias("read_from")))

    cube = F.coalesce(F.col("top")["cube:variables"], F.from_json(F.col("top")["properties"], _MAP)["cube:variables"])
    c = j.where("top is not null").select("path", F.explode(F.from_json(cube, _MAP)).alias("field", "spec"))
    out = out.unionByName(c.select("path", F.lit("cube").alias("surface"), "field", _value("description", "spec").alias("label"), none("definition"), _value("type", "spec").alias("type"), _value("unit", "spec").alias("unit"), F.lit("cube:variables").alias("read_from")))

    line = F.regexp_extract("text", r"^([^\r\n]*)", 1)
    cells = F.regexp_extract_all(line, F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    name = F.trim(F.when(F.startswith("cell", F.lit('"')), F.regexp_replace(F.regexp_replace("cell", '^"|"$', ""), '""', '"')).otherwise(F.col("cell")))
    h = files.where(~F.startswith(F.trim("text"), F.lit("{"))).select("path", F.explode(cells).alias("cell")).withColumn("field", name).where("field <> ''")
    return out.unionByName(h.select("path", F.lit("csv-header").alias("surface"), "field", none("label"), none("definition"), none("type"), none("unit"), F.lit("header row").alias("read_from")))
