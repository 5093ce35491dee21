"""Readers and writers of catalogue inputs and outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators import seed

RECORD = "id string, type string, title string, description string, license string, dataDomain array<string>, completenessLevel int, reviewState string, distribution array<struct<id string, accessURL string, mediaType string, byteSize long>>, hasField array<struct<id string, name string, label string, unit string, definition string>>, _bad string"
#: Where each harvest source keeps its list of records, and its id.
PAYLOADS = {"ckan": ("result.results", "id"), "zenodo": ("hits.hits", "id"), "stac": ("collections", "id"), "datacite": ("data", "id"), "dcat": ("results.bindings", "dataset.value")}


def load_records(spark: SparkSession, glob: str) -> dict[str, DataFrame]:
    """datasets, distributions, parts and bad of JSON files of one record, or a list of them. A file that can't be read
    is a row of bad, not a failure."""
    raw = spark.read.schema(RECORD).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(glob).withColumn("_file", F.input_file_name())
    good = raw.where("_bad is null and id is not null").drop("_bad")
    return {
        "datasets": good.drop("distribution", "hasField"),
        "distributions": good.select(F.col("id").alias("dataset_iri"), F.inline("distribution")),
        "parts": good.select(F.col("id").alias("dataset_iri"), F.inline("hasField")),
        "bad": raw.where("_bad is not null or id is null").select("_file", "_bad"),
    }


def load_seed(spark: SparkSession, path: str) -> DataFrame:
    """domain, domain_name, n and the columns of seed.ROW from {domain: {name, datasets: [...]}} JSON; other keys of a row are not read."""
    row = ", ".join(f"`{c}`: {t}" for c, t in seed.ROW.items() if c not in ("domain", "domain_name"))
    d = spark.read.schema(f"domains map<string, struct<name: string, datasets: array<struct<{row}>>>>").option("multiLine", True).json(path)
    each = d.select(F.explode("domains").alias("domain", "v")).select("domain", F.col("v.name").alias("domain_name"), F.posexplode("v.datasets").alias("n", "r"))
    return each.select("domain", "domain_name", "n", "r.*")


def load_payload_pages(spark: SparkSession, source: str, glob: str) -> DataFrame:
    """source, source_record_id, payload (JSON) and payload_hash of one kind of paged dump."""
    at, key = PAYLOADS[source]
    pages = spark.read.text(glob, wholetext=True).withColumn("items", F.from_json(F.get_json_object("value", f"$.{at}"), "array<string>"))
    each = pages.select(F.explode("items").alias("payload"))
    return each.select(F.lit(source).alias("source"), F.get_json_object("payload", f"$.{key}").alias("source_record_id"), "payload", F.sha2("payload", 256).alias("payload_hash"))


def load_matpower(spark: SparkSession, glob: str, block: str, columns: list[str]) -> DataFrame:
    """file, n and the named columns of mpc.<block> = [ ... ]; in many case files."""
    text = spark.read.text(glob, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_extract("value", rf"mpc\.{block}\s*=\s*\[([^\]]*)\]", 1).alias("body"))
    rows = text.select("file", F.posexplode(F.filter(F.split(F.regexp_replace("body", r"%[^\n]*", ""), "[;\n]"), lambda r: F.trim(r) != "")).alias("n", "row"))
    cells = rows.select("file", "n", F.transform(F.split(F.trim("row"), r"[\s,]+"), lambda x: x.try_cast("double")).alias("c"))
    return cells.select("file", "n", *[F.get(F.col("c"), i).alias(name) for i, name in enumerate(columns)])


def load_wide_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV whose last column is unquoted and holds commas itself: only the first len(columns) - 1 commas part columns."""
    lines = spark.read.text(path).where(~F.startswith(F.col("value"), F.lit(columns[0] + ",")))
    cells = F.split("value", ",", len(columns))
    return lines.select(*[F.get(cells, i).alias(c) for i, c in enumerate(columns)])


def load_vocabulary(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The Parquet tables of a vocabulary (concepts, edges, units, crosswalks) by name."""
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def load_network(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """buses, arcs and loads of system documents {components: {buses, arcs, loads}}."""
    schema = "components struct<buses: array<struct<id: long, name: string, voltage: double>>, arcs: array<struct<id: long, from: long, to: long>>, loads: array<struct<id: long, bus: long, p: double, q: double>>>"
    d = spark.read.schema(schema).option("multiLine", True).json(path)
    return {k: d.select(F.inline(f"components.{k}")) for k in ("buses", "arcs", "loads")}


def schema_fields(files: DataFrame) -> DataFrame:
    """path, field, type for metadata files (path, text): consolidated array metadata, the first table of a package, or CSV headers; some
    coordinate arrays are left out. documents.probed_fields() reads these and cubes, with labels and units."""
    zarr = files.where(F.get_json_object("text", "$.metadata").isNotNull()).select("path", F.explode(F.from_json(F.get_json_object("text", "$.metadata"), "map<string,string>")).alias("k", "v")).where(F.endswith(F.col("k"), F.lit("/.zarray"))).select("path", F.regexp_replace("k", "/\\.zarray$", "").alias("field"), F.get_json_object("v", "$.dtype").alias("type"))
    zarr = zarr.where(~F.col("field").isin("time", "lat", "lon", "latitude", "longitude", "x", "y"))
    pack = files.where(F.get_json_object("text", "$.resources").isNotNull()).select("path", F.inline(F.from_json(F.get_json_object("text", "$.resources[0].schema.fields"), "array<struct<name string, type string>>"))).select("path", F.col("name").alias("field"), "type")
    head = files.where(~F.startswith(F.trim("text"), F.lit("{"))).select("path", F.explode(F.split(F.regexp_extract("text", "^([^\n]*)", 1), ",")).alias("field")).select("path", F.trim("field").alias("field"), F.lit(None).cast("string").alias("type"))
    return zarr.unionByName(pack).unionByName(head)


def row_hash(df: DataFrame) -> Column:
    """60 bits of the MD5 of a row's values as text, in the order of the column names; a null is told from an empty text."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in sorted(df.columns)])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def checksum(df: DataFrame) -> DataFrame:
    """n and hash of a table, whatever its row order: the sum and the exclusive or of the rows' hashes."""
    h = row_hash(df)
    return df.agg(F.count("*").alias("n"), F.concat_ws(":", F.sum(h.cast("decimal(38,0)")).cast("string"), F.bit_xor(h).cast("string")).alias("hash"))


def envelope(df: DataFrame, required: list[str]) -> DataFrame:
    """rows, and for each required column how many values are missing."""
    return df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in required])


def replace_output(rows: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Replace the computed rows of the records at hand: whole buckets are written again, others stay as they are."""
    at = F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")
    rows.select("*", at).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def export_snapshot(tables: dict[str, DataFrame], path: str, key: str = "id", buckets: int = 16) -> None:
    """JSON files of each table, in a few buckets rather than a file a record. The caller passes what anonymous readers may see."""
    for name, df in tables.items():
        df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").json(f"{path}/{name}")


class PagedSource(DataSource):
    """A harvest source as a Spark data source: `pages` numbered pages under `path`, each read by a task of its own; `checkpoint`
    is the first page to read."""

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        return "page int, id string, payload string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [InputPartition(i) for i in range(int(self.options.get("checkpoint", 0)), int(self.options["pages"]))]

    def read(self, partition):
        import json

        with open(f"{self.options['path']}/{partition.value}.json", encoding="utf-8") as f:
            for row in json.load(f):
                yield partition.value, str(row["id"]), json.dumps(row, sort_keys=True)
