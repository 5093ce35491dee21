"""Contiguous shards of near-equal bytes from prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window

from . import common


def byte_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard all rows into contiguous runs of ascending (id, text hash), near equal in bytes.

    size: UTF-8 bytes of the text (null: none) plus 1. Rows are dealt into key ranges, the ranges' totals give each range
    its global start, and a running sum inside the range gives each row the bytes and rows before it. Shard = the target
    interval (total / shards) that holds the row's midpoint, so two shards differ by less than one row at each cut; slot =
    place in the shard, from 0.

    One row is never cut, so a text longer than a target fills a shard alone and its neighbours may stay empty. Ids may be of any
    type that sorts. A null id sorts first; one id with many different texts is spread over ranges by the text hash; repeated
    rows each have a slot; an empty table gives an empty result; other columns are not read. Equal texts have equal
    text_crc32, but stay where their ids are: a contiguous shard can't keep them together.
    law and grown_shard: always `bytes` and null, as a new shard count moves every cut."""
    spark, w = docs.sparkSession, window.Window
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = common.saved(rows, "sizes")
    rows = common.with_ranges(rows, ["doc_id", "text_crc32"], 4 * common.partitions(spark))
    each = rows.groupBy("bin").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    every = w.orderBy("bin")  # as many rows as ranges: 4 a partition
    before = every.rowsBetween(w.unboundedPreceding, -1)
    each = each.select("bin", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("r0"))
    total = rows.agg(F.sum("size")).first()[0] or 1
    inside = w.partitionBy("bin").orderBy("doc_id", "text_crc32", "size")
    before = inside.rowsBetween(w.unboundedPreceding, -1)
    placed = rows.select("*", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("lb"), (F.row_number().over(inside) - 1).cast("long").alias("lr"))
    placed = placed.join(F.broadcast(each), "bin")
    start = F.col("b0") + F.col("lb")
    shard = F.least(F.lit(shards - 1), F.expr(f"((2 * (b0 + lb) + size) * {shards}) div (2 * {total})")).cast("int")
    placed = common.saved(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("r0") + F.col("lr")).alias("row"), start.alias("start_byte")), "placed")
    first = placed.groupBy("shard").agg(F.min("row").alias("row0"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("row0")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "start_byte")
