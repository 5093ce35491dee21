"""Exact deduplication as a stateful stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text):
    """The text without the characters `[\\x20\\x09-\\x0D]`; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def digest_state(stream: DataFrame):
    """The streaming aggregation that is the keyed state: for each digest how many rows had it, and the row to keep.

    stream: digest, n_chars, doc_id, uid, locator. There is no watermark, so no key expires. The kept row has the most
    code points, then the smallest doc_id, then the smallest uid; a null id comes last. locator: the file that holds the kept
    row's content; with its id and length the content is found again."""
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("neg_id"), (-F.col("uid")).alias("neg_uid"), "locator"))
    return stream.groupBy("digest").agg(F.count("*").alias("n"), best.alias("best"))


def run_stream(stream: DataFrame, folder: str) -> DataFrame:
    """Run digest_state() over all that is there and return its last state: digest, n, best.

    The state is kept on disk by the RocksDB provider and its checkpoint is in the shared folder, so a restart goes on where it
    stopped. Each micro-batch writes the keys that it changed under its own number; a batch that is repeated replaces them."""
    spark = stream.sparkSession
    out, schema = f"{folder}/updates", digest_state(stream).schema
    own = {"spark.sql.streaming.stateStore.providerClass": _ROCKS, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}  # many small stores: no space ahead
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        query = digest_state(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        last = query.lastProgress
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if last is None:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(out)
    # counts only grow and the kept row only improves, so the last update of a key is its largest
    return rows.groupBy("digest").agg(F.max("n").alias("n"), F.max("best").alias("best"))


def exact_duplicates(docs: DataFrame, files_per_batch: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs (doc_id, text), dropped ones too.

    Texts are equal when identical without white space; null counts as empty. The row with the most code points stays, then
    the smallest doc_id, then one of the repeated rows. The rows' digests are read as a stream into a keyed state without
    expiry (digest, stable id, locator of the content); then the full bytes of every hit are compared with those of the row
    that it would be dropped for, found by its locator. Rows whose bytes differ in spite of equal digests are grouped by their
    whole text. Ids are integers. A null id is a row like any other and is kept last. An empty table gives an empty result;
    other columns aren't read."""
    spark = docs.sparkSession
    folder = f"{common.shared_dir(spark)}/datavane/exact-{uuid.uuid4().hex}"
    base = docs.select("doc_id", "text")
    rows = base.select(F.sha2(normalised(F.col("text")), 256).alias("digest"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.input_file_name().alias("locator"))
    rows.write.parquet(f"{folder}/digests")
    rows = spark.read.schema(rows.schema).parquet(f"{folder}/digests")
    state = run_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/digests"), folder)
    state = state.select("digest", "n", (-F.col("best.neg_id")).alias("keep_id"), (-F.col("best.neg_uid")).alias("keep_uid"), F.col("best.n_chars").alias("keep_chars"), F.col("best.locator").alias("keep_locator"))
    state = common.saved(state, "state")
    clash = _clashes(base, state)
    out = rows.join(state, "digest").select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("uid") == F.col("keep_uid")).alias("kept"), F.col("digest").alias("text_sha256"))
    if clash.isEmpty():
        return out
    bad = clash.select("digest").distinct()
    return out.join(bad, out.text_sha256 == bad.digest, "left_anti").unionByName(_by_text(base, bad))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that exact_duplicates() keeps. Rows with a null id stay."""
    found = common.saved(exact_duplicates(docs), "exact")
    left = common.without_ids(docs, found.where("not kept and doc_id <> keep_id").select("doc_id"))
    again = found.where("not kept and doc_id = keep_id").select("doc_id").distinct()
    if again.isEmpty():  # no repeated rows: the rule
        return left
    marked = common.left_by_id(left, common.saved(again.withColumn("__again", F.lit(True)), "again"))
    same = marked.where("__again").withColumn("__n", F.row_number().over(Window.partitionBy("doc_id", F.sha2(normalised(F.col("text")), 256)).orderBy(F.desc(F.length("text")))))
    return marked.where("__again is null").drop("__again").unionByName(same.where("__n = 1 or doc_id is null").drop("__n", "__again"))


def _clashes(base: DataFrame, state: DataFrame) -> DataFrame:
    """Hits whose bytes differ from the kept row's. Only rows in groups are written and go through the joins: where there are few
    groups, a broadcast of their digests' hashes tells which rows those are, else a join on the digest does."""
    many = state.where("n > 1")
    key = F.xxhash64("digest")
    texts = base.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), normalised(F.col("text")).alias("bytes"), F.input_file_name().alias("locator"))
    texts = texts.withColumn("digest", F.sha2("bytes", 256))
    hit = common.few_keys(many.select(key.alias("__key")))
    if hit is None:
        hits = texts.join(many.select("digest"), "digest", "left_semi")
    else:
        hits = texts.withColumn("__key", key).join(hit, "__key", "left_semi").drop("__key")
    hits = common.saved(hits, "hits")
    best = many.select("digest", "keep_id", "keep_chars", "keep_locator")
    found = (hits.digest == best.digest) & hits.doc_id.eqNullSafe(best.keep_id) & (hits.n_chars == best.keep_chars) & (hits.locator == best.keep_locator)
    keeper = hits.join(best, found).groupBy(hits.digest).agg(F.min("bytes").alias("keeper"))
    # a table of its own, so that the last join shuffles both sides for itself and a hot digest can be split
    return hits.join(common.saved(keeper, "keepers"), "digest").where("bytes <> keeper").select("digest")


def _by_text(base: DataFrame, digests: DataFrame) -> DataFrame:
    rows = base.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), normalised(F.col("text")).alias("bytes")).withColumn("digest", F.sha2("bytes", 256)).join(digests, "digest", "left_semi").withColumn("uid", F.monotonically_increasing_id())
    rows = common.saved(rows, "clashes")
    best = rows.groupBy("bytes").agg(F.count("*").alias("group_size"), F.max(F.struct("n_chars", (-F.col("doc_id")).alias("neg_id"), (-F.col("uid")).alias("neg_uid"))).alias("best"))
    return rows.join(best, "bytes").select("doc_id", (-F.col("best.neg_id")).alias("keep_id"), "group_size", (F.col("uid") == -F.col("best.neg_uid")).alias("kept"), F.col("digest").alias("text_sha256"))
