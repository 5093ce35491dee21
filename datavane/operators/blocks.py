"""Blocks of an inverted index with the best score of each, and the exact top of a search that reads only blocks that can matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import search

#: The impacts in one level of a token are within this power of two of each other.
STEP = 0.25
#: Scores are ranked by nine decimals: a document this close to the last of the top may still tie with it.
SLACK = 1e-8


#: A vocabulary is broadcast up to so many words and bytes, which are counted first; a larger one is joined by shuffling.
FEW_WORDS, FEW_BYTES = 1 << 20, 32 << 20


def _bucket(buckets: Column) -> Column:
    return F.pmod(F.xxhash64("id"), buckets)


def vocabulary(index: DataFrame, n_docs: int, size: int) -> DataFrame:
    """token, idf (map of field to weight), buckets: how many buckets of about `size` documents a token's documents are dealt over.

    Counted with partial aggregation, so only words are shuffled, however often they occur."""
    df = index.groupBy("token", "field").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    d = df.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("field", idf))).alias("idf"), F.sum("df").alias("n"))  # an entry a field
    return d.select("token", "idf", F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("n") / size, F.lit(1.0))))).cast("long").alias("buckets"))


def build(index: DataFrame, n_docs: int, boosts: dict[str, float] = search.BOOSTS, size: int = 128, save=None, tokens: DataFrame | None = None) -> DataFrame:
    """token, buckets, bucket, level, best, n, rows (array of id, impact) for postings (field, token, id, tf, len). An impact is what a token adds to the
    BM25 score of a document, all fields together.

    A token's documents are dealt by a hash of the id over so many buckets that each holds about `size`, and by level of impact within
    a bucket. So a token of a third of all documents is many blocks in many tasks, and no block grows with it; there is no
    sort of a token's postings. A block's best is the score that none of its documents exceeds.

    Postings are shuffled once, by token and bucket, which serves both the sums over fields and the blocks; beyond FEW_WORDS they are shuffled
    once more for the join with the vocabulary. save: writes the vocabulary, so that it is counted once. tokens (token): only their postings are
    dealt and become blocks, where no others will be asked for; lengths are those of all postings."""
    boost = F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv])
    fields = F.broadcast(search.field_stats(index, n_docs))  # one row a field
    if tokens is not None:
        index = index.join(search.told(tokens), "token", "left_semi")
    words = vocabulary(index, n_docs, size)
    if save is not None:
        words = save(words, "words")
        n, width = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("token")), F.lit(0))).first()
        if n <= FEW_WORDS and width <= FEW_BYTES:
            words = F.broadcast(words)
    norm = F.col("tf") + search.K1 * (1 - search.B + search.B * F.col("len") / F.col("avg_len"))
    weight = F.coalesce(boost[F.col("field")], F.lit(1.0)) * F.col("tf") * (search.K1 + 1) / norm
    rows = index.join(fields, "field").select("token", "field", "id", weight.alias("w")).join(words, "token")
    # place: both in one number, as buckets is a power of two above bucket
    rows = rows.select("token", (F.col("buckets") + _bucket(F.col("buckets"))).alias("place"), "id", (F.col("w") * F.col("idf")[F.col("field")]).alias("part")).repartition("token", "place")
    whole = rows.groupBy("token", "place", "id").agg(F.sum("part").alias("impact")).withColumn("level", F.floor(F.log2("impact") / STEP).cast("int"))
    out = whole.groupBy("token", "place", "level").agg(F.max("impact").alias("best"), F.count("*").alias("n"), F.collect_list(F.struct("id", "impact")).alias("rows"))
    out = out.withColumn("buckets", F.pow(F.lit(2), F.floor(F.log2("place"))).cast("long"))
    return out.select("token", "buckets", (F.col("place") - F.col("buckets")).alias("bucket"), "level", "best", "n", "rows")


def write(index: DataFrame, n_docs: int, path: str, boosts: dict[str, float] = search.BOOSTS, size: int = 128, save=None, tokens: DataFrame | None = None) -> None:
    """The blocks of build() as a table whose files are in order of token, bucket and level, so that a read of some tokens passes over the
    others' row groups."""
    build(index, n_docs, boosts, size, save, tokens).sortWithinPartitions("token", "bucket", "level").write.mode("overwrite").parquet(path)


def _by_document(hits: DataFrame, index: DataFrame, asked: DataFrame, allowed: DataFrame | None, *sums: Column) -> DataFrame:
    """request_id, id and sums for hits (token, id, ...) and asked (request_id, token, damping, ...), a small table: hits are dealt by document once, however many
    requests ask for their tokens, and meet the requests where they are."""
    dealt = search.by_document(hits, index)
    if allowed is not None:
        dealt = dealt.join(allowed.select("id").distinct().hint("shuffle_hash"), "id", "left_semi")
    return dealt.join(asked, "token").groupBy("request_id", "id").agg(*sums)


def _bar(parts: DataFrame, k: int) -> DataFrame:
    """request_id, bar: the k-th best of request_id, id, score; no row where there are fewer than k."""
    w = Window.partitionBy("request_id").orderBy(F.desc("score"))
    return parts.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).groupBy("request_id").agg(F.when(F.count("*") == k, F.min("score")).alias("bar")).where("bar is not null")


def listed(blocks: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, token, damping, bucket, level, n, bound: the blocks of each request's tokens, with what one of their documents gets at
    most. The documents themselves are not read."""
    return requests.join(blocks.select("token", "buckets", "bucket", "level", "best", "n"), "token").withColumn("bound", F.col("damping") * F.col("best"))


def first_bar(blocks: DataFrame, of: DataFrame, k: int, allowed: DataFrame | None = None, save=None) -> DataFrame:
    """request_id, bar: a score that at least k allowed documents of a request (of: request_id, token, damping) reach, from the best blocks of each of its tokens that hold
    k documents together. These are the same for every request, and a task passes on k blocks of a token at most."""
    asked = of.select("request_id", "token", "damping").distinct()
    asked = search.told(save(asked, "asked") if save else asked)
    keys = ["token", "bucket", "level"]
    w = Window.partitionBy("token").orderBy(F.desc("best"), "bucket", "level")
    some = blocks.select(*keys, "best", "n").join(search.told(asked.select("token").distinct()), "token", "left_semi")
    head = some.withColumn("at", F.row_number().over(w)).where(F.col("at") <= k)
    head = head.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < k).select(*keys)
    head = search.told(save(head, "head") if save else head)
    hits = blocks.select(*keys, "rows").join(head, keys, "left_semi").select("token", F.explode("rows").alias("r")).select("token", "r.id", "r.impact")
    met = _by_document(hits, blocks, asked, allowed, F.sum(F.col("damping") * F.col("impact")).alias("score"))
    return _bar(search._can_be_top(met, k), k)


def cuts(tops: DataFrame, bar: DataFrame) -> DataFrame:
    """request_id, bar, cut for tops (request_id, top: the best bound of each token): only a block with at least this bound can hold the best token of a document that reaches the bar.

    If a document's best token adds b, every other token adds at most b, and at most its own best block's bound. Such a sum grows with b; the
    cut is where it reaches the bar, 0 where there is no bar. It lies on the line that belongs to the tokens whose best bound is above it."""
    d = tops.groupBy("request_id").agg(F.array_sort(F.collect_list("top")).alias("tops")).join(bar, "request_id", "left")  # a number a token of a request
    m = F.size("tops")
    before = F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.aggregate(F.slice("tops", F.lit(1), i), F.lit(0.0), lambda a, x: a + x))
    lines = F.zip_with(F.zip_with("tops", before, lambda top, s: F.struct(top.alias("top"), s.alias("s"))), F.sequence(F.lit(0), m - 1), lambda x, i: F.struct(x["top"].alias("top"), ((F.col("bar") - SLACK - x["s"]) / (m - i)).alias("at")))
    first = F.get(F.filter(lines, lambda x: x["at"] <= x["top"]), F.lit(0))["at"]
    return d.select("request_id", "bar", F.greatest(F.lit(0.0), F.coalesce(first, F.lit(0.0)) * (1 - 1e-12)).alias("cut"))


def needed(of: DataFrame, bar: DataFrame) -> DataFrame:
    """The rows of listed() that can hold the best token of a document that reaches the bar: the upper blocks of each token."""
    tops = of.groupBy("request_id", "token").agg(F.max("bound").alias("top"))
    return of.join(cuts(tops, bar), "request_id").where("bound >= cut").drop("cut", "bar")


def candidates(blocks: DataFrame, asked: DataFrame, k: int, allowed: DataFrame | None = None, save=None) -> DataFrame:
    """request_id, id of documents that can be among the k best, from the needed() blocks of asked (request_id, token, damping, bar, least, open, all_open): those with at least the
    token's least best. What they add so far, with what other blocks may add for tokens not met yet (open: so much at most; all_open: of all tokens), has to reach the bar, and the
    k-th best of what is certain so far.

    A needed block's documents are dealt once for all requests. A task passes on only what can reach the k-th best that it has seen itself."""
    least = asked.select("token", "least").distinct()
    read = blocks.join(search.told(save(least, "least") if save is not None else least), "token").where("best >= least")
    hits = read.select("token", F.explode("rows").alias("r")).select("token", "r.id", "r.impact")
    sums = F.sum(F.col("damping") * F.col("impact")).alias("score"), F.sum("open").alias("met"), F.first("all_open").alias("all_open"), F.first("bar").alias("bar")
    per = _by_document(hits, blocks, asked, allowed, *sums)
    per = per.select("request_id", "id", "score", (F.col("score") + F.col("all_open") - F.col("met")).alias("most"), "bar")
    some = search._can_be_top(per.where(F.col("bar").isNull() | (F.col("most") >= F.col("bar") - SLACK)).drop("bar"), k, F.col("most") + SLACK)
    some = save(some, "found") if save is not None else some
    d = some.join(_bar(some.select("request_id", "id", "score"), k), "request_id", "left")
    return d.where(F.col("bar").isNull() | (F.col("most") >= F.col("bar") - SLACK)).select("request_id", "id")


def exact(blocks: DataFrame, requests: DataFrame, some: DataFrame, save=None) -> DataFrame:
    """request_id, id, score of the candidates (request_id, id): only the buckets that a candidate's id falls into are read. What is asked is
    broadcast up to search.TOLD_ROWS rows (it follows the requests), so postings stay where they are."""
    widths = blocks.select("token", "buckets").distinct()
    asked = some.join(requests, "request_id").join(widths, "token").withColumn("bucket", _bucket(F.col("buckets"))).drop("buckets")
    asked = search.told(save(asked, "places") if save is not None else asked)
    where = search.told(asked.select("token", "bucket").distinct())
    rows = blocks.select("token", "bucket", "rows").join(where, ["token", "bucket"], "left_semi").select("token", F.explode("rows").alias("r")).select("token", F.col("r.id").alias("id"), "r.impact")
    return rows.join(asked.drop("bucket"), ["token", "id"]).groupBy("request_id", "id").agg(F.sum(F.col("damping") * F.col("impact")).alias("score"))


def scores(blocks: DataFrame, requests: DataFrame, k: int, allowed: DataFrame | None = None, save=None) -> DataFrame:
    """request_id, id, score: all documents that can be among a request's k best, ties with the k-th included, with their whole scores;
    search.top() ranks them as if all had been scored.

    blocks: a table written by write(). requests: request_id, token, damping, a row a token. allowed: ids that may be shown.
    save: writes a table that is used twice and reads it again (small ones: requests, their cuts, candidates); without it they are worked out
    twice. A request with fewer than k matches reads all its blocks, as it has to; one without a match has no row.
    Repeated rows of requests count once each token. No table has a row for each request and block, and postings are dealt once."""
    keep = save or (lambda d, name: d)
    requests = search.told(keep(requests.groupBy("request_id", "token").agg(F.max("damping").alias("damping")), "asked"))
    ends = blocks.groupBy("token").agg(F.max("best").alias("high"), F.min("best").alias("low"))
    of = keep(requests.join(ends, "token").withColumn("top", F.col("damping") * F.col("high")), "tops")
    cut = of.join(cuts(of.select("request_id", "top"), first_bar(blocks, of, k, allowed, save)), "request_id")
    # what any request needs of a token is read for all: below that, each block adds less; a token whose blocks are all read has nothing open
    least = F.min(F.when(F.col("damping") > 0, F.col("cut") / F.col("damping")).otherwise(0.0) * (1 - 1e-12)).over(Window.partitionBy("token"))
    cut = cut.withColumn("least", least).withColumn("open", F.when(F.col("low") >= F.col("least"), 0.0).otherwise(F.least("top", F.col("damping") * F.col("least"))))
    cut = cut.select("request_id", "token", "damping", "bar", "least", "open", F.sum("open").over(Window.partitionBy("request_id")).alias("all_open"))
    found = candidates(blocks, search.told(keep(cut, "cuts")), k, allowed, save)
    return exact(blocks, requests, keep(found, "best"), save)
