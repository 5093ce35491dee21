"""The top of a search by blocks against the scores of all documents."""

import random

import pytest
from datavane.functions import shared
from datavane.operators import blocks, search
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 40))), "hot" if i % 3 == 0 else "cold") for i in range(900)]
    docs += [(900 + i, docs[i][1], docs[i][2]) for i in range(100)] + [(1000, None, None), (1001, "", "...")]
    d = spark.createDataFrame(docs, "doc_id long, description string, title string")
    return shared.saved(search.postings(d, "doc_id", ["title", "description"]), "test-index")


@pytest.fixture(scope="module")
def table(spark, index):
    at = shared.folder(spark, "test-blocks")
    blocks.write(index, 1002, at, size=16)
    return spark.read.parquet(at)


ASKED = [(1, "w50", 1.0), (1, "w0", 1.0), (2, "w1", 1.0), (2, "w0", 0.35), (2, "hot", 1.0), (3, "nowhere", 1.0), (4, "w59", 1.0), (4, "w58", 1.0), (5, "hot", 1.0), (6, "w40", 1.0), (6, "w40", 1.0), (6, "nowhere", 1.0)]


def asked(spark):
    return spark.createDataFrame(ASKED, "request_id long, token string, damping double")


@pytest.mark.parametrize("k", [1, 10, 2000])
@pytest.mark.parametrize("filtered", [False, True])
def test_top_by_blocks_is_the_top_of_all(spark, index, table, k, filtered):
    titles = index.select("id").distinct().withColumn("title", F.concat(F.lit("T"), (F.col("id") % 7).cast("string")))
    allowed = titles.where("id % 5 > 2") if filtered else None
    whole = search.matches(search.bm25(index, asked(spark).distinct(), 1002), allowed)
    want = [(r.request_id, r.rank, r.id, round(r.score, 6)) for r in search.top(whole, titles, k).collect()]
    got = [(r.request_id, r.rank, r.id, round(r.score, 6)) for r in search.top(blocks.scores(table, asked(spark), k, allowed, shared.saved), titles, k).collect()]
    assert sorted(got) == sorted(want) and {r[0] for r in got} == {1, 2, 4, 5, 6}


def test_blocks_that_cannot_matter_are_not_read(spark, table):
    of = blocks.listed(table, asked(spark))
    read = blocks.needed(of, blocks.first_bar(table, of, 10))
    n = lambda d: {r.request_id: r.n for r in d.groupBy("request_id").agg(F.sum("n").alias("n")).collect()}
    every, some = n(of), n(read)
    assert some[2] < 0.25 * every[2] and all(some[r] <= every[r] for r in some)
    lowest = lambda d: {r.token: r.m for r in d.where("request_id = 1").groupBy("token").agg(F.min("bound").alias("m")).collect()}
    assert lowest(read).get("w0", 99.0) > lowest(of)["w0"]  # the frequent word alone brings nobody up


def test_a_hot_token_is_many_small_blocks(spark, table):
    hot = table.where("token = 'hot'")
    assert hot.agg(F.sum("n")).first()[0] == 334 and hot.groupBy("bucket").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] < 40
    assert hot.select("bucket").distinct().count() == 32
    assert table.where("n <> size(rows) or best < array_max(transform(rows, r -> r.impact))").count() == 0


def test_both_joins_with_the_vocabulary_build_the_same(spark, index, table):
    at = shared.folder(spark, "test-blocks")
    blocks.write(index, 1002, at, size=16, save=shared.saved)
    rows = lambda d: {(r.token, r.bucket, r.level): (r.n, round(r.best, 9), sorted((x.id, round(x.impact, 9)) for x in r.rows)) for r in d.collect()}
    assert rows(spark.read.parquet(at)) == rows(table)


def test_postings_are_dealt_once_for_all_requests(spark, table):
    """No exchange of the candidates' plan carries a request: it holds postings by document, however many requests ask for them."""
    many = spark.range(30).select(F.col("id").alias("request_id"), F.explode(F.array(*[F.lit(f"w{i}") for i in range(8)])).alias("token"), F.lit(1.0).alias("damping"))
    written = []

    def save(d, name):
        if name == "found":
            written.append(d._jdf.queryExecution().executedPlan().toString())
        return shared.saved(d, name)

    got = {(r.request_id, r.id): round(r.score, 6) for r in blocks.scores(table, many, 5, save=save).collect()}
    assert len(written) == 1 and written[0].count("hashpartitioning(id") == 1 and written[0].count("Exchange hashpartitioning") == 1
    assert len({tuple(sorted((i, s) for (r, i), s in got.items() if r == x)) for x in range(30)}) == 1  # equal requests, equal rows


def test_only_blocks_of_asked_tokens_are_built(spark, index, table):
    at = shared.folder(spark, "test-blocks")
    blocks.write(index, 1002, at, size=16, save=shared.saved, tokens=asked(spark).select("token").distinct())
    rows = lambda d: {(r.token, r.bucket, r.level, r.n, round(r.best, 9)) for r in d.select("token", "bucket", "level", "n", "best").collect()}
    some = spark.read.parquet(at)
    assert rows(some) == rows(table.join(asked(spark).select("token").distinct(), "token", "left_semi")) and some.count() < table.count()


def test_cuts_are_where_the_bounds_reach_the_bar(spark):
    rng = random.Random(3)
    tops = [(r, rng.random()) for r in range(40) for _ in range(rng.randint(1, 9))]
    bars = [(r, rng.random() * sum(t for q, t in tops if q == r)) for r in range(39)]
    got = {r.request_id: r.cut for r in blocks.cuts(spark.createDataFrame(tops, "request_id int, top double"), spark.createDataFrame(bars, "request_id int, bar double")).collect()}
    most = lambda r, b: sum(min(t, b) for q, t in tops if q == r)
    assert got[39] == 0 and all(abs(most(r, got[r]) - (bar - blocks.SLACK)) < 1e-9 for r, bar in bars)


def test_empty_tables(spark, table):
    none = asked(spark).limit(0)
    assert blocks.scores(table, none, 5).count() == 0 and blocks.scores(table.limit(0), asked(spark), 5).count() == 0
    assert blocks.scores(table, asked(spark), 5, allowed=spark.createDataFrame([], "id long")).count() == 0
