"""Inverted index, BM25 and facets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import shared
from ..functions.norm import search_tokens

#: BM25 constants and the boost of each field.
K1, B = 1.2, 0.75
BOOSTS = {"title": 6.0, "summary": 3.0, "keywords": 2.5, "publisher": 2.0, "description": 1.0}


#: The bytes of a token in lower-case text: a-z and 0-9.
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(97, 123)]] = True


def _counted(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(row, token, times, tokens of the row) of every distinct token of each of some lower-case texts.

    Tokens are the runs of token bytes, so the bytes that are kept and where runs begin make an Arrow array of all tokens at once."""
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    ink = _TOKEN[raw]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    edge = offs[:-1][offs[:-1] < len(raw)]
    first[edge] = ink[edge]
    starts = np.flatnonzero(first)
    kept = np.cumsum(ink)
    begin = kept[starts] - 1 if len(starts) else np.zeros(0, np.int64)
    tokens = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(begin, kept[-1] if len(kept) else 0).astype(np.int64)), pa.py_buffer(raw[ink]))
    row = np.searchsorted(offs, starts, "right") - 1
    coded = tokens.dictionary_encode()
    n = max(len(coded.dictionary), 1)
    pairs, times = np.unique(row * n + coded.indices.to_numpy().astype(np.int64), return_counts=True)
    return pairs // n, coded.dictionary.cast(pa.string()).take(pa.array(pairs % n)), times, np.bincount(row, minlength=len(texts))


#: Texts are counted in runs of about so many bytes, so that a worker's memory follows these and the longest text, not a whole batch.
RUN_BYTES = 1 << 20


def _runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of about RUN_BYTES."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + RUN_BYTES, "right")))
        yield lo, hi - lo
        lo = hi


def postings(docs: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """field, token, id, tf, len: one row for each distinct token of a field of a document; len counts all tokens of that field.

    A document's tokens are counted where its row is, on whole Arrow batches, so nothing is shuffled."""
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches):
        for b in batches:
            for f in fields:
                for lo, n in _runs(b[f]):
                    row, token, times, sizes = _counted(b[f].slice(lo, n))
                    yield pa.RecordBatch.from_arrays([pa.array([f] * len(row), pa.string()), token, b["id"].slice(lo, n).take(pa.array(row)), pa.array(times), pa.array(sizes[row])], ["field", "token", "id", "tf", "len"])
            pa.default_memory_pool().release_unused()

    texts = docs.select(F.col(id_col).alias("id"), *[F.lower(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in fields])
    return texts.mapInArrow(count, f"field string, token string, id {kind}, tf long, len long")


def upsert_postings(old: DataFrame, changed: DataFrame, removed: DataFrame) -> DataFrame:
    """The index after some documents changed (their new postings) or went (their ids)."""
    gone = changed.select("id").union(removed.select("id")).distinct()
    return old.join(gone, "id", "left_anti").unionByName(changed)


def field_stats(index: DataFrame, n_docs: int) -> DataFrame:
    """field, avg_len over all documents: all counts of a field's postings are its tokens."""
    return index.groupBy("field").agg((F.sum("tf") / F.lit(n_docs)).alias("avg_len"))


def bm25(index: DataFrame, requests: DataFrame, n_docs: int, boosts: dict[str, float] = BOOSTS) -> DataFrame:
    """request_id, id, score for requests (request_id, token, damping): the boosted BM25 sum over fields and tokens.

    index: postings, best as a written table, as it is read three times. Only postings of tokens that are asked for are counted and joined.
    The weights of these tokens and the requests are written and broadcast up to TOLD_ROWS rows (counted first; they follow the requests, not the
    documents). So a posting gets its weight where it is and is dealt by its document once; what requests and further joins by id make of it
    needs no other shuffle."""
    boost = F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv])
    asked = told(shared.saved(requests.select("request_id", "token", "damping"), "asked"))
    some = index.join(told(shared.saved(requests.select("token").distinct(), "tokens")), "token", "left_semi")
    df = some.groupBy("field", "token").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = df.join(F.broadcast(field_stats(index, n_docs)), "field").select("field", "token", idf.alias("idf"), "avg_len")  # one row a field
    hit = index.join(told(shared.saved(weight, "weights")), ["field", "token"])
    norm = F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len"))
    part = F.coalesce(boost[F.col("field")], F.lit(1.0)) * F.col("idf") * F.col("tf") * (K1 + 1) / norm
    dealt = by_document(hit.select("id", "token", part.alias("part")), index)
    return dealt.join(asked, "token").groupBy("request_id", "id").agg(F.sum(F.col("damping") * F.col("part")).alias("score"))


def by_document(rows: DataFrame, index: DataFrame) -> DataFrame:
    """rows by id, over so many tasks that none has many more than TASK_ROWS of the postings of index."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(n, index.count() // TASK_ROWS), "id")


#: Postings of one task where they are dealt by document.
TASK_ROWS = 1 << 21
#: Tables that follow the requests are broadcast up to so many rows (counted first), else joined by a shuffle.
TOLD_ROWS = 1 << 20


def told(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= TOLD_ROWS else df


def expand_last(index: DataFrame, requests: DataFrame, limit: int = 40, damping: float = 0.35) -> DataFrame:
    """request_id, token, damping for requests (request_id, tokens array): all but the last token as they are; the last as up to
    `limit` index terms that start with it in lexical order, damped unless equal; itself where there is none."""
    fixed = requests.select("request_id", F.explode(F.slice("tokens", 1, F.greatest(F.size("tokens") - 1, F.lit(0)))).alias("token"), F.lit(1.0).alias("damping"))
    last = requests.where(F.size("tokens") > 0).select("request_id", F.element_at("tokens", -1).alias("stem"))
    terms = index.select("token").distinct()
    # equal first characters make an equi-join of the prefix match; a one-letter stem is its own key
    keyed = terms.select(F.explode(F.array_distinct(F.array(F.substring("token", 1, 1), F.substring("token", 1, 3)))).alias("k"), "token")
    stem = last.withColumn("k", F.when(F.length("stem") >= 3, F.substring("stem", 1, 3)).otherwise(F.substring("stem", 1, 1)))
    hit = stem.join(keyed, "k").where(F.startswith(F.col("token"), F.col("stem")))
    n = F.row_number().over(Window.partitionBy("request_id").orderBy("token"))
    hit = hit.withColumn("n", n).where(F.col("n") <= limit)
    some = last.join(hit.select("request_id", "token"), "request_id", "left").select("request_id", F.coalesce("token", "stem").alias("token"), "stem")
    return fixed.unionByName(some.select("request_id", "token", F.when(F.col("token") == F.col("stem"), 1.0).otherwise(damping).alias("damping")))


#: The weights of a last word that is matched as a prefix, and of all of them together.
PREFIX_BOOSTS, PREFIX_WEIGHT = {"title": 2.1, "keywords": 0.9}, 0.35


def all_terms(index: DataFrame, requests: DataFrame, boosts: dict[str, float] = BOOSTS) -> DataFrame:
    """request_id, id, best for requests (request_id, token): documents with every distinct token in one and the same field, and
    the best of these fields' boosted counts.

    A field with all tokens of a request has its rarest one, so only the fields of that token's postings are looked at: their tokens become one array, which is
    held against the request's. Requests are broadcast as in bm25()."""
    want = shared.saved(requests.select("request_id", "token").distinct(), "asked")
    some = index.select("id", "field", "token").join(told(shared.saved(want.select("token").distinct(), "tokens")), "token", "left_semi")
    often = told(shared.saved(some.groupBy("token").agg(F.count("*").alias("df")), "often"))
    of = want.join(often, "token", "left").groupBy("request_id").agg(F.collect_set("token").alias("tokens"), F.min_by("token", F.coalesce("df", F.lit(0))).alias("token"))
    of = told(shared.saved(of, "requests"))
    met = some.join(of.select("request_id", "token"), "token").select("request_id", "id", "field").distinct()
    held = some.join(met.select("id", "field").distinct(), ["id", "field"], "left_semi").groupBy("id", "field").agg(F.collect_set("token").alias("held"))
    whole = met.join(held, ["id", "field"]).join(of.select("request_id", "tokens"), "request_id").where(F.size(F.array_except("tokens", "held")) == 0)
    boost = F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv])
    return whole.groupBy("request_id", "id").agg(F.max(F.coalesce(boost[F.col("field")], F.lit(1.0)) * F.size("tokens")).alias("best"))


def last_as_prefix(index: DataFrame, requests: DataFrame, whole: DataFrame) -> DataFrame:
    """request_id, id, best: whole (the result of all_terms()) with the documents that have all tokens but the last of requests
    (request_id, tokens) in the title or the keywords, and there a token that starts with the last: PREFIX_WEIGHT times the
    field's prefix boost is added for each of the request's distinct tokens."""
    fields = index.where(F.col("field").isin(*PREFIX_BOOSTS)).select("id", "field", "token").distinct()
    asked = requests.where("size(tokens) > 0").select("request_id", F.array_distinct(F.slice("tokens", F.lit(1), F.size("tokens") - 1)).alias("fixed"), F.element_at("tokens", -1).alias("stem"))
    n = asked.select("request_id", (F.size("fixed") + 1).alias("n"))
    words = asked.select("request_id", F.explode("fixed").alias("token"), F.lit(False).alias("is_stem"))
    # a prefix of up to three letters makes an equi-join of the prefix match
    stems = asked.select("request_id", "stem", F.substring("stem", 1, 3).alias("k"))
    keyed = fields.select("*", F.explode(F.array_distinct(F.array(*[F.substring("token", 1, i) for i in (1, 2, 3)]))).alias("k"))
    by_stem = keyed.join(stems, "k").where(F.startswith(F.col("token"), F.col("stem"))).select("request_id", "id", "field", F.lit(True).alias("is_stem"), F.lit("").alias("token"))
    hit = fields.join(words, "token").select("request_id", "id", "field", "is_stem", "token").unionByName(by_stem).distinct()
    have = hit.groupBy("request_id", "id", "field").agg(F.count("*").alias("terms")).join(n, "request_id").where("terms = n")
    boost = F.create_map(*[F.lit(x) for kv in PREFIX_BOOSTS.items() for x in kv])
    more = have.groupBy("request_id", "id").agg(F.max(boost[F.col("field")] * F.col("terms") * PREFIX_WEIGHT).alias("more"))
    both = whole.join(more, ["request_id", "id"], "full_outer")
    return both.select("request_id", "id", (F.coalesce("best", F.lit(0.0)) + F.coalesce("more", F.lit(0.0))).alias("best"))


def _can_be_top(scores: DataFrame, n: int, most: Column | None = None) -> DataFrame:
    """The rows of scores (request_id, score, ...) that can be among the n best of their request: a task keeps the n best scores that it has seen of each request
    and passes on the rows that reach them, so all scores need not be sorted. Equal scores (to 9 places) all pass. most: what a row's score may still become."""

    def keep(batches):
        best: dict = {}
        for b in batches:
            score, most, coded = b["__r"].to_numpy(), b["__m"].to_numpy(), b["request_id"].dictionary_encode()
            codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            bar = np.array([best[x][0] if len(best.get(x, ())) == n else -np.inf for x in names])
            at = np.flatnonzero(score >= bar[codes])
            at = at[np.argsort(codes[at], kind="stable")]
            for rows in np.split(at, np.flatnonzero(np.diff(codes[at])) + 1) if len(at) else ():
                name = names[codes[rows[0]]]
                best[name] = np.sort(np.concatenate([best.get(name, np.zeros(0)), score[rows]]))[-n:]
            bar = np.array([best[x][0] if len(best.get(x, ())) == n else -np.inf for x in names])
            yield b.filter(pa.array(most >= bar[codes]))

    if n < 1:
        return scores.limit(0)
    rounded = scores.withColumns({"__r": F.round("score", 9), "__m": F.round("score" if most is None else most, 9)})
    return rounded.mapInArrow(keep, rounded.schema).drop("__r", "__m")


def top(scores: DataFrame, titles: DataFrame, n: int) -> DataFrame:
    """The n best of each request: score, then title without case, then id; scores of 0 go."""
    rows = _can_be_top(scores.where("score > 0"), n).join(titles, "id")
    w = Window.partitionBy("request_id").orderBy(F.desc(F.round("score", 9)), F.lower("title"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("request_id", "rank", "id", "score")


def matches(scores: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """The whole match set of each request, before any page is cut: scores above 0, of the documents in allowed (id) only if given."""
    rows = scores.where("score > 0")
    return rows if allowed is None else rows.join(allowed.select("id").distinct().hint("shuffle_hash"), "id", "left_semi")  # scores are many, and not sorted for it


def result_page(found: DataFrame, titles: DataFrame, offset: int = 0, limit: int = 20) -> DataFrame:
    """request_id, rank, id, score, total, next_offset of one page of each request's matches(): total counts the whole match set, and
    next_offset is null on the last page. The order is that of top()."""
    total = found.groupBy("request_id").agg(F.count("*").alias("total"))
    rows = top(found, titles, offset + limit).where(F.col("rank") > offset).join(total, "request_id")
    return rows.withColumn("next_offset", F.when(F.col("total") > offset + limit, F.lit(offset + limit)))


def request_facets(found: DataFrame, docs: DataFrame, facets: list[str], n: int = 50) -> DataFrame:
    """request_id, facet, value, n: the n most frequent values (-count, then value) of each facet of docs (id, ...) over a request's whole
    match set. Matches meet the facets' columns once; counts are combined before the shuffle."""
    cols = [x for f in facets for x in (F.lit(f), F.col(f).cast("string"))]
    long = found.select("request_id", "id").join(docs.select("id", F.create_map(*cols).alias("m")).hint("shuffle_hash"), "id").select("request_id", F.explode("m").alias("facet", "value"))
    counts = long.where("value is not null").groupBy("request_id", "facet", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("request_id", "facet").orderBy(F.desc("n"), "value")
    return counts.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def facet_counts(df: DataFrame, facets: list[str], id_col: str = "id", n: int = 50, more: DataFrame | None = None) -> DataFrame:
    """facet, value, n: distinct documents of each value, all facets in one pass; the n most frequent of each facet (-count,
    then value). Array columns count each value once a document; nulls aren't values. more: facet, value, id rows of facets that
    are tables of their own already."""
    cols = []
    for f in facets:
        c = F.col(f)
        values = F.array_distinct(c) if df.schema[f].dataType.typeName() == "array" else F.array(c)
        cols += [F.lit(f), F.transform(values, lambda x: x.cast("string"))]
    long = df.select(F.col(id_col).alias("id"), F.explode(F.create_map(*cols)).alias("facet", "vs")).select("facet", F.explode("vs").alias("value"), "id")
    if more is not None:
        long = long.unionByName(more.join(df.select(F.col(id_col).alias("id")), "id", "left_semi").select("facet", F.col("value").cast("string").alias("value"), "id"))
    counts = long.where("value is not null").groupBy("facet", "value").agg(F.count_distinct("id").alias("n"))
    w = Window.partitionBy("facet").orderBy(F.desc("n"), "value")
    return counts.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")
