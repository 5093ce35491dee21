"""Filters, entitlement, sorting and paging over catalogue tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import shared

PUBLISHED = ("confirmed", "auto-confirmed")


def facet(df: DataFrame, wanted: dict[str, list]) -> DataFrame:
    """Rows that have one of the wanted values in every named column; an array column has a value if it contains it."""

    def one(name, values):
        if df.schema[name].dataType.typeName() == "array":
            return F.arrays_overlap(F.col(name), F.array(*map(F.lit, values)))
        return F.col(name).isin(*values)

    return df.where(reduce(Column.__and__, (one(k, v) for k, v in wanted.items()), F.lit(True)))


def within(value: Column, low=None, high=None) -> Column:
    """A range that a missing value fails."""
    out = value.isNotNull()
    if low is not None:
        out = out & (value >= low)
    return out if high is None else out & (value <= high)


def bbox_meets(west: Column, south: Column, east: Column, north: Column, box: tuple) -> Column:
    """Do the boxes touch? A missing box passes."""
    w, s, e, n = box
    apart = (west > e) | (east < w) | (south > n) | (north < s)
    return west.isNull() | south.isNull() | east.isNull() | north.isNull() | ~apart


def time_meets(start: Column, end: Column, low=None, high=None) -> Column:
    """Do the windows meet? An open or missing end passes."""
    out = F.lit(True)
    if high is not None:
        out = out & (start.isNull() | (start <= F.lit(high)))
    return out if low is None else out & (end.isNull() | (end >= F.lit(low)))


def published(state: Column) -> Column:
    return state.isin(*PUBLISHED)


def contains_all(blob: Column, terms: list[str]) -> Column:
    """Every term occurs in the text, whatever the case."""
    return reduce(Column.__and__, (F.contains(F.lower(blob), F.lit(t.lower())) for t in terms), F.lit(True))


def unique_tail(df: DataFrame, requests: DataFrame, iri: str = "iri") -> DataFrame:
    """request_id, iri, hits for requests (request_id, tail): the record whose last path segment is the tail; null unless one."""
    tail = F.regexp_extract(F.regexp_replace(F.col(iri), "/+$", ""), "([^/#]*)$", 1)
    keyed = df.select(F.col(iri).alias("iri"), tail.alias("tail"))
    return requests.join(keyed, "tail", "left").groupBy("request_id").agg(F.count("iri").alias("hits"), F.min("iri").alias("m")).select("request_id", F.when(F.col("hits") == 1, F.col("m")).alias("iri"), "hits")


def active_grants(grants: DataFrame, now) -> DataFrame:
    return grants.where(F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now))))


def entitled_principals(grants: DataFrame) -> DataFrame:
    """dataset_id, principals: the distinct ids and lower-cased e-mails."""
    who = grants.select("dataset_id", F.explode(F.array_compact(F.array("principal_id", F.lower("email")))).alias("p"))
    return who.groupBy("dataset_id").agg(F.array_sort(F.collect_set("p")).alias("principals"))


def holders(grants: DataFrame) -> DataFrame:
    """id, p: the records and the names (principal ids, lower-cased e-mails) that hold a grant of them."""
    return grants.select(F.col("dataset_id").alias("id"), F.explode(F.array_compact(F.array("principal_id", F.lower("email")))).alias("p")).distinct()


def asking(callers: DataFrame) -> DataFrame:
    """caller_id, is_steward, custodian_of, and the caller's names a and b (null where there is none, or where it is the same)."""
    a, b = F.col("principal_id"), F.lower("email")
    return callers.select("caller_id", "is_steward", "custodian_of", a.alias("a"), F.when(a.isNull() | (a != b), b).alias("b"))


def _told(df: DataFrame, rows: int = 1 << 20) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def insiders(grants: DataFrame, callers: DataFrame) -> DataFrame:
    """caller_id, id of the datasets whose grant or custody a caller holds: equi-joins, one row for each such pair."""
    asks = callers.select("caller_id", F.explode(F.array_compact(F.array("principal_id", F.lower("email")))).alias("p"))
    return holders(grants).join(asks, "p").select("caller_id", "id").unionByName(callers.where("custodian_of is not null").select("caller_id", F.col("custodian_of").alias("id"))).distinct()


def visibility_class(visibility: Column, is_steward: Column) -> dict[str, Column]:
    """known and full by a record's visibility and a caller's role alone: public and metadata-restricted records are known to all,
    existence-restricted ones to stewards; full (more than the stub): public, or a steward asks."""
    return {"known": (visibility != "allowlisted-existence") | is_steward, "full": (visibility == "public") | is_steward}


def answered(requests: DataFrame, datasets: DataFrame, grants: DataFrame, callers: DataFrame) -> DataFrame:
    """caller_id, id, known, full of every request (caller_id, id): may this caller know of the record, and see more than its stub? Work
    follows the requests; neither callers nor records are multiplied: a request meets the grants by its record and one of its caller's two names,
    so a name that many callers and many grants have makes no product."""
    held = holders(grants)
    rows = requests.join(datasets.select("id", "visibility"), "id").join(asking(callers), "caller_id")
    own = F.coalesce(F.col("custodian_of") == F.col("id"), F.lit(False))
    for p in ("a", "b"):
        rows = rows.join(held.select("id", F.col("p").alias(p), F.lit(True).alias(f"by_{p}")), ["id", p], "left")
        own = own | F.coalesce(f"by_{p}", F.lit(False))
    c = visibility_class(F.col("visibility"), F.col("is_steward"))
    return rows.select("caller_id", "id", (c["known"] | own).alias("known"), (c["full"] | own).alias("full"))


def visible_counts(datasets: DataFrame, grants: DataFrame, callers: DataFrame) -> DataFrame:
    """caller_id, known, full: how many datasets each caller may know of, and see in full, without listing them.

    Records are counted by visibility, so a caller's role gives one number for each. Of the records that the role doesn't cover, the grants of
    each name are counted once, and what both names of a caller hold once for each pair of names, from the name with fewer grants; only
    a record in a caller's custody is looked at caller by caller. So a name that many callers and many grants have makes no product."""
    kinds = datasets.groupBy("visibility").agg(F.count("*").alias("n"))
    roles = kinds.select("n", "visibility", F.explode(F.array(F.lit(True), F.lit(False))).alias("is_steward"))
    c = visibility_class(F.col("visibility"), F.col("is_steward"))
    roles = roles.groupBy("is_steward").agg(F.sum(F.when(c["known"], F.col("n")).otherwise(0)).alias("known"), F.sum(F.when(c["full"], F.col("n")).otherwise(0)).alias("full"))
    plain = visibility_class(F.col("visibility"), F.lit(False))
    closed = datasets.select("id", (~plain["known"]).cast("int").alias("k"), (~plain["full"]).cast("int").alias("f")).where("k = 1 or f = 1")
    held = shared.saved(holders(grants).join(closed, "id"), "held")
    sums = [F.sum("k").alias("k"), F.sum("f").alias("f")]
    names = shared.saved(held.groupBy("p").agg(*sums, F.count("*").alias("n")), "names")
    who = asking(callers)
    lay = who.where("not coalesce(is_steward, false)")  # a steward's role covers all records

    n = lambda p: names.select(F.col("p").alias(p), F.col("n").alias(f"n_{p}"))
    both = lay.select("a", "b").where("a is not null and b is not null").distinct().join(n("a"), "a").join(n("b"), "b")
    both = both.select("a", "b", F.when(F.col("n_a") <= F.col("n_b"), F.col("a")).otherwise(F.col("b")).alias("few"), F.when(F.col("n_a") <= F.col("n_b"), F.col("b")).otherwise(F.col("a")).alias("many"))
    twice = both.join(held.withColumnRenamed("p", "few"), "few").join(held.select("id", F.col("p").alias("many")), ["id", "many"], "left_semi")
    twice = shared.saved(twice.groupBy("a", "b").agg(*[(-s).alias(x) for s, x in zip((F.sum("k"), F.sum("f")), "kf", strict=True)]), "twice")

    kept = lay.where("custodian_of is not null").join(closed.withColumnRenamed("id", "custodian_of"), "custodian_of")
    for p in ("a", "b"):
        kept = kept.join(held.select(F.col("id").alias("custodian_of"), F.col("p").alias(p)), ["custodian_of", p], "left_anti")
    parts = [lay.join(_told(names.select(F.col("p").alias(p), "k", "f")), p) for p in ("a", "b")] + [lay.join(_told(twice), ["a", "b"]), kept]
    more = parts[0].select("caller_id", "k", "f")
    for part in parts[1:]:
        more = more.unionByName(part.select("caller_id", "k", "f"))
    more = more.groupBy("caller_id").agg(*sums)
    out = callers.select("caller_id", "is_steward").join(F.broadcast(roles), "is_steward", "left").join(more, "caller_id", "left")  # two roles
    return out.select("caller_id", *[(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("known", "k"), ("full", "f"))])


def visible(datasets: DataFrame, grants: DataFrame, callers: DataFrame) -> DataFrame:
    """caller_id, id, full for every dataset that a caller may know of. callers: caller_id, principal_id, email, is_steward,
    custodian_of (a dataset id or null).

    The list itself has a row for each caller and record that they may know of, by an equi-join on the role; where answers to
    requests or numbers are wanted, answered() and visible_counts() give these without it."""
    c = visibility_class(F.col("visibility"), F.col("is_steward"))
    open_to = datasets.select("id", "visibility", F.explode(F.array(F.lit(True), F.lit(False))).alias("is_steward")).where(c["known"]).select("id", "is_steward", c["full"].alias("full"))
    each = callers.select("caller_id", "is_steward").join(open_to, "is_steward").select("caller_id", "id", "full")
    mine = insiders(grants, callers).join(datasets.select("id"), "id", "left_semi").select("caller_id", "id", F.lit(True).alias("full"))
    return each.unionByName(mine).groupBy("caller_id", "id").agg(F.bool_or("full").alias("full"))


def stub(df: DataFrame, full: Column, kept: list[str]) -> DataFrame:
    """Null every column that a stub may not show."""
    return df.select(*[F.col(c) if c in kept else F.when(full, F.col(c)).alias(c) for c in df.columns if c != "full"], (~full).alias("redacted"))


def replace_grants(old: DataFrame, new: DataFrame) -> DataFrame:
    """dataset_id, principal_id, action: revoke what is no longer there, grant what is new, keep the rest."""
    a, b = old.select("dataset_id", "principal_id", F.lit(1).alias("o")), new.select("dataset_id", "principal_id", F.lit(1).alias("n"))
    both = a.join(b, ["dataset_id", "principal_id"], "full_outer")
    return both.select("dataset_id", "principal_id", F.when(F.col("n").isNull(), "revoke").when(F.col("o").isNull(), "grant").otherwise("keep").alias("action"))


def ordered(df: DataFrame, *keys: tuple[str, bool], tie: str) -> DataFrame:
    """Stable order: (column, descending?) keys with nulls last, strings without case, then the tie-break column."""

    def one(name, desc):
        c = F.lower(F.col(name)) if df.schema[name].dataType.typeName() == "string" else F.col(name)
        return c.desc_nulls_last() if desc else c.asc_nulls_last()

    return df.orderBy(*[one(*k) for k in keys], F.col(tie).asc_nulls_last())


def placed(df: DataFrame, *keys: tuple[str, bool], tie: str) -> DataFrame:
    """df with `place`, each row's number in the order of ordered(), from 1. The rows are sorted by ranges and written once; a
    row's number is its place in its range after those of the ranges before, so no task sees more than one range."""
    rows = shared.saved(ordered(df, *keys, tie=tie).withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ordered")
    before = F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("__p").agg(F.count("*").alias("n")).select("__p", before.alias("__b"))  # a row for each range
    return rows.join(F.broadcast(starts), "__p").withColumn("place", F.col("__b") + F.col("__i") + 1).drop("__p", "__i", "__b")


def page(df: DataFrame, offset: int, limit: int, cap: int = 200) -> DataFrame:
    return df.offset(offset).limit(min(limit, cap))


def page_after(df: DataFrame, *keys: tuple[str, bool], tie: str, last: dict | None = None, limit: int = 20, cap: int = 200) -> DataFrame:
    """The rows that follow `last` (the keys and tie of the row before, by name; None: from the start) in the order of ordered().

    The rows before are left out by a condition on the keys, which reaches the scan where a key is no string; the page itself is a top-n,
    so a deep page costs what the first one does and nothing is sorted as a whole. Values that many rows share are told apart by the tie."""
    if last is not None:
        later, same = F.lit(False), F.lit(True)
        for name, desc in (*keys, (tie, False)):
            fold = F.lower if name != tie and df.schema[name].dataType.typeName() == "string" else (lambda c: c)
            c, v = fold(F.col(name)), fold(F.lit(last[name]).cast(df.schema[name].dataType))
            beyond = F.lit(False) if last[name] is None else c.isNull() | ((c < v) if desc else (c > v))  # nulls come last
            later, same = later | (same & F.coalesce(beyond, F.lit(False))), same & c.eqNullSafe(v)
        df = df.where(later)
    return ordered(df, *keys, tie=tie).limit(min(limit, cap))


def page_cursors(df: DataFrame, *keys: tuple[str, bool], tie: str, limit: int = 20) -> DataFrame:
    """page, and the keys and tie of each page's last row: what page_after() needs for the page behind it. One sort over ranges serves all pages."""
    rows = placed(df.select(*dict.fromkeys([*[k for k, _ in keys], tie])), *keys, tie=tie)
    return rows.where(F.col("place") % limit == 0).withColumn("page", (F.col("place") / limit).cast("long")).drop("place")


def preview(rows: DataFrame, group: str, order: str, text: str, max_rows: int, max_bytes: int) -> DataFrame:
    """The first rows of each group within a row cap and a cumulative byte cap, and how many of the group were left out."""
    w = Window.partitionBy(group).orderBy(order)
    sized = rows.select("*", F.row_number().over(w).alias("__n"), F.sum(F.octet_length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("bytes"), F.count("*").over(Window.partitionBy(group)).alias("__all"))
    kept = sized.where((F.col("__n") <= max_rows) & (F.col("bytes") <= max_bytes))
    return kept.select(*rows.columns, "bytes", (F.col("__all") - F.count("*").over(Window.partitionBy(group))).alias("removed"))
