"""Change detection, link health, access paths and review queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """source, id, action, hash, fetched_at: created, changed, unchanged (only fetched_at moves on) or kept (not seen again)."""
    a = old.select("source", "id", F.col("hash").alias("h0"), F.col("fetched_at").alias("f0"))
    b = new.select("source", "id", F.col("hash").alias("h1"), F.col("fetched_at").alias("f1"))
    action = F.when(F.col("h0").isNull(), "created").when(F.col("h1").isNull(), "kept").when(F.col("h0") == F.col("h1"), "unchanged").otherwise("changed")
    return a.join(b, ["source", "id"], "full_outer").select("source", "id", action.alias("action"), F.coalesce("h1", "h0").alias("hash"), F.coalesce("f1", "f0").alias("fetched_at"))


def predicate_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, p of quads (id, p, o) whose set of objects differs."""
    side = lambda d, n: d.groupBy("id", "p").agg(F.array_sort(F.collect_set("o")).alias(n))
    return side(old, "a").join(side(new, "b"), ["id", "p"], "full_outer").where("not (a <=> b)").select("id", "p")


def field_revisions(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, old_value, new_value of every tracked field that differs."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])
    a = old.select(key, F.inline(pairs)).withColumnRenamed("v", "old_value")
    b = new.select(key, F.inline(pairs)).withColumnRenamed("v", "new_value")
    return a.join(b, [key, "field"], "full_outer").where("not (old_value <=> new_value)")


def newest(rows: DataFrame, group: str, order: str, tie: str, n: int = 50) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(order), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def promote(drafts: DataFrame, published: DataFrame, decisions: DataFrame) -> DataFrame:
    """id, state, reason after decisions (id, decision, reason): promoted drafts are published and supersede; demoted records
    are drafts with the reason."""
    live = published.select("id", F.lit("published").alias("state")).unionByName(drafts.select("id", F.lit("draft").alias("state")))
    state = live.groupBy("id").agg(F.max("state").alias("state"))
    d = state.join(decisions, "id", "left")
    new = F.when(F.col("decision") == "promote", "published").when(F.col("decision") == "demote", "draft").otherwise(F.col("state"))
    return d.select("id", new.alias("state"), F.when(F.col("decision") == "demote", F.col("reason")).alias("reason"))


def review_queue(items: DataFrame, n: int = 25, by: str | None = None) -> DataFrame:
    """The head of the queue: inbound links, level, then age; for each value of a column if asked."""
    keys = [F.desc("inbound"), F.desc("level"), F.col("created_at"), F.col("id")]
    w = Window.partitionBy(by or F.lit(1)).orderBy(*keys)
    if by is None:
        return items.orderBy(*keys).limit(n)
    return items.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


#: Outcomes that count as a success, and how many newest probes or failures, and revisions, the prober looks back on.
SUCCESS = ("verified", "redirected")
THRESHOLD, HISTORY = 3, 20


def probeable(url: Column) -> Column:
    """Only http(s) addresses are probed; the others are skipped, which says nothing about their health."""
    return F.coalesce(F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://")), F.lit(False))


def probe_outcome(status: Column, location: Column, url: Column | None = None) -> Column:
    """verified, redirected, degraded or unreachable; null (skipped) for an address that isn't probeable, where one is given."""
    out = F.when(status.between(200, 299), "verified").when(status.between(300, 399) & location.isNotNull(), "redirected").when(status.isin(401, 403, 429), "degraded").otherwise("unreachable")
    return out if url is None else F.when(probeable(url), out)


def permanent(status: Column) -> Column:
    return status.isin(301, 308)


def health(probes: DataFrame, cadence_seconds: int = 86400) -> DataFrame:
    """distribution_id, failures, excluded, last_success, last_status, next_due from the probe log: failures counts the probes since
    the last success that were neither verified nor redirected; a path is excluded from THRESHOLD failures on, until its next
    success. Skipped probes (null outcome) don't count.

    Failures after the last success need only that success's place, so two aggregations that combine before the shuffle do;
    no window runs over a path's whole log."""
    good = F.col("outcome").isin(*SUCCESS)
    rows = probes.where("outcome is not null")
    at = F.struct("probed_at", "probe_id")
    per = rows.groupBy("distribution_id").agg(F.max(F.when(good, at)).alias("success"), F.max_by("outcome", at).alias("last_status"), F.max("probed_at").alias("probed"))
    since = rows.where(~good).join(per.select("distribution_id", "success"), "distribution_id").where(F.col("success").isNull() | (at > F.col("success"))).groupBy("distribution_id").agg(F.count("*").alias("failures"))
    out = per.join(since, "distribution_id", "left").withColumn("failures", F.coalesce("failures", F.lit(0)))
    due = F.timestamp_seconds(F.unix_seconds(F.col("probed").cast("timestamp")) + cadence_seconds)
    return out.select("distribution_id", "failures", (F.col("failures") >= THRESHOLD).alias("excluded"), F.col("success.probed_at").alias("last_success"), "last_status", due.alias("next_due"))


def healed(probes: DataFrame) -> DataFrame:
    """distribution_id, n, probe_id, new_value of every address revision that the log leads to, in order (n from 1): at a permanent
    redirect that is the third in a row to one target, unless the target is among the last HISTORY revisions.

    A repeated chance to heal to the target of the chance before never heals, so only changes of target are folded."""
    w = Window.partitionBy("distribution_id").orderBy("probed_at", "probe_id")
    moved = (F.col("outcome") == "redirected") & permanent(F.col("status"))
    for k in range(1, THRESHOLD):
        moved &= (F.lag("outcome", k).over(w) == "redirected") & (F.lag("location", k).over(w) == F.col("location"))
    chances = probes.where("outcome is not null").withColumn("chance", moved).where("chance")
    chances = chances.withColumn("before", F.lag("location").over(w)).where("before is null or before <> location")
    each = chances.groupBy("distribution_id").agg(F.array_sort(F.collect_list(F.struct("probed_at", "probe_id", "location"))).alias("c"))
    known = lambda acc: F.transform(F.slice(acc, F.greatest(F.size(acc) - (HISTORY - 1), F.lit(1)), F.lit(HISTORY)), lambda r: r["location"])
    none = F.slice("c", 1, 0)
    done = F.aggregate("c", none, lambda acc, x: F.when(F.array_contains(known(acc), x["location"]), acc).otherwise(F.concat(acc, F.array(x))))
    return each.select("distribution_id", F.posexplode(done).alias("i", "r")).select("distribution_id", (F.col("i") + 1).alias("n"), F.col("r.probe_id").alias("probe_id"), F.col("r.location").alias("new_value"))


def due(known: DataFrame, states: DataFrame, now) -> DataFrame:
    """distribution_id of what was never probed or is due, never probed first, then the oldest."""
    d = known.join(states.select("distribution_id", "next_due"), "distribution_id", "left")
    return d.where(F.col("next_due").isNull() | (F.col("next_due") <= F.lit(now))).orderBy(F.col("next_due").asc_nulls_first(), "distribution_id")


def heals(probes: DataFrame, revisions: DataFrame) -> DataFrame:
    """distribution_id, location of those whose newest three probes are redirects to one target, the newest a permanent one, and
    the target isn't among the last 20 revisions (distribution_id, new_value, n: newest 1)."""
    w = Window.partitionBy("distribution_id").orderBy(F.desc("probed_at"), F.desc("probe_id"))
    three = probes.withColumn("n", F.row_number().over(w)).where("n <= 3")
    same = three.groupBy("distribution_id").agg(F.count("*").alias("k"), F.count_if(F.col("outcome") == "redirected").alias("r"), F.count_distinct("location").alias("t"), F.max("location").alias("location"), F.max_by("status", -F.col("n")).alias("newest"))
    out = same.where("k = 3 and r = 3 and t = 1").where(permanent(F.col("newest"))).select("distribution_id", "location")
    return out.join(revisions.where("n <= 20").select("distribution_id", F.col("new_value").alias("location")), ["distribution_id", "location"], "left_anti")


#: What an access plan says of its path.
PINNED = "You pinned this distribution and its last probe was %s."
SKIPPED = "%d distribution(s) were skipped: the prober's last attempt did not reach them. This is a live sibling."
NONE_LIVE = "Every recorded path failed its last probe. This plan points at the least recently failed one; expect it not to work."


def can_slice(protocol: Column, ranges: Column, index: Column) -> Column:
    return protocol.isNotNull() | (F.coalesce(ranges, F.lit(False)) & index.isNotNull())


def access_path(paths: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, dataset_id, distribution_id, reachable, alternatives, note for requests (request_id, dataset_id, pinned,
    wants_slice) and paths (dataset_id, distribution_id, url, reachable, health, protocol, sliceable, chunk_index, anonymous,
    requester_pays, bulk).

    A pinned path is taken as it is, with a note if its last probe failed; a pin that the dataset doesn't have gives no path (null).
    Else a reachable one; then, only where a slice is wanted, one that can be sliced; not known to need an account; not known to
    cost the requester; bulk; the smallest id. The note says how many were skipped, or that none was reached."""
    usable = paths.where("url is not null")
    d = requests.select("request_id", "dataset_id", "pinned", "wants_slice").join(usable, "dataset_id", "left")
    pin = F.coalesce(F.col("pinned") == F.col("distribution_id"), F.lit(False))
    rank = [
        F.desc(pin), F.desc("reachable"), F.desc(F.col("wants_slice") & can_slice(F.col("protocol"), F.col("sliceable"), F.col("chunk_index"))),
        F.desc(F.coalesce("anonymous", F.lit(True))), F.asc(F.coalesce("requester_pays", F.lit(False))), F.desc(F.coalesce("bulk", F.lit(False))), "distribution_id",
    ]
    every = Window.partitionBy("request_id")
    rows = d.withColumns({"n": F.row_number().over(every.orderBy(*rank)), "all": F.count("distribution_id").over(every), "dead": F.count_if(~F.col("reachable")).over(every), "pin": pin}).where("n = 1")
    note = (
        F.when(F.col("pin"), F.when(~F.col("reachable"), F.format_string(PINNED, F.coalesce("health", F.lit("unknown")))))
        .when((F.col("dead") > 0) & F.col("reachable"), F.format_string(SKIPPED, F.col("dead")))
        .when(F.col("dead") > 0, NONE_LIVE)
    )
    missing = F.col("pinned").isNotNull() & ~F.col("pin")
    mine = lambda c: F.when(~missing, c)
    return rows.select("request_id", "dataset_id", mine(F.col("distribution_id")).alias("distribution_id"), mine(F.col("reachable")).alias("reachable"), F.greatest(F.col("all") - 1, F.lit(0)).alias("alternatives"), mine(note).alias("note"))


def access_mode(protocol: Column, ranges: Column, index: Column) -> Column:
    """subsetting, partial-read or redirect."""
    return F.when(protocol.isNotNull(), "subsetting").when(ranges & index.isNotNull(), "partial-read").otherwise("redirect")


def recipe(paths: DataFrame, recipes: DataFrame) -> DataFrame:
    """distribution_id, reader: the longest format key that the label and media type contain."""
    text = F.lower(F.concat_ws(" ", "format_label", "media_type"))
    hit = paths.select("distribution_id", text.alias("t")).join(F.broadcast(recipes), F.contains(F.col("t"), F.col("key")))  # some twenty readers
    best = hit.groupBy("distribution_id").agg(F.max(F.struct(F.length("key").alias("n"), "key", "reader")).alias("m"))
    return paths.select("distribution_id").join(best, "distribution_id", "left").select("distribution_id", "m.reader")


def conflicts(diff: DataFrame, confirmed: DataFrame) -> DataFrame:
    """id, p of changed predicates that a reviewer had confirmed (id, fields array)."""
    return diff.join(confirmed.select("id", F.explode("fields").alias("p")).distinct(), ["id", "p"], "left_semi")


def caveats(paths: DataFrame) -> DataFrame:
    """distribution_id, caveats: what a plan for this path has to say."""
    said = F.array_compact(F.array(
        F.when(~F.col("reachable"), F.lit("unreachable at the last probe")),
        F.when(~F.col("anonymous"), F.lit("needs an account")),
        F.when(F.col("requester_pays"), F.lit("the requester pays for transfer")),
        F.when(F.col("sliceable") & F.col("chunk_index").isNull(), F.lit("ranges without a chunk index")),
    ))
    return paths.select("distribution_id", said.alias("caveats"))


def download_target(paths: DataFrame) -> DataFrame:
    """dataset_id, distribution_id of the http(s) path that is reachable, then not known to need an account, then bulk."""
    w = Window.partitionBy("dataset_id").orderBy(F.desc("reachable"), F.desc(F.coalesce("anonymous", F.lit(True))), F.desc(F.coalesce("bulk", F.lit(False))), "distribution_id")
    return paths.where(F.col("url").rlike("^https?://")).withColumn("n", F.row_number().over(w)).where("n = 1").select("dataset_id", "distribution_id")
