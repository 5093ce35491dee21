"""Catalogue records from the rows of a seed inventory, built only from what a row states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import norm

#: The columns of a seed row that are read. A row's other columns, such as notes to its curators, are never published.
ROW = {
    "name": "string", "slug": "string", "domain": "string", "domain_name": "string", "verified": "boolean", "tier": "int", "note": "string", "pointer_rationale": "string", "access": "string", "format": "string",
    "bulk": "boolean", "anonymous": "boolean", "access_barrier": "string", "api": "string", "secondary_access": "string", "license": "string", "doi": "string", "update_frequency": "string", "last_update": "string",
    "spatial_granularity": "string", "time_resolution": "string", "spatial_resolution_m": "double", "derived_from": "array<string>", "output_of_analysis": "array<string>", "provenance": "string", "caveats": "array<string>",
}
#: What an inventory says of how often a dataset is updated, and what it means; the terms of spatial granularity.
FREQUENCIES = {
    "annual": "P1Y", "~annual": "P1Y", "annual but w 2-3 yr lag": "P1Y", "annual w 2 year delay": "P1Y", "quarterly": "P3M", "monthly": "P1M", "ongoing": "irregular", "not regular": "irregular",
    "irregular": "irregular", "on-demand": "on-demand", "varies by country": "irregular", "discontinued": "discontinued", "no further support planned": "discontinued",
}
GRANULARITIES = ("nodal", "zonal", "gridded", "administrative", "point", "national", "global")
#: What a record says where its row is silent; %s is the row's own word. A caller may pass texts of its own.
TEXTS = {
    "unreviewed": "Licence and access have not been reviewed.",
    "barrier": "No access path is recorded; the inventory names this barrier: %s.",
    "no-reason": "No access path is recorded, and no reason for it.",
    "caveat-unreviewed": "Not reviewed: the licence and the tier are a first guess.",
    "caveat-barrier": "There is a barrier (%s): listed so that it can be found, not because it can be had.",
    "caveat-assumed": "Access has not been checked: an account is assumed.",
    "caveat-undocumented": "The inventory has nothing on documentation; that it is said to have none is no finding.",
    "caveat-reference": "For reference only: without fields and links.",
}


def stated_cadence(text: Column) -> Column:
    """The duration that a row states as it is written (P1M is a month, PT1M a minute), or the meaning of its words without regard to case; null for
    anything else."""
    t = F.trim(text)
    words = F.create_map(*[F.lit(x) for kv in FREQUENCIES.items() for x in kv])
    return F.when(t.rlike(r"^P(?:\d+[YMWD])+(?:T(?:\d+[HMS])+)?$|^PT(?:\d+[HMS])+$"), t).otherwise(words[F.lower(t)])


def _clean(text: Column) -> Column:
    """Blanks as single spaces; null for a text without anything else."""
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def _with(text: str, word: Column) -> Column:
    before, _, after = text.partition("%s")
    return F.concat(F.lit(before), word, F.lit(after))


def records(rows: DataFrame, licences: DataFrame, base: str, texts: dict[str, str] = TEXTS, granularities: tuple[str, ...] = GRANULARITIES) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of seed rows; columns of ROW that rows lack are silent.

    A record: id (base + slug), slug, title, description, data_domain, documentation_status, completeness_level (1), review_state (confirmed only if verified),
    visibility, modified, update_cadence, spatial_granularity, time_resolution, spatial_resolution_m, derived_from and output_of_analysis (a slug becomes base +
    slug, an address stays), tier, reference_only, pointer_rationale (why there is no access path; null where there is one and none is given), access_barrier, persistent_id,
    license_id, license_note, redistribution_allowed, commercial_use_allowed, share_alike, restriction, anonymous_access, bulk_download, provenance_class, summary, distributions
    (array of id, kind, access_url, format_label, bulk, anonymous; null without an access path) and caveats (findings of the row first, then what its
    silence means). rejected: slug, title, problem of rows with an unknown granularity or without a name; they are no records.

    licences: raw, id, note, redistribution, commercial, share_alike (the reviewed map, see norm.resolve_license). One projection and one
    broadcast of that map; nothing is shuffled, so repeated rows stay repeated (see norm.merge_by_slug)."""
    have = set(rows.columns)
    d = rows.select(*[(F.col(c).cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in ROW.items()])
    d = norm.resolve_license(d, licences, "license")
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    slug = F.coalesce(F.nullif(F.trim("slug"), F.lit("")), norm.slugify(F.col("name")))
    d = d.withColumns({"slug": slug, "verified": F.coalesce("verified", F.lit(False)), "note": _clean(F.col("note")), "pointer_rationale": _clean(F.col("pointer_rationale")), **{c: text(c) for c in ("access", "format", "api", "secondary_access", "access_barrier", "domain_name")}})
    problem = F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "no-name").when(F.col("spatial_granularity") != "", F.when(~F.col("spatial_granularity").isin(*granularities), F.concat(F.lit("granularity:"), "spatial_granularity")))
    d = d.withColumn("problem", problem)
    rejected = d.where("problem is not null").select("slug", F.col("name").alias("title"), "problem")

    c, iri, cadence = F.col, F.concat(F.lit(base), F.col("slug")), stated_cadence(F.col("update_frequency"))
    access = norm.access_posture(c("access_barrier"), c("anonymous"), cadence)
    reference = F.coalesce(c("tier") == 3, F.lit(False))
    why = F.coalesce("pointer_rationale", F.when(c("access").isNull(), F.coalesce(_with(texts["barrier"], c("access_barrier")), F.lit(texts["no-reason"]))))
    head = F.concat_ws(", ", F.concat("name", F.lit(", a "), F.coalesce("domain_name", F.lit("grid")), F.lit(" dataset")), F.concat(F.lit("published as "), "format"), F.concat(F.lit("available at "), "access"))
    description = F.concat_ws(" ", F.concat(head, F.lit(".")), "note", "pointer_rationale", F.when(~c("verified"), texts["unreviewed"]))
    way = lambda kind, url, form, bulk, anonymous: F.struct(F.concat(iri, F.lit(f"--{kind}")).alias("id"), F.lit(kind).alias("kind"), url.alias("access_url"), form.cast("string").alias("format_label"), bulk.cast("boolean").alias("bulk"), anonymous.cast("boolean").alias("anonymous"))
    second, none = F.coalesce("api", "secondary_access"), F.lit(None)
    ways = F.array_compact(F.array(F.when(c("access").isNotNull(), way("primary", c("access"), c("format"), c("bulk"), c("anonymous"))), F.when(second.isNotNull(), way("secondary", second, F.when(c("api").isNotNull(), "API"), none, none))))
    said = F.array_compact(F.transform(F.coalesce("caveats", F.array().cast("array<string>")), _clean))
    silent = F.array_compact(F.array(
        F.when(~c("verified"), texts["caveat-unreviewed"]), _with(texts["caveat-barrier"], c("access_barrier")), F.when(access["assumed"], texts["caveat-assumed"]),
        F.when(~reference & c("note").isNull(), texts["caveat-undocumented"]), F.when(reference, texts["caveat-reference"]),
    ))
    doi = F.trim("doi")
    whole = lambda x: F.when(F.contains(x, F.lit("://")), x).otherwise(F.concat(F.lit(base), x))
    filled = lambda a: F.when(F.size(a) > 0, a)
    out = d.where("problem is null").select(
        iri.alias("id"), "slug", c("name").alias("title"), description.alias("description"), "domain",
        F.when(reference | c("note").isNull(), "none").otherwise("partial").alias("documentation_status"), F.lit(1).alias("completeness_level"), F.when(c("verified"), "confirmed").otherwise("draft").alias("review_state"), F.lit("public").alias("visibility"),
        norm.vintage(c("last_update")).alias("modified"), cadence.alias("update_cadence"), F.nullif("spatial_granularity", F.lit("")).alias("spatial_granularity"), stated_cadence(c("time_resolution")).alias("time_resolution"), "spatial_resolution_m",
        filled(F.transform("derived_from", whole)).alias("derived_from"), filled(c("output_of_analysis")).alias("output_of_analysis"), "tier", reference.alias("reference_only"), why.alias("pointer_rationale"), "access_barrier",
        F.when(doi != "", F.when(F.startswith(doi, F.lit("http")), doi).otherwise(F.concat(F.lit("https://doi.org/"), F.regexp_replace(doi, "^doi:", "")))).alias("persistent_id"),
        "license_id", "license_note", "redistribution_allowed", "commercial_use_allowed", "share_alike", access["restriction"].alias("restriction"), access["anonymous_access"].alias("anonymous_access"), c("bulk").alias("bulk_download"),
        norm.provenance_class(c("provenance")).alias("provenance_class"), c("note").alias("summary"), filled(ways).alias("distributions"), F.concat(said, silent).alias("caveats"),
    ).withColumn("data_domain", F.array("domain")).drop("domain")
    return out, rejected
