"""Cleaning and normalisation as column expressions; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words that say nothing about a column.
NOISE = ("value", "values", "val", "data", "field", "col", "column", "avg", "mean", "the", "of", "per", "in", "at")
#: Cadence phrases and the duration each states.
CADENCE_PHRASES = (
    ("continuous", "PT1H"), ("real-time", "PT1H"), ("real time", "PT1H"), ("sub-hourly", "PT1H"), ("hourly", "PT1H"),
    ("twice daily", "PT12H"), ("daily", "P1D"), ("weekly", "P7D"), ("bi-weekly", "P14D"), ("fortnightly", "P14D"),
    ("monthly", "P1M"), ("quarterly", "P3M"), ("semi-annually", "P6M"), ("biannually", "P6M"), ("annually", "P1Y"),
    ("annual", "P1Y"), ("yearly", "P1Y"),
)
CADENCE_IRREGULAR = ("varies", "periodic", "occasional", "irregular", "sporadic", "ad hoc", "as new data", "as data", "when new", "as available", "as soon as", "ongoing", "continuously updated", "tbd", "unknown")
CADENCE_ON_DEMAND = ("as needed", "as required", "on demand", "on request", "need-to-update")
CADENCE_DISCONTINUED = ("not updated", "no longer", "never", "not currently being updated", "static", "one-time", "one time", "complete", "final", "no update")
#: Cadences that are no intervals.
CADENCE_TOKENS = ("irregular", "on-demand", "discontinued")
#: Patterns of a lower-cased licence string, in order, and the SPDX identifier each proves.
LICENCES = (
    (r"creativecommons\.org/publicdomain/zero/1\.0", "CC0-1.0"),
    (r"creativecommons\.org/licenses/by/4\.0", "CC-BY-4.0"),
    (r"creativecommons\.org/licenses/by-sa/4\.0", "CC-BY-SA-4.0"),
    (r"creativecommons\.org/licenses/by-nc/4\.0", "CC-BY-NC-4.0"),
    (r"creativecommons\.org/licenses/by/3\.0", "CC-BY-3.0"),
    (r"opendatacommons\.org/licenses/odbl", "ODbL-1.0"),
    (r"\bcc[- ]?by[- ]?sa[- ]?4(\.0)?\b", "CC-BY-SA-4.0"),
    (r"\bcc[- ]?by[- ]?nc[- ]?4(\.0)?\b", "CC-BY-NC-4.0"),
    (r"\bcc[- ]?by[- ]?4(\.0)?\b", "CC-BY-4.0"),
    (r"\bcc[- ]?by[- ]?3(\.0)?\b", "CC-BY-3.0"),
    (r"\bcc[- ]?0\b|\bcc zero\b", "CC0-1.0"),
    (r"creative commons attribution[ -]non[ -]?commercial 4\.0", "CC-BY-NC-4.0"),
    (r"creative commons attribution[ -]share[ -]?alike 4\.0", "CC-BY-SA-4.0"),
    (r"creative commons attribut\w* 4\.0", "CC-BY-4.0"),
    (r"creative commons attribut\w* 3\.0", "CC-BY-3.0"),
    (r"usa\.gov/publicdomain|17 u\.s\.c\.? § ?105|u\.s\.? government work", "CC0-1.0"),
    (r"\bapache[ -]?2(\.0)?\b", "Apache-2.0"),
    (r"\bmit license\b", "MIT"),
)
#: Provenance words, access barriers.
PROVENANCE = {"primary": "primary", "curated": "curated", "curated benchmark": "curated", "modeled": "modeled", "modelled": "modeled", "reanalysis": "reanalysis", "derived": "derived", "synthetic": "synthetic", "osm-derived": "osmDerived", "osm-derived + curated": "osmDerived", "institutional": "institutional"}
BARRIERS = {"restricted": "ceii", "commercial-paywall": "commercialPaywall", "proprietary": "commercialPaywall"}


def slugify(text: Column, limit: int = 80) -> Column:
    """Lower-case letters and digits joined by single dashes; too long: a prefix and 8 digits of the text's SHA-256; empty: unnamed."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.concat(F.regexp_replace(F.substring(slug, 1, limit - 9), "-+$", ""), F.lit("-"), F.substring(F.sha2(text, 256), 1, 8))
    return F.when(F.length(slug) > limit, cut).when(slug == "", "unnamed").otherwise(slug)


def local_name(iri: Column) -> Column:
    """What follows the last `/` or `#`, trailing slashes apart."""
    return F.regexp_extract(F.regexp_replace(iri, "/+$", ""), "([^/#]*)$", 1)


def name_tokens(text: Column) -> Column:
    """Sorted words of a column name: camel case, letter-digit edges and punctuation part them; noise words go unless that
    leaves none; repeated words stay."""
    apart = F.regexp_replace(F.coalesce(text, F.lit("")), "(?<=[a-z0-9])(?=[A-Z])", " ")
    apart = F.regexp_replace(apart, "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", " ")
    parts = F.filter(F.split(F.lower(apart), "[^a-z0-9]+"), lambda w: w != "")
    kept = F.filter(parts, lambda w: ~w.isin(*NOISE))
    return F.array_sort(F.when(F.size(kept) > 0, kept).otherwise(parts))


def name_key(text: Column) -> Column:
    return F.array_join(name_tokens(text), " ")


def search_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def export_words(text: Column) -> Column:
    """The distinct sorted lower-case words, joined by blanks."""
    return F.array_join(F.array_sort(F.array_distinct(search_tokens(text))), " ")


def cadence_seconds(text: Column) -> Column:
    """Seconds of an ISO-8601 duration (a year is 365 days, a month 30); null for anything else and for a bare `P`."""
    pattern = r"^P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$"
    t = F.trim(text)
    part = [F.coalesce(F.regexp_extract(t, pattern, i).try_cast("long"), F.lit(0)) for i in range(1, 8)]
    total = sum((p * s for p, s in zip(part, (365 * 86400, 30 * 86400, 7 * 86400, 86400, 3600, 60, 1), strict=True)), F.lit(0).cast("long"))
    return F.when(t.rlike(pattern) & t.rlike(r"\d"), total)


def cadence_token(text: Column) -> Column:
    return F.when(F.trim(text).isin(*CADENCE_TOKENS), F.trim(text))


def cadence_from_phrase(text: Column) -> Column:
    """A duration or cadence token for free text: first that it has ended, then on demand, then a period, then irregular;
    in each the longest phrase first; null when nothing is understood."""
    raw = F.trim(text)
    t = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    iso = r"^P(\d+Y)?(\d+M)?(\d+W)?(\d+D)?(T(\d+H)?(\d+M)?(\d+S)?)?$"
    rules = [(p, "discontinued") for p in sorted(CADENCE_DISCONTINUED, key=len, reverse=True)]
    rules += [(p, "on-demand") for p in sorted(CADENCE_ON_DEMAND, key=len, reverse=True)]
    rules += sorted(CADENCE_PHRASES, key=lambda p: -len(p[0]))
    rules += [(p, "irregular") for p in sorted(CADENCE_IRREGULAR, key=len, reverse=True)]

    def said(x):
        out = F.when(x.isin("", "n/a", "na", "none", "-"), None).when(raw.rlike(iso) | raw.isin(*CADENCE_TOKENS), raw)
        for phrase, value in rules:
            out = out.when(F.contains(x, F.lit(phrase)), value)
        return out

    return once(t, said)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once a row: Spark repeats an expression in every branch of a CASE, but not a lambda's argument."""
    return F.transform(F.array(value), use)[0]


def license_to_spdx(text: Column) -> Column:
    """The SPDX identifier that an unambiguous pattern proves, else the text as it is. Markdown links are unwrapped first."""
    t = F.lower(F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"\[([^\]]+)\]\(([^)]+)\)", "$1 $2"))

    def proved(x):
        out = F.when(x.isNull(), None)
        for pattern, spdx in LICENCES:
            out = out.when(x.rlike(pattern), spdx)
        return out.otherwise(text)

    return once(t, proved)


def resolve_license(rows: DataFrame, known: DataFrame, raw: str = "license") -> DataFrame:
    """Add license_id, license_note, redistribution_allowed, commercial_use_allowed, share_alike. known: raw text, id, note, redistribution, and
    commercial and share_alike if the map states them (a small reviewed map, also of dual licences). Missing: Unstated; not in the
    map: Unreviewed-<slug>; both forbid redistribution and say nothing of the rest."""
    more = {c: F.col(c) if c in known.columns else F.lit(None).cast("boolean") for c in ("commercial", "share_alike")}
    k = known.select(F.col("raw").alias("__raw"), F.col("id").alias("__id"), F.col("note").alias("__note"), F.col("redistribution").alias("__r"), *[x.alias(f"__{c}") for c, x in more.items()])
    t = F.trim(F.col(raw))
    out = rows.join(F.broadcast(k), t == F.col("__raw"), "left")  # the map is a reviewed file of some hundred rows
    missing = t.isNull() | (t == "")
    return out.select(
        rows["*"],
        F.when(missing, "LicenseRef-Unstated").otherwise(F.coalesce("__id", F.concat(F.lit("LicenseRef-Unreviewed-"), slugify(t, 40)))).alias("license_id"),
        F.when(missing, "unstated").otherwise(F.coalesce("__note", F.when(F.col("__id").isNull(), F.lit("unreviewed")))).alias("license_note"),
        F.when(missing | F.col("__id").isNull(), F.lit(False)).otherwise(F.col("__r")).alias("redistribution_allowed"),
        F.col("__commercial").alias("commercial_use_allowed"),
        F.col("__share_alike").alias("share_alike"),
    )


def vintage(text: Column) -> Column:
    """YYYY, YYYY-MM or an ISO date as the earliest moment it can mean (UTC); null for anything else."""
    t = F.trim(text)
    return F.when(t.rlike(r"^\d{4}$"), F.try_to_timestamp(F.concat(t, F.lit("-01-01")))).when(t.rlike(r"^\d{4}-\d{2}$"), F.try_to_timestamp(F.concat(t, F.lit("-01")))).when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(t))


def access_posture(barrier: Column, anonymous: Column, cadence: Column) -> Column:
    """struct<restriction, anonymous_access, assumed>: a known barrier wins, then an ended publication, then the stated
    anonymous access; silence is taken as an account and flagged."""
    known = F.create_map(*[F.lit(x) for kv in BARRIERS.items() for x in kv])[F.coalesce(barrier, F.lit(""))]
    ended = F.coalesce(cadence == "discontinued", F.lit(False))
    restriction = F.coalesce(known, F.when(ended, "discontinued").when(anonymous, "none").otherwise("accountRequired"))
    assumed = anonymous.isNull() & ~ended & known.isNull()
    return F.struct(restriction.alias("restriction"), F.coalesce(anonymous, F.lit(False)).alias("anonymous_access"), assumed.alias("assumed"))


def provenance_class(text: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in PROVENANCE.items() for x in kv])[F.trim(F.coalesce(text, F.lit("")))], F.lit("curated"))


def description_of(name: Column, domain: Column, form: Column, access: Column, note: Column, verified: Column) -> Column:
    """A description assembled only from what a row states."""
    head = F.concat_ws(", ", F.concat(name, F.lit(", a "), F.coalesce(domain, F.lit("grid")), F.lit(" dataset")), F.concat(F.lit("published as "), form), F.concat(F.lit("available at "), access))
    warn = F.when(~F.coalesce(verified, F.lit(False)), "Licence and access have not been reviewed.")
    return F.concat_ws(" ", F.concat(head, F.lit(".")), note, warn)


def to_bool(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False)


def field_bucket(n: Column) -> Column:
    return F.when(n.isNull() | (n <= 0), "none").when(n < 10, "1-9").when(n < 50, "10-49").otherwise("50+")


def bbox_wkt(west: Column, south: Column, east: Column, north: Column) -> Column:
    """A polygon, null if a side is missing or out of range or the sides are swapped."""
    ok = west.between(-180, 180) & east.between(-180, 180) & south.between(-90, 90) & north.between(-90, 90) & (west <= east) & (south <= north)
    s = [c.cast("string") for c in (west, south, east, north)]
    points = [F.concat_ws(" ", s[a], s[b]) for a, b in ((0, 1), (2, 1), (2, 3), (0, 3), (0, 1))]
    return F.when(ok, F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *points), F.lit("))")))


def dtype_name(code: Column) -> Column:
    """`<f4` as float32 and so on; other text as it is."""
    kind = F.regexp_extract(code, r"^[<>|=]?([biufSUO])(\d*)$", 1)
    size = F.regexp_extract(code, r"^[<>|=]?([biufSUO])(\d*)$", 2).try_cast("int")
    name = F.create_map(*map(F.lit, ("b", "bool", "i", "int", "u", "uint", "f", "float", "S", "bytes", "U", "string", "O", "object")))[kind]
    return F.when(kind.isin("i", "u", "f"), F.concat(name, (size * 8).cast("string"))).when(kind != "", name).otherwise(code)


def content_hash(df: DataFrame, *columns: str) -> Column:
    """SHA-256 of the JSON of the columns in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns or df.columns)), {"ignoreNullFields": "false"}), 256)


#: Second labels under a country's domain below which sites are registered.
REGISTRIES = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "ltd", "mil", "ne", "net", "nic", "or", "org", "plc", "sch")


def publisher_key(url: Column, platforms: tuple[str, ...] = ()) -> Column:
    """The registered domain of the host: its last two labels, or three under a country's registry such as gov.uk; for a hosting
    platform also the first path segment."""
    host = F.lower(F.regexp_extract(url, r"^[a-z]+://([^/?#:]+)", 1))
    site = F.regexp_extract(host, rf"([^.]+\.(?:{'|'.join(REGISTRIES)})\.[a-z]{{2}}|[^.]+\.[^.]+)$", 1)
    first = F.regexp_extract(url, r"^[a-z]+://[^/?#]+/([^/?#]+)", 1)
    return F.when(site.isin(*platforms) & (first != ""), F.concat(site, F.lit("/"), first)).otherwise(F.when(site != "", site)) if platforms else F.when(site != "", site)

def to_natural(value: Column, units: Column, base: Column) -> Column:
    return F.when(units.isin("NATURAL", "NATURAL_UNITS"), value).when(units == "COMPONENT_BASE", value * base)


def unit_factor(kind_a: Column, mult_a: Column, off_a: Column, kind_b: Column, mult_b: Column, off_b: Column) -> Column:
    """The factor from unit a to unit b; null unless both measure the same kind, have multipliers and no offset."""
    ok = (kind_a == kind_b) & (F.coalesce(off_a, F.lit(0.0)) == 0) & (F.coalesce(off_b, F.lit(0.0)) == 0) & (mult_b != 0)
    return F.when(ok, mult_a / mult_b)


def merge_by_slug(rows: DataFrame, slug: str = "slug", domain: str = "domain", verified: str = "verified") -> DataFrame:
    """One row of each slug: the verified one, then the one with most filled columns, then the smallest domain; other_domains
    has the rest, sorted."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in rows.columns), F.lit(0))
    w = Window.partitionBy(slug)
    n = F.row_number().over(w.orderBy(F.desc(F.coalesce(F.col(verified), F.lit(False)).cast("int")), F.desc(filled), domain))
    every = F.collect_set(domain).over(w)
    return rows.withColumn("__n", n).withColumn("__all", every).where("__n = 1").select(rows["*"], F.array_sort(F.array_remove(F.col("__all"), F.col(domain))).alias("other_domains"))
