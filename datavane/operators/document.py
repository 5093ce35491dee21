"""The search document of a record: its own columns, labels from the vocabulary, inferred ancestors and computed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import norm
from .rollups import HEALTH


def _last_part(iri: Column) -> Column:
    return F.element_at(F.split(iri, "[/#]"), -1)


def labelled_refs(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """id, kind, refs: for pairs (id, kind, iri) the distinct iris of a record and kind with their labels, as an array of (iri, label, notation) in the order of iri;
    the last part of the iri where labels (iri, label, notation) has none. Pairs are made distinct before they meet the labels."""
    one = labels.groupBy("iri").agg(F.min(F.struct("label", "notation")).alias("l"))
    d = pairs.where("iri is not null").select("id", "kind", "iri").distinct().join(one, "iri", "left")
    ref = F.struct("iri", F.coalesce("l.label", _last_part(F.col("iri")), "iri").alias("label"), F.col("l.notation").alias("notation"))
    return d.groupBy("id", "kind").agg(F.array_sort(F.collect_list(ref)).alias("refs"))


def expanded(pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """id, expanded: the sorted concepts (id, iri) of a record with all their ancestors (closure: node, ancestor), so that a filter on a
    wider concept finds it."""
    own = pairs.where("iri is not null").select("id", "iri").distinct()
    up = own.join(closure.select(F.col("node").alias("iri"), "ancestor"), "iri").select("id", F.col("ancestor").alias("iri"))
    return own.unionByName(up).distinct().groupBy("id").agg(F.array_sort(F.collect_list("iri")).alias("expanded"))


def access(distributions: DataFrame) -> DataFrame:
    """id and what the access paths (id, distribution_id, media_type, restriction, bulk, ranges, protocol, health) of a record say together: distributions (array in
    order of their ids), formats, protocols, has_range_requests, any_bulk, worst_link_health (of those with one), all_unreachable."""
    rank = F.array_position(F.array(*map(F.lit, HEALTH)), F.col("health"))
    path = F.struct("distribution_id", "media_type", "restriction", "bulk", "ranges", "protocol", "health")
    return distributions.groupBy("id").agg(
        F.array_sort(F.collect_list(path)).alias("distributions"),
        F.array_sort(F.collect_set("media_type")).alias("formats"),
        F.array_sort(F.collect_set("protocol")).alias("protocols"),
        F.bool_or(F.coalesce("ranges", F.lit(False))).alias("has_range_requests"),
        F.bool_or(F.coalesce("bulk", F.lit(False))).alias("any_bulk"),
        F.min_by("health", F.when(rank > 0, rank)).alias("worst_link_health"),
        F.every(F.coalesce(F.col("health") == "unreachable", F.lit(False))).alias("all_unreachable"),
    )


def badges(grades: DataFrame) -> DataFrame:
    """id, provenance, documentation, currency of grades (id, facet, grade): the best where there are several, so that no order of rows matters."""
    facet = lambda f: F.min(F.when(F.col("facet") == f, F.col("grade"))).alias(f)
    return grades.groupBy("id").agg(*[facet(f) for f in ("provenance", "documentation", "currency")])


def whole_documents(datasets: DataFrame, fields: DataFrame, refs: DataFrame, labels: DataFrame, closure: DataFrame, distributions: DataFrame, grades: DataFrame, upstream: DataFrame, inbound: DataFrame, entitled: DataFrame) -> DataFrame:
    """One row a record of datasets (id, title, tier, level, restriction, bulk, reference_only, review_state and more, which stay) with

    concepts (of fields: id, part, concept) and one column for each kind of refs (id, kind, iri) with labels; concept_iris_expanded; field_count and its bucket; what
    access() says of the distributions (a path's own restriction before the record's); bulk_download (true if a path says so, else what the record says);
    the badges (provenance and documentation only from level 2 on, and only if both are there: quality_assessed); upstream_count (id, target: different ones);
    inbound_link_count (id, inbound); entitled_principals (id, principal; sorted); reference_only also for tier 3; review_state draft where none is stated.

    Every side is combined by id before it is joined by id, so no join multiplies rows, and the records are shuffled once. A record's own
    lists are arrays of its row, as an index takes them. A record without children has empty arrays, zeros and nulls."""
    kinds = sorted(("concepts", "data_domains", "supported_analysis", "excluded_analysis", "output_of_analysis"))
    pairs = fields.select("id", F.lit("concepts").alias("kind"), F.col("concept").alias("iri"))
    named = labelled_refs(pairs.unionByName(refs.select("id", "kind", "iri")), labels)
    per_kind = named.groupBy("id").agg(*[F.first(F.when(F.col("kind") == k, F.col("refs")), ignorenulls=True).alias(k) for k in kinds])  # one row a kind
    own = datasets.select("id", F.col("restriction").alias("__restriction"))
    paths = distributions.join(own, "id").withColumn("restriction", F.coalesce("restriction", "__restriction"))
    sides = [
        per_kind,
        expanded(pairs, closure),
        fields.groupBy("id").agg(F.count_distinct("part").alias("field_count")),
        access(paths),
        badges(grades),
        upstream.groupBy("id").agg(F.count_distinct("target").alias("upstream_count")),
        inbound.select("id", F.col("inbound").alias("inbound_link_count")),
        entitled.groupBy("id").agg(F.array_sort(F.collect_set("principal")).alias("entitled_principals")),
    ]
    out = datasets
    for side in sides:
        out = out.join(side, "id", "left")
    out = out.fillna(0, ["field_count", "upstream_count", "inbound_link_count"])
    types = dict(out.dtypes)
    lists = (*kinds, "expanded", "distributions", "formats", "protocols", "entitled_principals")
    out = out.withColumns({c: F.coalesce(c, F.array().cast(types[c])) for c in lists})
    # concepts are read by their labels, the others come as they are written
    by_label = F.transform(F.array_sort(F.transform("concepts", lambda r: F.struct(r["label"].alias("label"), r["iri"].alias("iri"), r["notation"].alias("notation")))), lambda r: F.struct(r["iri"].alias("iri"), r["label"].alias("label"), r["notation"].alias("notation")))
    assessed = (F.coalesce("level", F.lit(1)) >= 2) & F.col("provenance").isNotNull() & F.col("documentation").isNotNull()
    out = out.withColumns({
        "concepts": by_label, "field_count_bucket": norm.field_bucket(F.col("field_count")), "distribution_count": F.size("distributions"), "quality_assessed": assessed,
        "provenance": F.when(assessed, F.col("provenance")), "documentation": F.when(assessed, F.col("documentation")), "bulk_download": F.when(F.col("any_bulk"), True).otherwise(F.col("bulk")),
        "has_range_requests": F.coalesce("has_range_requests", F.lit(False)), "all_unreachable": F.coalesce("all_unreachable", F.lit(False)),
        "reference_only": F.coalesce("reference_only", F.lit(False)) | F.coalesce(F.col("tier") == 3, F.lit(False)), "review_state": F.coalesce("review_state", F.lit("draft")),
    })
    return out.withColumnRenamed("expanded", "concept_iris_expanded").drop("any_bulk", "bulk")
