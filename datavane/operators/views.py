"""Joined views of a catalogue: search documents, worklists, labels and network branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import filters


def search_documents(datasets: DataFrame, members: dict[str, DataFrame], coverage: DataFrame, distributions: DataFrame) -> DataFrame:
    """One row a dataset (id and its own columns) with the number of members of each named table (id), t_start and t_end of coverage
    (id), and of its distributions (dataset_id, media_type) the number and the sorted formats.

    Each side is aggregated by id before it is joined, so no join multiplies rows."""
    out = datasets
    for name, rows in members.items():
        out = out.join(rows.groupBy("id").agg(F.count("*").alias(name)), "id", "left")
    f = distributions.groupBy(F.col("dataset_id").alias("id")).agg(F.count("*").alias("distributions"), F.array_sort(F.collect_set("media_type")).alias("formats"))
    return out.join(coverage.select("id", "t_start", "t_end"), "id", "left").join(f, "id", "left").fillna(0, [*members, "distributions"])


def analysis_fitness(fit: DataFrame, closure: DataFrame, excluded: DataFrame) -> DataFrame:
    """id, analysis: what a dataset is fit for (id, analysis), and what that is a narrower case of (closure: node, ancestor), less
    the analyses that it is excluded from (id, analysis)."""
    wider = fit.join(closure, F.col("analysis") == F.col("node")).select("id", F.col("ancestor").alias("analysis"))
    return fit.select("id", "analysis").unionByName(wider).distinct().join(excluded.select("id", "analysis"), ["id", "analysis"], "left_anti")


def currency_worklist(datasets: DataFrame, coverage: DataFrame, states: tuple[str, ...] = ("confirmed",)) -> DataFrame:
    """id, cadence, modified, superseded_by, t_end of the records whose currency is to be graded."""
    return datasets.where(F.col("review_state").isin(*states)).join(coverage, "id", "left").select("id", "cadence", "modified", "superseded_by", "t_end")


def labelled(rows: DataFrame, key: str, labels: DataFrame, label_key: str, label: str, default: str | None = None) -> DataFrame:
    """rows with `label` by key; rows without one have the default, or go if there is none."""
    named = labels.select(F.col(label_key).alias(key), label)
    out = rows.join(named, key, "inner" if default is None else "left")
    return out if default is None else out.withColumn(label, F.coalesce(label, F.lit(default)))


def branches(arcs: DataFrame, buses: DataFrame) -> DataFrame:
    """arcs with voltage_bus0, voltage_bus1 and the higher as voltage; arcs without both ends go."""
    out = arcs
    for end in ("bus0", "bus1"):
        out = out.join(buses.select(F.col("bus_id").alias(end), F.col("voltage").alias(f"voltage_{end}")), end)
    return out.withColumn("voltage", F.greatest("voltage_bus0", "voltage_bus1"))


def by_row_order(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """left's and right's columns side by side by their place in key order, with `slipped`: are the tables of different length?
    A row without a partner has nulls; nothing is dropped."""
    a, b = filters.placed(left, (left_key, False), tie=left_key), filters.placed(right, (right_key, False), tie=right_key)
    lengths = a.agg(F.count("*").alias("n")).unionByName(b.agg(F.count("*").alias("n"))).agg((F.min("n") != F.max("n")).alias("x"))
    return a.join(b, "place", "full_outer").withColumn("slipped", lengths.scalar())


def present(rows: DataFrame, key: str, known: DataFrame, known_key: str, name: str) -> DataFrame:
    """rows with a boolean: is the key among the known ones?"""
    k = known.select(F.col(known_key).alias(key)).distinct().withColumn(name, F.lit(True))
    return rows.join(k, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def unlocated(buses: DataFrame, arcs: DataFrame) -> DataFrame:
    """bus_id of buses that no arc ends at."""
    ends = arcs.select(F.explode(F.array("bus0", "bus1")).alias("bus_id")).distinct()
    return buses.select("bus_id").join(ends, "bus_id", "left_anti")


def recomputed(values: DataFrame, stated: DataFrame, key: str, value: str, tolerance: float = 1e-6) -> DataFrame:
    """key, why: stated values that are missing, have no source, or differ from the recomputed ones."""
    d = values.select(key, F.col(value).alias("__v")).join(stated.select(key, F.col(value).alias("__s")), key, "full_outer")
    why = F.when(F.col("__s").isNull(), "missing").when(F.col("__v").isNull(), "no-source").when(F.abs(F.col("__s") - F.col("__v")) > tolerance, "differs")
    return d.select(key, why.alias("why")).where("why is not null")


def slipped_join(rows: DataFrame, columns: list[str], share: float = 0.8) -> DataFrame:
    """slipped, units: is the share of distinct value tuples so high that a join by place must have slipped?"""
    return rows.agg((F.count_distinct(F.struct(*columns)) / F.count("*") > share).alias("slipped"), F.count("*").alias("units"))


def refused(datasets: DataFrame, needed: Column) -> DataFrame:
    """id, refused: records whose publication is refused for want of what is needed."""
    return datasets.select("id", (~F.coalesce(needed, F.lit(False))).alias("refused"))


def surrogate_ids(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """rows with `id`, numbered from 1 in each group; the whole order has to be unique for a stable result.

    Rows are placed over ranges of group and order, so a group with a third of all rows is many ranges; a row's number is its place after
    the group's first. Only the first places are joined, a row for each group, so skew handling can split a large one. Rows of a
    null group are numbered too; a column named id is replaced."""
    ranked = filters.placed(rows.drop("id").withColumn("__key", F.struct(by, *order)), ("__key", False), tie=by)
    starts = ranked.groupBy(F.col(by).alias("__by")).agg(F.min("place").alias("__first"))
    return ranked.join(starts, F.col(by).eqNullSafe(F.col("__by"))).withColumn("id", F.col("place") - F.col("__first") + 1).drop("__key", "__by", "__first", "place")


def per_unit(rows: DataFrame, columns: dict[str, float], digits: int = 6) -> DataFrame:
    """rows with <column>_pu for each column: its value over its base (power in MVA, voltage in kV, impedance in ohm)."""
    return rows.withColumns({f"{c}_pu": F.round(F.col(c) / float(base), digits) for c, base in columns.items()})


def head_of_group(rows: DataFrame, by: str, n: int, *order: str) -> DataFrame:
    """The first n rows of each group, with `n`, their number."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("n") <= n)


#: Which label of a term is shown, best first.
LABEL_RANK = ("symbol", "prefLabel", "label")


def term_labels(terms: DataFrame) -> DataFrame:
    """iri, label, definition of every term from terms (iri, kind, label, definition): the label of the best kind, the smallest of equal
    ones, whatever the order of the rows; the smallest definition that any row has."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LABEL_RANK)), F.col("kind")).cast("int"), F.lit(0)), F.lit(len(LABEL_RANK) + 1))
    return terms.groupBy("iri").agg(F.min(F.struct(rank.alias("rank"), "label"))["label"].alias("label"), F.min("definition").alias("definition"))


def schema_pages(parts: DataFrame, terms: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, id, place, part, concept, concept_label, concept_definition, unit, unit_label, total, next_offset for requests
    (request_id, id, offset, limit): the parts (id, part, label, concept, unit) of a record in order of label and part, from the offset on. total
    counts all its parts; next_offset is null on the last page. Only records that are asked for are numbered, and only terms
    that the pages name are looked up."""
    asked = parts.join(requests.select("id").distinct(), "id", "left_semi")
    every = Window.partitionBy("id")
    rows = asked.withColumns({"place": F.row_number().over(every.orderBy("label", "part")), "total": F.count("*").over(every)})
    end = F.col("offset") + F.col("limit")
    rows = rows.join(requests, "id").where((F.col("place") > F.col("offset")) & (F.col("place") <= end)).withColumn("next_offset", F.when(F.col("total") > end, end))
    named = rows.select(F.explode(F.array_compact(F.array("concept", "unit"))).alias("iri")).distinct()
    shown = term_labels(terms.join(named, "iri", "left_semi"))
    for c in ("concept", "unit"):
        rows = rows.join(shown.select(F.col("iri").alias(c), F.col("label").alias(f"{c}_label"), F.col("definition").alias(f"{c}_definition")), c, "left")
    return rows.select("request_id", "id", "place", "part", "concept", "concept_label", "concept_definition", "unit", "unit_label", "total", "next_offset")


def backstop(rows: DataFrame, own: str, source: DataFrame, key: str, declared: str) -> DataFrame:
    """rows with data_domain, their own or that which their source declares, and whether it is inferred."""
    d = rows.join(source.select(key, F.col(declared).alias("__d")).distinct(), key, "left")
    return d.withColumns({"data_domain": F.coalesce(own, "__d"), "inferred": F.col(own).isNull()}).drop("__d")


def retained(rows: DataFrame, at: str, since) -> DataFrame:
    return rows.where(F.col(at) >= F.lit(since))


def overdue(rows: DataFrame, at: str, before) -> DataFrame:
    return rows.where(F.col(at) < F.lit(before))


def plans(rows: DataFrame, at: str, seconds: int, now) -> DataFrame:
    """rows with expires_at and active: an issued plan is good for so many seconds."""
    end = F.col(at) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    return rows.withColumns({"expires_at": end, "active": end > F.lit(now)})


def intake(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in order."""
    return rows.orderBy(*order).limit(n)
