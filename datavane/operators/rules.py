"""Validation: a rule table compiled into one pass over the records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """ok: a boolean column; null counts as passed, as what isn't captured is no violation unless a rule asks for it."""

    name: str
    path: str
    level: int
    ok: Column
    severity: str = "violation"


def min_count(path: str, n: int, level: int = 1) -> Rule:
    return Rule(f"min-count-{n}", path, level, F.size(F.coalesce(F.col(path), F.array())) >= n)


def required(path: str, level: int = 1) -> Rule:
    return Rule("required", path, level, F.col(path).isNotNull())


def one_of(path: str, values: list[str], level: int = 1) -> Rule:
    return Rule("in", path, level, F.col(path).isNull() | F.col(path).isin(*values))


def pattern(path: str, regex: str, level: int = 1) -> Rule:
    return Rule("pattern", path, level, F.col(path).isNull() | F.col(path).rlike(regex))


def between(path: str, low, high, level: int = 1) -> Rule:
    return Rule("range", path, level, F.col(path).isNull() | F.col(path).between(low, high))


def either(a: str, b: str, level: int = 1) -> Rule:
    return Rule("either", f"{a}|{b}", level, F.col(a).isNotNull() | F.col(b).isNotNull())


def implies(name: str, path: str, if_: Column, then: Column, level: int = 1) -> Rule:
    return Rule(name, path, level, ~F.coalesce(if_, F.lit(False)) | F.coalesce(then, F.lit(False)))


def not_self(path: str, key: str, level: int = 1) -> Rule:
    return Rule("not-self", path, level, F.col(path).isNull() | (F.col(path) != F.col(key)))


def violations(records: DataFrame, rules: list[Rule], key: str = "id", level: int = 3) -> DataFrame:
    """id, level, rule, path, severity of every failed rule up to a level, in one pass without a shuffle."""
    failed = [F.when(~F.coalesce(r.ok, F.lit(True)), F.struct(F.lit(r.level).alias("level"), F.lit(r.name).alias("rule"), F.lit(r.path).alias("path"), F.lit(r.severity).alias("severity"))) for r in rules if r.level <= level]
    return records.select(F.col(key).alias("id"), F.inline(F.array_compact(F.array(*failed))))


def passing_level(records: DataFrame, rules: list[Rule], key: str = "id", top: int = 3) -> DataFrame:
    """id, passing: the highest level whose rules, and those of all below, pass."""
    worst = F.lit(top + 1)
    for r in rules:
        worst = F.least(worst, F.when(~F.coalesce(r.ok, F.lit(True)), r.level).otherwise(top + 1))
    return records.select(F.col(key).alias("id"), (worst - 1).alias("passing"))


def not_in_scheme(values: DataFrame, scheme: DataFrame, value: str = "value") -> DataFrame:
    """Values that are no concept of the scheme."""
    return values.join(scheme.select(F.col("concept").alias(value)), value, "left_anti")


def network_faults(buses: DataFrame, arcs: DataFrame) -> DataFrame:
    """rule, arc_id: ends that are no bus, and arcs from a bus to itself.

    One pass over arcs and one join: each end is a row of its own, and a self-loop is one without a bus, which no bus can match."""
    kind = arcs.schema["bus0"].dataType
    fault = lambda rule, bus: F.struct(F.lit(rule).alias("rule"), bus.cast(kind).alias("bus"))
    loop = F.when(F.col("bus0") == F.col("bus1"), fault("self-loop", F.lit(None)))
    ends = arcs.select("arc_id", F.inline(F.array_compact(F.array(fault("dangling-bus0", F.col("bus0")), fault("dangling-bus1", F.col("bus1")), loop))))
    return ends.join(buses.select(F.col("bus_id").alias("bus")), "bus", "left_anti").select("rule", "arc_id")


def promotion_gates(records: DataFrame, now, days: int = 30) -> DataFrame:
    """id, promoted, failed: conforms, licence resolved, probed well within `days`, no drafted gating field."""
    fresh = F.col("probed_ok") & (F.datediff(F.lit(now).cast("date"), F.col("probed_at").cast("date")) <= days)
    gates = (("conforms", F.col("conforms")), ("licence", F.col("license_resolved")), ("probe", fresh), ("drafted", ~F.col("drafted")))
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), n) for n, ok in gates]))
    return records.select("id", (F.size(failed) == 0).alias("promoted"), F.array_join(failed, ",").alias("failed"))
