"""Validation of records as graphs: rules over the nodes that a record consists of, and over registry entries.

A node is a row (record, node, type, props): props maps a property to its values, all as strings, as a graph has them. Most rules look at
one node only and are compiled into one pass over the table; rules that follow a reference to another node or to a scheme are joins
of the references only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import filters

COLUMNS = ("record", "node", "target", "level", "constraint", "path", "message", "severity", "value")


def values(path: str) -> Column:
    """The values of a property of a node; none where it isn't stated."""
    return F.coalesce(F.col("props")[path], F.array().cast("array<string>"))


def first(path: str) -> Column:
    """The first value of a property, else null."""
    return F.get(values(path), 0)


def stated(path: str) -> Column:
    return F.size(values(path)) > 0


def states(path: str, *wanted: str) -> Column:
    """Whether a property has one of these values."""
    return F.arrays_overlap(values(path), F.array(*map(F.lit, wanted)))


@dataclass(frozen=True)
class NodeRule:
    """bad: the offending values of a node (null stands for the node itself), each of which is a violation; built when the rule is used."""

    target: str
    constraint: str
    path: str | None
    level: int
    message: str
    bad: Callable[[], Column]
    severity: str = "Violation"


@dataclass(frozen=True)
class ReferenceRule:
    """Values of paths that lead to one of the values in a table (value). every: each value of the one path has to; else one value
    of any path is enough, and a node without one is a violation. when: the nodes that the rule is for."""

    target: str
    constraint: str
    paths: dict[str, DataFrame]
    level: int
    message: str
    every: bool = True
    when: Callable[[], Column] | None = None
    severity: str = "Violation"


def _itself(failed: Column) -> Column:
    return F.when(failed, F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))


def must(target: str, level: int, message: str, ok: Callable[[], Column], constraint: str = "SPARQL", path: str | None = None) -> NodeRule:
    """A condition on the whole node; an unknown one counts as met."""
    return NodeRule(target, constraint, path, level, message, lambda: _itself(~F.coalesce(ok(), F.lit(True))))


def at_least_one(target: str, path: str, level: int, message: str, when: Callable[[], Column] | None = None) -> NodeRule:
    return NodeRule(target, "MinCount", path, level, message, lambda: _itself(~stated(path) & (F.coalesce(when(), F.lit(False)) if when else F.lit(True))))


def at_most_one(target: str, path: str, level: int, message: str) -> NodeRule:
    return NodeRule(target, "MaxCount", path, level, message, lambda: _itself(F.size(values(path)) > 1))


def one_of(target: str, path: str, allowed: tuple[str, ...], level: int, message: str, when: Callable[[], Column] | None = None) -> NodeRule:
    def bad():
        wrong = F.filter(values(path), lambda v: ~v.isin(*allowed))
        return F.when(F.coalesce(when(), F.lit(False)), wrong).otherwise(F.array().cast("array<string>")) if when else wrong

    return NodeRule(target, "In", path, level, message, bad)


def pattern(target: str, path: str, regex: str, level: int, message: str) -> NodeRule:
    return NodeRule(target, "Pattern", path, level, message, lambda: F.filter(values(path), lambda v: ~v.rlike(regex)))


def number(target: str, path: str, level: int, message: str, low: float | None = None, high: float | None = None, above: float | None = None) -> list[NodeRule]:
    """Values have to be numbers, not below low, not beyond high, greater than above."""
    n = lambda v: v.try_cast("double")
    rules = [NodeRule(target, "Datatype", path, level, message, lambda: F.filter(values(path), lambda v: n(v).isNull()))]
    for name, bound, wrong in (("MinInclusive", low, lambda v: n(v) < low), ("MaxInclusive", high, lambda v: n(v) > high), ("MinExclusive", above, lambda v: n(v) <= above)):
        if bound is not None:
            rules.append(NodeRule(target, name, path, level, message, lambda wrong=wrong: F.filter(values(path), lambda v: F.coalesce(wrong(v), F.lit(False)))))
    return rules


def _faults(r: NodeRule) -> Column:
    fixed = [F.lit(r.level).alias("level"), F.lit(r.constraint).alias("constraint"), F.lit(r.path).cast("string").alias("path"), F.lit(r.message).alias("message"), F.lit(r.severity).alias("severity")]
    return F.transform(r.bad(), lambda v: F.struct(*fixed, v.alias("value")))


def _local(nodes: DataFrame, rules: list[NodeRule]) -> DataFrame:
    """Violations of the rules about single nodes: one pass, no shuffle. The rules of a type are worked out for its nodes only."""
    found = F.array().cast("array<struct<level:int,constraint:string,path:string,message:string,severity:string,value:string>>")
    for target in sorted({r.target for r in rules}):
        own = [_faults(r) for r in rules if r.target == target]
        found = F.when(F.col("type") == target, F.concat(*own)).otherwise(found)
    return nodes.select("record", "node", F.col("type").alias("target"), F.inline(found)).select(*COLUMNS)


def _by_reference(nodes: DataFrame, r: ReferenceRule) -> DataFrame:
    """Violations of one rule that follows references. Only (node, value) pairs are joined; a value that many nodes refer to is a
    large key on one side only, which skew handling splits."""
    mine = nodes.where(F.col("type") == r.target)
    if r.when:
        mine = mine.where(F.coalesce(r.when(), F.lit(False)))
    if r.every:
        ((path, known),) = r.paths.items()
        out = mine.select("record", "node", F.explode(values(path)).alias("value")).join(known.select("value").distinct(), "value", "left_anti").withColumn("path", F.lit(path))
    else:
        good = None
        for path, known in r.paths.items():
            some = mine.select("node", F.explode(values(path)).alias("value")).join(known.select("value").distinct(), "value", "left_semi").select("node")
            good = some if good is None else good.unionByName(some)
        out = mine.select("record", "node").join(good.distinct(), "node", "left_anti").withColumns({"path": F.lit(None).cast("string"), "value": F.lit(None).cast("string")})
    fixed = {"target": r.target, "level": r.level, "constraint": r.constraint, "message": r.message, "severity": r.severity}
    return out.withColumns({k: F.lit(v) for k, v in fixed.items()}).select(*COLUMNS)


def violations(nodes: DataFrame, rules: list[NodeRule | ReferenceRule], level: int = 3) -> DataFrame:
    """record, node, target, level, constraint, path, message, severity, value of every rule up to a level that a node breaks.

    nodes: record, node, type, props (map<string, array<string>>); other columns are ignored. A null map or value list states
    nothing; repeated rows are judged one by one; nodes of types without rules pass; an empty table gives none."""
    some = [r for r in rules if r.level <= level]
    out = _local(nodes, [r for r in some if isinstance(r, NodeRule)])
    for r in some:
        if isinstance(r, ReferenceRule):
            out = out.unionByName(_by_reference(nodes, r))
    return out


def report(found: DataFrame) -> DataFrame:
    """violations() with `place`: their order by record, node, path (none first) and message. Sorted over ranges, so no record is a task."""
    key = F.struct("record", "node", F.coalesce("path", F.lit("")), "message", F.coalesce("value", F.lit("")))
    return filters.placed(found.withColumn("__key", key), ("__key", False), tie="constraint").drop("__key")


def conformance(nodes: DataFrame, found: DataFrame, top: int = 3) -> DataFrame:
    """record, violations, warnings, conforms, passing of every record that has a node: warnings don't block; passing is the highest
    level whose rules, and those of all below, hold. found: violations() up to level top."""
    blocks = F.col("severity") == "Violation"
    per = found.groupBy("record").agg(F.count_if(blocks).alias("violations"), F.count_if(~blocks).alias("warnings"), F.min(F.when(blocks, F.col("level"))).alias("least"))
    out = nodes.select("record").distinct().join(per, "record", "left").fillna(0, ["violations", "warnings"])
    return out.select("record", "violations", "warnings", (F.col("violations") == 0).alias("conforms"), (F.coalesce("least", F.lit(top + 1)) - 1).alias("passing"))


#: Closed lists of the catalogue's properties.
CADENCE = r"^(P(\d+Y)?(\d+M)?(\d+W)?(\d+D)?(T(\d+H)?(\d+M)?(\d+S)?)?|irregular|on-demand|discontinued)$"
REVIEW = ("draft", "in-review", "confirmed", "auto-confirmed", "flagged")
GRANULARITY = ("nodal", "zonal", "gridded", "administrative", "point", "national", "global")
DOCUMENTED = ("fully-documented", "partial", "external-standard-only", "none")
VISIBILITY = ("public", "restricted-metadata", "allowlisted-existence")
PROTOCOLS = ("opendap", "thredds", "wcs", "wfs", "ogc-api-coverages", "stac-api")
HEALTH = ("verified", "degraded", "unreachable", "redirected")
HOSTING = ("format", "fragile-source", "charges-user", "etl-output", "registered")
BASES = ("measured", "estimated", "modeled", "synthetic")
ENRICHED = ("inferred", "source-confirmed", "steward-authored")
STUDIES = ("filing", "intervention", "academic", "reanalysis")
UNIT_IRI = r"^(http://qudt\.org/vocab/unit/|https://schema\.[a-z]+\.org/unit/)"


def record_rules() -> list[NodeRule]:
    """Rules of records (Dataset), their access paths (Distribution, LinkHealth), fields (Field), grades (QualityGrade) and gaps."""
    d = "Dataset"
    primary = lambda: states("geospatial_primary", "true")
    hosted = lambda: states("hosted", "true")
    rules = [
        *[at_least_one(d, p, 1, f"every record states {p}") for p in ("title", "description", "domain", "access_restriction", "anonymous_access", "documentation_status", "completeness_level", "review_state", "harvest_source")],
        *[at_most_one(d, p, 1, f"{p} is stated once") for p in ("title", "summary", "license", "access_restriction", "documentation_status", "completeness_level", "review_state", "visibility", "provenance_class", "cadence")],
        at_least_one(d, "license", 1, "every published record states a licence"),
        pattern(d, "license", "^https?://", 1, "a licence is an absolute IRI"),
        one_of(d, "review_state", REVIEW, 1, "review_state is one of " + ", ".join(REVIEW)),
        one_of(d, "spatial_granularity", GRANULARITY, 1, "spatial_granularity is one of " + ", ".join(GRANULARITY)),
        one_of(d, "documentation_status", DOCUMENTED, 1, "documentation_status is one of " + ", ".join(DOCUMENTED)),
        one_of(d, "visibility", VISIBILITY, 1, "visibility is one of " + ", ".join(VISIBILITY)),
        pattern(d, "cadence", CADENCE, 1, "cadence is an ISO 8601 duration, or irregular, on-demand or discontinued"),
        *number(d, "completeness_level", 1, "there are the levels 1, 2 and 3", 1, 3),
        *number(d, "tier", 1, "there are the tiers 1, 2 and 3", 1, 3),
        *number(d, "west", 1, "a longitude lies between -180 and 180", -180, 180), *number(d, "east", 1, "a longitude lies between -180 and 180", -180, 180),
        *number(d, "south", 1, "a latitude lies between -90 and 90", -90, 90), *number(d, "north", 1, "a latitude lies between -90 and 90", -90, 90),
        *number(d, "resolution_m", 1, "a resolution is positive", above=0),
        at_least_one(d, "field", 3, "a level 3 record has fields"),
        must(d, 1, "a record without a distribution is reference-only", lambda: stated("distribution") | states("reference_only", "true")),
        must(d, 1, "a reference-only record without a distribution says why", lambda: ~states("reference_only", "true") | stated("distribution") | stated("pointer_rationale")),
        must(d, 2, "a record does not supersede itself", lambda: ~(F.array_contains(values("supersedes"), F.col("node")) | F.array_contains(values("superseded_by"), F.col("node")))),
        *[at_least_one(d, p, 1, f"a geospatial-primary record states {p}", primary) for p in ("west", "south", "east", "north", "native_crs", "geometry_types")],
    ]
    x = "Distribution"
    rules += [
        at_least_one(x, "access_url", 1, "a distribution without an address is not an access path"), at_most_one(x, "access_url", 1, "access_url is stated once"),
        *number(x, "byte_size", 1, "a size is a non-negative number", 0),
        one_of(x, "protocol", PROTOCOLS, 1, "protocol is one of " + ", ".join(PROTOCOLS)),
        at_least_one(x, "chunk_index", 1, "range requests need a chunk index", lambda: states("range_requests", "true")),
        at_least_one(x, "refresh_owner", 1, "a hosted copy has a refresh owner", hosted), at_least_one(x, "hosting_reason", 1, "a hosted copy has a reason", hosted),
        one_of(x, "hosting_reason", HOSTING, 1, "hosting_reason is one of " + ", ".join(HOSTING), hosted),
        at_least_one("LinkHealth", "status", 1, "link health has a status"), one_of("LinkHealth", "status", HEALTH, 1, "status is one of " + ", ".join(HEALTH)),
        *number("LinkHealth", "failures", 1, "failures are counted from 0", 0),
    ]
    f = "Field"
    rules += [
        *[at_least_one(f, p, 2, f"a field states {p}") for p in ("local_name", "label", "definition", "data_type", "value_basis")],
        *[at_most_one(f, p, 2, f"{p} is stated once") for p in ("local_name", "data_type", "value_basis", "required")],
        one_of(f, "value_basis", BASES, 2, "value_basis is one of " + ", ".join(BASES)),
        pattern(f, "unit", UNIT_IRI, 3, "a unit is an IRI of a unit registry, never a string"), at_most_one(f, "unit", 3, "unit is stated once"),
        must(f, 2, "an estimated or modelled field records its origin", lambda: ~states("value_basis", "estimated", "modeled") | stated("field_source") | stated("derived_from_field")),
        at_least_one(f, "inference_basis", 3, "an inferred concept states its basis", lambda: states("inferred_assignment", "true")),
    ]
    g = "QualityGrade"
    rules += [
        at_least_one(g, "facet", 2, "a grade has a facet"), one_of(g, "facet", ("provenance", "documentation", "currency"), 2, "there are three facets and no composite"),
        at_least_one(g, "grade", 2, "a grade has a letter"), one_of(g, "grade", ("A", "B", "C", "D"), 2, "a grade is A, B, C or D"), at_least_one(g, "rationale", 2, "a grade has a reason"),
        must(g, 2, "currency does not use grade C", lambda: ~(states("facet", "currency") & states("grade", "C"))),
        at_least_one("ConceptGap", "reason", 3, "a gap says why"), at_least_one("ProvenanceGap", "reason", 1, "a gap says why"),
    ]
    for target in (d, x, f):
        rules += [
            one_of(target, "enrichment_basis", ENRICHED, 1, "enrichment_basis is one of " + ", ".join(ENRICHED)),
            must(target, 1, "an inferred value names its model and prompt version", lambda: ~states("enrichment_basis", "inferred") | (stated("enrichment_model") & stated("enrichment_prompt_version"))),
        ]
    return rules


def reference_rules(nodes: DataFrame, schemes: DataFrame) -> list[ReferenceRule]:
    """Rules that lead out of a node: concepts of the right scheme, a class or a gap with a reason, evidence of an authority.

    schemes: scheme, concept. Gaps and question classes are nodes themselves."""
    of = lambda scheme: schemes.where(F.col("scheme") == scheme).select(F.col("concept").alias("value"))
    having = lambda kind, path: nodes.where((F.col("type") == kind) & stated(path)).select(F.col("node").alias("value"))
    each = [("Dataset", "domain", "data-domain", 1), ("Dataset", "provenance_class", "provenance-class", 1), ("Dataset", "access_restriction", "access-restriction", 1), ("Distribution", "access_restriction", "access-restriction", 1), *[("Dataset", p, "analysis-type", 2) for p in ("supported_analysis", "excluded_analysis", "output_of_analysis")]]
    rules = [ReferenceRule(t, "Node", {p: of(s)}, level, f"{p} is a concept of the scheme {s}") for t, p, s, level in each]
    rules.append(ReferenceRule("Dataset", "Or", {"provenance_class": of("provenance-class"), "provenance_gap": having("ProvenanceGap", "reason")}, 1, "a record has a provenance class or a gap with a reason", every=False))
    rules.append(ReferenceRule("Field", "Or", {"concept": of("grid-concept"), "concept_gap": having("ConceptGap", "reason")}, 3, "a field has a concept or a gap with a reason", every=False))
    return rules


def registry_rules() -> list[NodeRule]:
    """Rules of registry entries: studies, assumption sets and their values, reference models, question classes, runs."""
    s, a, v, m, q, r = "Study", "AssumptionSet", "Assumption", "ReferenceModel", "QuestionClass", "RunRecord"
    sha1, sha256 = "^[0-9a-f]{40}$", "^[0-9a-f]{64}$"
    once = {s: ("title", "kind", "publisher"), a: ("title", "schema_pin"), v: ("path", "value", "value_basis"), m: ("fidelity",), q: ("question", "robustness"), r: ("assumption_set", "reference_model", "executed_by", "case_hash", "tool", "tool_version", "executed_at")}
    some = {s: ("analysis_type", "assumption_set"), a: ("assumption",), v: ("field_source",)}
    rarely = {s: ("frozen_at", "citation", "parent_study", "docket"), a: ("receipt_errors", "forked_from"), m: ("schema_pin", "elements"), q: ("basis",), r: ("objective", "objective_unit", "wall_seconds")}
    rules = [at_least_one(t, p, 1, f"{t} states {p}") for table in (once, some) for t, ps in table.items() for p in ps]
    rules += [at_most_one(t, p, 1, f"{p} is stated once") for table in (once, rarely) for t, ps in table.items() for p in ps]
    return [
        *rules,
        one_of(s, "kind", STUDIES, 1, "kind is one of " + ", ".join(STUDIES)), one_of(v, "value_basis", BASES, 1, "value_basis is one of " + ", ".join(BASES)),
        one_of(m, "fidelity", ("indicative", "screening", "authoritative"), 1, "fidelity is indicative, screening or authoritative"), one_of(q, "robustness", ("robust", "fragile", "unknown"), 1, "robustness is robust, fragile or unknown"),
        must(s, 1, "a frozen study has a citation", lambda: ~stated("frozen_at") | stated("citation")),
        must(s, 1, "an intervention names its parent study", lambda: ~states("kind", "intervention") | stated("parent_study")),
        must(s, 1, "a study is not its own parent", lambda: ~F.array_contains(values("parent_study"), F.col("node"))),
        pattern(a, "schema_pin", sha1, 1, "a schema pin is a commit's SHA of 40 digits"), pattern(m, "schema_pin", sha1, 1, "a schema pin is a commit's SHA of 40 digits"),
        *number(a, "receipt_errors", 1, "a registered set validated clean", 0, 0), *number(a, "receipt_warnings", 1, "warnings are counted from 0", 0),
        must(a, 1, "a set is not forked from itself", lambda: ~F.array_contains(values("forked_from"), F.col("node"))),
        *number(m, "elements", 1, "elements are counted from 0", 0),
        must(q, 1, "a robust class names its basis", lambda: ~states("robustness", "robust") | stated("basis")),
        pattern(r, "case_hash", sha256, 1, "a case hash is a SHA-256 of 64 digits"), *number(r, "wall_seconds", 1, "a time is not negative", 0),
        must(r, 1, "an objective has its unit", lambda: ~stated("objective") | stated("objective_unit")),
    ]


def authority_rule(nodes: DataFrame) -> ReferenceRule:
    """An authoritative reference model rests on a question class with a basis."""
    based = nodes.where((F.col("type") == "QuestionClass") & stated("basis")).select(F.col("node").alias("value"))
    return ReferenceRule("ReferenceModel", "SPARQL", {"question_class": based}, 1, "an authoritative model has a question class with a basis", every=False, when=lambda: states("fidelity", "authoritative"))


def from_graph(rows: DataFrame, record: str, graph: str = "graph") -> DataFrame:
    """Nodes from rows whose column graph holds a JSON array of objects with `id`, `type` and scalar or list properties.

    A property's list keeps its order; a scalar is a list of one; nulls state nothing. Objects that a property holds are kept as their JSON."""
    objects = F.from_json(F.col(graph), "array<map<string,string>>")
    one = rows.select(F.col(record).alias("record"), F.explode(objects).alias("o"))
    as_list = lambda v: F.coalesce(F.from_json(F.when(F.startswith(v, F.lit("[")), v), "array<string>"), F.array(v))
    props = F.transform_values(F.map_filter("o", lambda k, v: ~k.isin("id", "type") & v.isNotNull()), lambda k, v: as_list(v))
    return one.select("record", F.col("o")["id"].alias("node"), F.col("o")["type"].alias("type"), props.alias("props"))
