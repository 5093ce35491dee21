"""Records with one fault each: what is found, at which node, and at which level."""

import json

import pytest
from datavane.operators import nodes

DATASET = {
    "id": "d", "type": "Dataset", "title": "t", "description": "x", "domain": ["power"], "provenance_class": "curated", "license": "https://example.org/l", "access_restriction": "none", "anonymous_access": True, "documentation_status": "partial",
    "completeness_level": 1, "review_state": "confirmed", "harvest_source": "curated", "distribution": ["x"], "field": ["f"],
}
PATH, HEALTH = {"id": "x", "type": "Distribution", "access_url": "https://example.org/a", "byte_size": 7}, {"id": "h", "type": "LinkHealth", "status": "verified"}
FIELD = {"id": "f", "type": "Field", "local_name": "a", "label": "A", "definition": "what a is", "data_type": "double", "value_basis": "measured", "concept": "K1", "unit": "http://qudt.org/vocab/unit/MegaW"}
GRADE, GAP = {"id": "q", "type": "QualityGrade", "facet": "currency", "grade": "A", "rationale": "new"}, {"id": "g", "type": "ConceptGap", "reason": "none fits"}
GEO = {"geospatial_primary": True, "geometry_types": ["raster"], "west": -1, "south": -1, "east": 1, "north": 1, "native_crs": "EPSG:4326"}

CASES = {
    "none": ({}, set()),
    "cadence": ({"d": {"cadence": "now and then"}}, {("d", "Pattern", "cadence", 1)}),
    "level four": ({"d": {"completeness_level": 4}}, {("d", "MaxInclusive", "completeness_level", 1)}),
    "no number": ({"d": {"completeness_level": "high"}}, {("d", "Datatype", "completeness_level", 1)}),
    "composite": ({"q": {"facet": "overall"}}, {("q", "In", "facet", 2)}),
    "bare gap": ({"f": {"concept": None, "concept_gap": "g"}, "g": {"reason": None}}, {("g", "MinCount", "reason", 3), ("f", "Or", None, 3)}),
    "told gap": ({"f": {"concept": None, "concept_gap": "g"}}, set()),
    "unknown concept": ({"f": {"concept": "K9"}}, {("f", "Or", None, 3)}),
    "no concept": ({"f": {"concept": None}}, {("f", "Or", None, 3)}),
    "currency C": ({"q": {"grade": "C"}}, {("q", "SPARQL", None, 2)}),
    "domain": ({"d": {"domain": ["power", "heat", "cold"]}}, {("d", "Node", "domain", 1)}),
    "address": ({"x": {"access_url": None}}, {("x", "MinCount", "access_url", 1)}),
    "two addresses": ({"x": {"access_url": ["a", "b"]}}, {("x", "MaxCount", "access_url", 1)}),
    "inferred": ({"d": {"enrichment_basis": "inferred", "enrichment_model": "m"}}, {("d", "SPARQL", None, 1)}),
    "geospatial": ({"d": GEO}, set()),
    "no reference system": ({"d": {**GEO, "native_crs": None}}, {("d", "MinCount", "native_crs", 1)}),
    "no reason": ({"q": {"rationale": None}}, {("q", "MinCount", "rationale", 2)}),
    "unowned": ({"x": {"hosted": True, "hosting_reason": "registered"}}, {("x", "MinCount", "refresh_owner", 1)}),
    "inferred concept": ({"f": {"inferred_assignment": True}}, {("f", "MinCount", "inference_basis", 3)}),
    "licence text": ({"d": {"license": "CC BY 4.0"}}, {("d", "Pattern", "license", 1)}),
    "no licence": ({"d": {"license": None}}, {("d", "MinCount", "license", 1)}),
    "no origin": ({"f": {"value_basis": "modeled"}}, {("f", "SPARQL", None, 2)}),
    "origin": ({"f": {"value_basis": "modeled", "derived_from_field": "z"}}, set()),
    "size": ({"x": {"byte_size": -1}}, {("x", "MinInclusive", "byte_size", 1)}),
    "provenance": ({"d": {"provenance_class": "rumour"}}, {("d", "Node", "provenance_class", 1), ("d", "Or", None, 1)}),
    "no index": ({"x": {"range_requests": True}}, {("x", "MinCount", "chunk_index", 1)}),
    "no path": ({"d": {"distribution": None}}, {("d", "SPARQL", None, 1)}),
    "pointer": ({"d": {"distribution": [], "reference_only": True}}, {("d", "SPARQL", None, 1)}),
    "told pointer": ({"d": {"distribution": None, "reference_only": True, "pointer_rationale": "closed"}}, set()),
    "itself": ({"d": {"supersedes": ["a", "d"]}}, {("d", "SPARQL", None, 2)}),
    "unit": ({"f": {"unit": "MW"}}, {("f", "Pattern", "unit", 3)}),
    "basis": ({"x": {"enrichment_basis": "felt"}}, {("x", "In", "enrichment_basis", 1)}),
    "health": ({"h": {"status": "fine"}}, {("h", "In", "status", 1)}),
    "review": ({"d": {"review_state": "done"}}, {("d", "In", "review_state", 1)}),
    "granularity": ({"d": {"spatial_granularity": "hourly"}}, {("d", "In", "spatial_granularity", 1)}),
    "protocol": ({"x": {"protocol": "ftp"}}, {("x", "In", "protocol", 1)}),
}


@pytest.fixture(scope="module")
def judged(spark):
    rows = []
    for name, (changes, _) in CASES.items():
        graph = [{**n, **changes.get(n["id"], {})} for n in (DATASET, PATH, HEALTH, FIELD, GRADE, GAP)]
        for n in graph:  # ids and references are told apart by case
            n["id"] = f"{name}/{n['id']}"
            for p in ("concept_gap", "supersedes"):
                if n.get(p):
                    n[p] = [f"{name}/{v}" for v in n[p]] if isinstance(n[p], list) else f"{name}/{n[p]}"
        rows.append((name, json.dumps(graph)))
    rows += [("empty", "[]"), ("null", None)]
    every = nodes.from_graph(spark.createDataFrame(rows, "name string, graph string"), "name").cache()
    schemes = spark.createDataFrame([("data-domain", "power"), ("provenance-class", "curated"), ("access-restriction", "none"), ("grid-concept", "K1")], "scheme string, concept string")
    rules = [*nodes.record_rules(), *nodes.reference_rules(every, schemes)]
    return every, rules, nodes.violations(every, rules).cache()


def test_each_fault_is_found_where_it_is(judged):
    got = {name: set() for name in CASES}
    for r in judged[2].collect():
        assert r.message and r.severity == "Violation"
        got[r.record].add((r.node.split("/")[1], r.constraint, r.path, r.level))
    assert got == {name: want for name, (_, want) in CASES.items()}


def test_offending_values_are_named_one_by_one(judged):
    assert {r.value for r in judged[2].where("record = 'domain'").collect()} == {"heat", "cold"}
    assert judged[2].where("record = 'size'").first().value == "-1"


def test_levels_and_conformance(judged):
    every, rules, found = judged
    assert {r.level for r in nodes.violations(every, rules, 2).collect()} == {1, 2}
    got = {r.record: (r.violations, r.conforms, r.passing) for r in nodes.conformance(every, found).collect()}
    want = {}
    for name, (_, faults) in CASES.items():
        n = len(faults) + (name == "domain")
        want[name] = (n, n == 0, min((f[3] for f in faults), default=4) - 1)
    assert got == want


def test_report_is_in_order(judged):
    got = [(r.record, r.node, r.path or "", r.message) for r in nodes.report(judged[2]).orderBy("place").collect()]
    assert got == sorted(got) and [r.place for r in nodes.report(judged[2]).orderBy("place").collect()] == list(range(1, len(got) + 1))


def test_warnings_do_not_block_and_odd_rows_pass(spark):
    rule = nodes.NodeRule("Dataset", "Pattern", "title", 1, "short", lambda: nodes.values("title"), "Warning")
    rows = [(1, "a", "Dataset", {"title": ["x"]}, 0), (2, "b", "Dataset", None, 0), (3, "c", "Other", {"title": ["x"]}, 0), (4, "d", None, {"title": None}, 0)]
    every = spark.createDataFrame(rows, "record long, node string, type string, props map<string,array<string>>, level int").drop("level")
    found = nodes.violations(every, [rule])
    assert [(r.record, r.value) for r in found.collect()] == [(1, "x")]
    assert {(r.record, r.violations, r.warnings, r.conforms, r.passing) for r in nodes.conformance(every, found).collect()} == {(1, 0, 1, True, 3), (2, 0, 0, True, 3), (3, 0, 0, True, 3), (4, 0, 0, True, 3)}
    assert nodes.violations(every.limit(0), [rule, *nodes.record_rules()]).count() == 0


def test_registry_rules_follow_references(spark):
    rows = [("a", "m1", "ReferenceModel", {"fidelity": ["authoritative"], "question_class": ["q1"]}), ("a", "m2", "ReferenceModel", {"fidelity": ["authoritative"], "question_class": ["q2"]}), ("a", "m3", "ReferenceModel", {"fidelity": ["authoritative"]}), ("a", "m4", "ReferenceModel", {"fidelity": ["indicative"]}),
            ("a", "q1", "QuestionClass", {"question": ["?"], "robustness": ["robust"], "basis": ["b"]}), ("a", "q2", "QuestionClass", {"question": ["?"], "robustness": ["robust"]})]
    every = spark.createDataFrame(rows, "record string, node string, type string, props map<string,array<string>>")
    got = nodes.violations(every, [*nodes.registry_rules(), nodes.authority_rule(every)]).collect()
    assert sorted((r.node, r.constraint) for r in got) == [("m2", "SPARQL"), ("m3", "SPARQL"), ("q2", "SPARQL")]
