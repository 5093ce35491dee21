"""Readers of documents: records as graphs, network systems, field descriptions."""

import csv
import json

from datavane.sources import documents


HEADER = 'a,"b, ""c""",, "d, e'


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=repr)


def test_records_as_graphs_and_as_nested_objects(spark, tmp_path):
    graph = {"@graph": [{"id": "d:1", "type": ["Dataset", "Thing"], "title": "One", "completenessLevel": 2, "distribution": ["x:1"]}, {"id": "x:1", "type": "Distribution", "accessURL": "http://a", "anonymousAccess": True}, {"id": "d:1#q", "type": "QualityGrade", "facet": "provenance", "grade": "A"}]}
    nested = {"id": "d:2", "type": "Dataset", "title": "Two", "distribution": [{"id": "x:2", "type": "Distribution", "hasField": [{"id": "f:1", "type": "Field", "localName": "t2m"}]}], "temporal": {"startDate": "2015"}}
    two = {"@graph": [{"id": "d:3", "type": "Dataset"}, {"id": "d:4", "type": "Dataset"}]}
    for name, text in (("a", json.dumps(graph)), ("b", json.dumps(nested)), ("c", json.dumps(two)), ("d", "{broken"), ("e", json.dumps({"type": "Dataset"})), ("f", ""), ("g", "[1]")):
        (tmp_path / f"{name}.jsonld").write_text(text)
    got = documents.record_tables(spark, f"{tmp_path}/*.jsonld")
    assert rows(got["datasets"], "id", "title", "completeness_level") == [("d:1", "One", "2"), ("d:2", "Two", None)]
    assert rows(got["distributions"], "dataset_iri", "id", "access_url", "anonymous_access") == [("d:1", "x:1", "http://a", "true"), ("d:2", "x:2", None, None)]
    assert rows(got["parts"], "dataset_iri", "id", "name") == [("d:2", "f:1", "t2m")]
    assert rows(got["grades"], "dataset_iri", "facet", "grade", "rationale") == [("d:1", "provenance", "A", None)]
    bad = {r.file.rsplit("/", 1)[1][0]: r.problem for r in got["bad"].collect()}
    assert bad == {"c": "many-datasets", "d": "unreadable", "e": "no-dataset", "f": "unreadable", "g": "unreadable"} or bad == {"c": "many-datasets", "d": "unreadable", "e": "no-dataset", "g": "unreadable"}


def system(shift=0.0):
    return {
        "components": {
            "ACBus": [{"id": 1, "name": "a", "base_voltage": 220.0}, {"id": 2, "name": "b", "base_voltage": 400.0}, {"id": 3}],
            "Arc": [{"id": 10, "from_id": 1, "to_id": 2}, {"id": 11, "from_id": 1, "to_id": 3}, {"id": 12, "from_id": 3, "to_id": 99}],
            "Line": [{"id": 20, "name": "l", "arc": 10, "rating": 2.0, "power_units": "COMPONENT_BASE", "base_power": 100.0}, {"id": 21, "arc": 10, "rating": 2.0, "power_units": "SYSTEM_BASE"}, {"id": 22, "arc": 11}, {"id": 23, "arc": 77}, {"id": 24, "arc": 12}],
            "TwoTerminalGenericHVDCLine": [{"id": 30, "arc": 10, "active_power_limits_from": {"max": 500.0}, "power_units": "NATURAL_UNITS"}],
            "ThermalStandard": [{"id": 40, "bus": 1, "active_power_limits": {"max": 7.0}, "rating": 9.0, "power_units": "NATURAL_UNITS", "fuel": "GAS", "status": "OFFLINE"}, {"id": 41, "bus": 3, "rating": 9.0, "power_units": "NATURAL_UNITS"}],
            "PowerLoad": [{"id": 50, "max_active_power": 3.0, "power_units": "NATURAL_UNITS"}],
        },
        "supplemental_attributes": [{"id": 1, "geo_json": {"type": "Point", "coordinates": [1.0 + shift, 2.0]}}, {"id": 2, "geo_json": {"type": "Point", "coordinates": [3.0, 4.0]}}, {"id": 3, "geo_json": {"type": "LineString", "coordinates": [[1, 2], [2, 2], [3, 4]]}}],
        "supplemental_attribute_associations": [{"attribute_type": "GeographicInfo", "attribute_id": 1, "component_id": 1}, {"attribute_type": "GeographicInfo", "attribute_id": 2, "component_id": 2}, {"attribute_type": "Other", "attribute_id": 1, "component_id": 3}, {"attribute_type": "GeographicInfo", "attribute_id": 3, "component_id": 20}],
    }


def test_elements_of_network_systems_do_not_meet(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(system()))
    (tmp_path / "two.json").write_text(json.dumps(system(5.0)))
    (tmp_path / "three.json").write_text(json.dumps({"components": {}}))
    got = documents.network_elements(documents.network_tables(spark, f"{tmp_path}/*.json"))
    one = {r.key: r for r in got.collect() if r.system.endswith("one.json")}
    assert got.count() == 2 * len(one) and set(one) == {"bus-1", "bus-2", "bus-3", "line-20", "line-21", "line-22", "line-24", "hvdc-30", "thermal-40", "thermal-41", "load-50"}
    assert (one["line-20"].route, one["line-20"].rating, one["line-20"].voltage, one["line-20"].from_name) == ([[1.0, 2.0], [2.0, 2.0], [3.0, 4.0]], 200.0, 400.0, "a")
    assert (one["line-21"].route, one["line-21"].rating) == ([[1.0, 2.0], [3.0, 4.0]], None)
    assert (one["line-22"].route, one["line-22"].voltage, one["line-22"].from_name) == (None, 220.0, None) and one["line-24"].voltage is None
    assert (one["hvdc-30"].voltage, one["hvdc-30"].rating, one["hvdc-30"].layer) == (None, 500.0, "lines")
    assert (one["thermal-40"].rating, one["thermal-40"].x, one["thermal-40"].status, one["thermal-41"].rating, one["thermal-41"].x) == (7.0, 1.0, "OFFLINE", 9.0, None)
    assert (one["load-50"].rating, one["load-50"].x, one["bus-3"].x, one["bus-3"].name) == (3.0, None, None, "")
    assert next(r for r in got.collect() if r.system.endswith("two.json") and r.key == "bus-1").x == 6.0


def test_fields_that_files_describe(spark):
    arrays = {"metadata": {"t2m/.zarray": {"dtype": "<f4"}, "t2m/.zattrs": {"long_name": "2 metre temperature", "units": "K", "_ARRAY_DIMENSIONS": ["time", "cell"]}, "Time/.zarray": {"dtype": "<i8"}, "cell/.zarray": {"dtype": "<i4"}, "cell/.zattrs": {"_ARRAY_DIMENSIONS": ["cell"]}, "bare/.zarray": {"dtype": "|b1"}}}
    package = {"resources": [{"name": "r", "schema": {"fields": [{"name": "q", "type": "number", "unit": "MW"}]}}, {"name": "s", "schema": {"fields": [{"name": "z", "title": "Zed"}]}}, {"name": "none"}]}
    files = [("z", json.dumps(arrays)), ("top", json.dumps({"u/.zarray": {"dtype": "<f8"}})), ("p", json.dumps(package)), ("c", json.dumps({"properties": {"cube:variables": {"wind": {"type": "data", "unit": "m/s", "description": "Wind"}}}})), ("c2", json.dumps({"cube:variables": {"sun": {}}})), ("h", HEADER + "\r\n1,2,3"), ("n", json.dumps({"other": 1})), ("bad", "{broken"), ("e", ""), ("null", None)]
    got = documents.probed_fields(spark.createDataFrame(files, "path string, text string"))
    assert rows(got, "path", "surface", "field", "label", "type", "unit") == sorted(
        [
            ("z", "array-metadata", "t2m", "2 metre temperature", "<f4", "K"), ("z", "array-metadata", "bare", None, "|b1", None), ("top", "array-metadata", "u", None, "<f8", None),
            ("p", "table-package", "q", None, "number", "MW"), ("p", "table-package", "z", "Zed", None, None), ("c", "cube", "wind", "Wind", "data", "m/s"), ("c2", "cube", "sun", None, None, None),
        ]
        + [("h", "csv-header", n.strip(), None, None, None) for n in next(csv.reader([HEADER])) if n.strip()],
        key=repr,
    )


def test_documents_of_networks_are_read_once(spark, tmp_path):
    at = tmp_path / "one.json"
    at.write_text(json.dumps(system()))
    tables = documents.network_tables(spark, f"{tmp_path}/*.json")
    want = tables["ACBus"].count()
    at.unlink()
    spark.catalog.clearCache()
    assert want == 3 and documents.network_elements(tables).count() == 11
