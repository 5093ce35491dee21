"""Reports and the check of an operating point on small tables: nulls, ties, repeated and missing rows."""

from datetime import date, datetime

from datavane.operators import document, network, reports, rules, seed
from pyspark.sql import functions as F


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=repr)


def test_operating_point_of_each_fault(spark):
    buses = spark.createDataFrame([("s", "low", 0.89, 0.9, 1.1), ("s", "edge", 0.9 - 1e-7, 0.9, 1.1), ("s", "dark", None, 0.9, 1.1), ("s", "free", 1.0, None, 1.1)], "system string, name string, v double, vmin double, vmax double")
    lines = spark.createDataFrame([("s", "full", 3.0, 4.0, 5.0), ("s", "over", 3.0, -4.1, 5.0), ("s", "unrated", 0.0, 0.0, None)], "system string, name string, p double, q double, rating double")
    units = spark.createDataFrame([("s", "good", 101.0, 50.0, 120.0, True, True), ("s", "idle", 0.0, 50.0, 120.0, False, True), ("s", "ghost", 1.0, 0.0, 9.0, False, True), ("s", "small", 49.0, 50.0, 120.0, True, True), ("s", "gone", 0.0, 0.0, 9.0, False, False), ("t", "silent", None, 0.0, 1.0, None, None)], "system string, name string, p double, pmin double, pmax double, online boolean, available boolean")
    loads = spark.createDataFrame([("s", 148.0), ("z", 0.0)], "system string, p double")
    got = rows(network.operating_faults(buses, lines, units, loads), "system", "rule", "name")
    want = [("s", "voltage-range", n) for n in ("low", "dark", "free")] + [("s", "branch-rating", n) for n in ("over", "unrated")] + [("s", "dispatch-range", "small"), ("s", "offline-output", "ghost"), ("s", "unavailable", "gone")]
    want += [("t", "offline-output", "silent"), ("t", "unavailable", "silent"), ("t", "loss", None), ("z", "loss", None)]
    assert got == sorted(want, key=repr)  # s makes 151 for 148: a loss of two in a hundred
    more = loads.union(spark.createDataFrame([("s", 10.0)], loads.schema))
    assert ("s", "loss", None) in rows(network.operating_faults(buses, lines, units, more), "system", "rule", "name")
    none = [d.limit(0) for d in (buses, lines, units, loads)]
    assert network.operating_faults(*none).count() == 0


def test_coverage_keeps_gaps_of_domains_without_records(spark):
    d = spark.createDataFrame([(1, "a", 1), (2, "a", None), (3, None, 2)], "id long, data_domain string, level int")
    g = spark.createDataFrame([("x", "a", date(2000, 1, 1)), ("y", "b", date(2030, 1, 1)), ("z", None, None), ("y", "b", date(2030, 1, 1))], "gap string, data_domain string, review_after date")
    got = {r.data_domain: r.asDict() for r in reports.coverage(d, g, date(2020, 1, 1)).collect()}
    assert set(got) == {"a", "b"} and (got["a"]["l1"], got["a"]["total"], got["a"]["gaps"], got["a"]["stale"], got["a"]["placed"]) == (1, 2, 1, 1, True)
    assert (got["b"]["total"], got["b"]["gaps"], got["b"]["stale"], got["b"]["placed"]) == (0, 2, 0, False)
    assert rows(reports.gap_rows(d, g), "gap", "records", "placed") == [("x", 2, True), ("y", 0, False), ("y", 0, False), ("z", 0, False)]
    assert reports.coverage(d.limit(0), g.limit(0), date(2020, 1, 1)).count() == 0


def test_domains_in_the_order_of_their_numbers(spark):
    s = spark.createDataFrame([("DD10", "ten"), ("DD2", "two"), ("rest", "none")], "concept string, label string")
    d = spark.createDataFrame([(1, "DD2"), (2, None), (3, "elsewhere")], "id long, data_domain string")
    w = spark.createDataFrame([("DD2", "b"), ("DD2", "a"), ("DD2", "a")], "concept string, label string")
    assert [(r.place, r.concept, r.synonyms, r.n) for r in reports.domain_list(s, d, w).orderBy("place").collect()] == [(1, "DD2", ["a", "b"], 1), (2, "DD10", [], 0), (3, "rest", [], 0)]


def test_first_facet_with_any_record(spark):
    f = lambda *r: spark.createDataFrame(list(r), "concept string, id long")
    got = rows(reports.first_facet(f(("a", 0), ("b", 0), ("c", 0), ("a", 1)), ("one", f(("a", 1), ("a", 1))), ("two", f(("a", 2), ("a", 3), ("b", 3)))))
    assert got == [("a", "one", 1), ("b", "two", 1), ("c", None, 0)]


def test_neighbours_and_matches_of_a_concept(spark):
    b = spark.createDataFrame([("x", "top"), ("y", "top"), ("y", "top"), ("z", "top")], "narrower string, broader string")
    labels = spark.createDataFrame([("x", "Zeta"), ("y", "Alpha")], "concept string, label string")
    got = reports.concept_refs(b, labels).where("concept = 'top'").orderBy("place").collect()
    assert [(r.place, r.ref, r.label) for r in got] == [(1, "y", "Alpha"), (2, "x", "Zeta"), (3, "z", None)]
    m = spark.createDataFrame([("x", "http://a/core#exactMatch", "q"), ("x", "exactMatch", "p"), ("x", "closeMatch", "p")], "concept string, strength string, target string")
    assert rows(reports.matches_by_strength(m)) == [("x", "closeMatch", ["p"]), ("x", "exactMatch", ["p", "q"])]


def test_runs_resume_where_the_newest_checkpoint_is(spark):
    at = lambda h: datetime(2024, 1, 1, h)
    r = [("s", 1, at(1), "succeeded", "p1", 2), ("s", 2, at(2), "failed", "p2", 3), ("s", 3, at(3), "running", None, None), ("s", 4, at(12), "running", None, 1), ("s", 5, at(1), "succeeded", None, 1), ("n", 6, at(11), "running", None, 0)]
    runs = spark.createDataFrame(r, "source string, run_id long, started_at timestamp, state string, checkpoint string, seen long")
    got = {x.source: x for x in reports.run_history(runs, at(13), ("seen",)).collect()}
    assert (got["s"].runs, got["s"].seen, got["s"].last_good, got["s"].last_good_run, got["s"].checkpoint, got["s"].stuck) == (5, 7, at(1), 5, "p2", 1)
    assert (got["n"].last_good, got["n"].checkpoint, got["n"].stuck) == (None, None, 0)
    assert rows(reports.stuck_runs(runs, at(13)), "run_id") == [(3,)]


def test_arms_show_what_waits_behind_a_repair(spark):
    d = spark.createDataFrame([(1, None, None, 1), (2, None, "t", 1), (3, "c", None, 2), (4, "c", "t", None)], "id long, cadence string, title string, level int")
    checks = [rules.required("cadence"), rules.required("title", 2)]
    done = reports.replay(d, {"as-built": lambda x: x, "filled": lambda x: x.withColumn("cadence", F.lit("c"))}, checks)
    assert rows(reports.arm_counts(done), "arm", "seen", "queued", "flagged", "queued_l1") == [("as-built", 4, 1, 3, 1), ("filled", 4, 3, 1, 3)]
    assert rows(reports.arm_blockers(done)) == [("as-built", 1, "cadence", 2), ("as-built", 2, "title", 1), ("filled", 1, "title", 1)]


def test_totals_of_nothing(spark):
    o = spark.createDataFrame([], "id long, changed boolean, resolved long, gaps long")
    assert rows(reports.pass_totals(o)) == [(0, 0, 0, 0)]
    links = spark.createDataFrame([(1, 0.5, True, True), (1, 0.5, False, True), (2, 0.0, True, True), (2, 0.1, True, False)], "source long, score double, has_reason boolean, warned boolean")
    assert rows(reports.link_totals(o, links)) == [(0, 2, 1, 1)] and rows(reports.link_totals(o, links.limit(0))) == [(0, 0, 0, 0)]
    assert rows(reports.reconciled(spark.createDataFrame([("a",), ("a",)], "kind string"), spark.createDataFrame([("a", 2), ("b", 0), ("c", 1)], "kind string, declared long")), "kind", "agrees") == [("a", True), ("b", True), ("c", False)]
    assert rows(reports.issue_counts(spark.createDataFrame([("t", "open", 2), ("t", "open", 1), ("t", "done", 0), ("u", None, 0)], "target string, state string, at long"))) == [("t", 3, 2, 1), ("u", 1, 0, None)]
    assert rows(reports.acceptance_by_stage(spark.createDataFrame([("a", True), ("a", None), ("b", None), ("a", False)], "stage string, accepted boolean"))) == [("a", 1, 1, 0.5), ("b", 0, 0, None)]


def test_status_says_whether_entailments_are_current(spark):
    d = spark.createDataFrame([(1, "draft"), (2, "confirmed"), (2, None)], "id long, review_state string")
    h = lambda *x: spark.createDataFrame([(v,) for v in x], "hash string")
    e = spark.createDataFrame([(datetime(2024, 1, 1, 0, 0, 9), False), (datetime(2024, 1, 1, 0, 0, 2), True)], "at timestamp, done boolean")
    q = d.select(F.col("review_state").alias("state")).where("state is not null")
    got = dict(rows(reports.status_report(d, d, e, q, h("x"), h("x"), F.col("done"))))
    assert got == {"catalog_records": 1, "draft_records": 1, "indexed_documents": 2, "projector_lag_s": 7, "queue_draft": 1, "queue_confirmed": 1, "entailments_current": 1}
    assert dict(rows(reports.status_report(d, d, e.limit(0), q, h(), h("x"), F.col("done"))))["entailments_current"] == 0


def test_seed_records_say_what_the_row_says(spark):
    known = spark.createDataFrame([("CC BY + MIT", "LicenseRef-Dual", "either", True, True, False)], "raw string, id string, note string, redistribution boolean, commercial boolean, share_alike boolean")
    rows = spark.createDataFrame(
        [("Grid  A", True, None, "CC BY + MIT", "https://a.example.org", None, ["x", "http://y/z"], "for curators"), ("B", None, 3, None, None, "fragmented", None, None), (None, True, None, None, None, None, None, None), ("B", None, 3, None, None, "fragmented", None, None)],
        "name string, verified boolean, tier int, license string, access string, access_barrier string, derived_from array<string>, curator_note string",
    )
    out, bad = seed.records(rows, known, "c:")
    got = {r.title: r for r in out.collect()}
    assert out.count() == 3 and [r.problem for r in bad.collect()] == ["no-name"] and "curator_note" not in out.columns
    a, b = got["Grid  A"], got["B"]
    assert (a.id, a.license_id, a.commercial_use_allowed, a.share_alike, a.derived_from, a.pointer_rationale) == ("c:grid-a", "LicenseRef-Dual", True, False, ["c:x", "http://y/z"], None)
    assert [(d.kind, d.access_url, d.bulk) for d in a.distributions] == [("primary", "https://a.example.org", None)] and len(a.caveats) == 2
    assert b.distributions is None and b.reference_only and b.review_state == "draft" and "fragmented" in b.pointer_rationale and len(b.caveats) == 4
    assert seed.records(rows.limit(0), known, "c:")[0].count() == 0
    assert seed.records(rows, known, "c:", {**seed.TEXTS, "no-reason": "-"})[0].count() == 3


def test_stated_cadence_reads_durations_as_written(spark):
    d = spark.createDataFrame([(x,) for x in ("P1M", "p1m", "PT1M", "Annual", " monthly ", "P", "often", "", None, "P1YT2H")], "t string")
    assert [r[0] for r in d.select(seed.stated_cadence(F.col("t"))).collect()] == ["P1M", None, "PT1M", "P1Y", "P1M", None, None, None, None, "P1YT2H"]


def test_documents_of_records_without_children(spark):
    d = spark.createDataFrame([(1, "a", 2, None, None, None, 3, None), (2, "b", None, "none", False, True, None, "confirmed")], "id long, title string, level int, restriction string, bulk boolean, reference_only boolean, tier int, review_state string")
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    fields = t([(1, "p", "v/x"), (1, "q", "v/x"), (1, "r", None), (9, "s", "v/x")], "id long, part string, concept string")
    refs = t([(1, "data_domains", "v/d2"), (1, "data_domains", "v/d1"), (1, "data_domains", "v/d1")], "id long, kind string, iri string")
    labels = t([("v/x", "Ex", "1"), ("v/x", "Ey", "2"), ("v/d2", "Two", None)], "iri string, label string, notation string")
    paths = t([(1, "z", "csv", None, None, None, None, "verified"), (1, "a", None, "own", True, True, "opendap", None)], "id long, distribution_id string, media_type string, restriction string, bulk boolean, ranges boolean, protocol string, health string")
    grades = t([(1, "provenance", "A"), (2, "provenance", "A"), (2, "documentation", "B"), (2, "currency", "C")], "id long, facet string, grade string")
    pair = "id long, target long"
    args = (t([("v/x", "v/top")], "node string, ancestor string"), paths, grades, t([(1, 5), (1, 5)], pair), t([(2, 4)], "id long, inbound long"), t([], "id long, principal string"))
    got = {r.id: r for r in document.whole_documents(d, fields, refs, labels, *args).collect()}
    a, b = got[1], got[2]
    assert set(got) == {1, 2} and [tuple(c) for c in a.concepts] == [("v/x", "Ex", "1")] and a.concept_iris_expanded == ["v/top", "v/x"] and [c.label for c in a.data_domains] == ["d1", "Two"]
    assert (a.field_count, a.distribution_count, [x.distribution_id for x in a.distributions], a.worst_link_health, a.all_unreachable, a.bulk_download, a.has_range_requests) == (3, 2, ["a", "z"], "verified", False, True, True)
    assert (a.quality_assessed, a.provenance, a.upstream_count, a.reference_only, a.review_state) == (False, None, 1, True, "draft")
    assert (b.concepts, b.distributions, b.formats, b.field_count, b.field_count_bucket, b.bulk_download, b.all_unreachable) == ([], [], [], 0, "none", False, False)
    assert (b.quality_assessed, b.provenance, b.currency, b.inbound_link_count, b.reference_only, b.entitled_principals) == (False, None, "C", 4, True, [])
