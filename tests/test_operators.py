"""Traps that the driver's tables don't hold: ties, nulls, cycles, long chains, swapped intervals."""

import json
import math
import random
from datetime import datetime

import pytest
from datavane.functions import fixpoint, norm
from datavane.operators import changes, filters, graph, linkage, meaning, network, rules, search, views
from datavane.sources import loaders
from pyspark.sql import functions as F


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in names))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [("Hello, World!", "hello-world"), ("  --  ", "unnamed"), ("É", "unnamed")])
def test_slugify(spark, raw, want):
    assert one(spark, norm.slugify(F.col("t")), t=raw) == want


def test_slugify_keeps_long_names_apart(spark):
    a, b = (one(spark, norm.slugify(F.col("t")), t="x" * 90 + c) for c in "ab")
    assert a != b and len(a) == len(b) == 80


@pytest.mark.parametrize(("raw", "want"), [("WindSpeed100m", "100 m speed wind"), ("wind_speed_value", "speed wind"), ("mean", "mean"), ("", "")])
def test_name_key(spark, raw, want):
    assert one(spark, norm.name_key(F.col("t")), t=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("P1Y", 31536000), ("PT1H30M", 5400), ("P", None), ("PT", None), ("daily", None), ("P1M", 2592000)])
def test_cadence(spark, raw, want):
    assert one(spark, norm.cadence_seconds(F.col("t")), t=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("Updated daily", "P1D"), ("not currently being updated daily", "discontinued"), ("bi-weekly", "P14D"), ("as needed", "on-demand"), ("ad hoc", "irregular"), ("n/a", None), ("PT1H", "PT1H"), ("blue", None)])
def test_cadence_phrase(spark, raw, want):
    assert one(spark, norm.cadence_from_phrase(F.col("t")), t=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("[CC BY 4.0](https://creativecommons.org/licenses/by/4.0)", "CC-BY-4.0"), ("Creative Commons", "Creative Commons"), ("The MIT License", "MIT"), (None, None)])
def test_license(spark, raw, want):
    assert one(spark, norm.license_to_spdx(F.col("t")), t=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("2016", datetime(2016, 1, 1)), ("2016-05", datetime(2016, 5, 1)), ("2016-05-04", datetime(2016, 5, 4)), ("2016-99", None), ("soon", None)])
def test_vintage(spark, raw, want):
    assert one(spark, norm.vintage(F.col("t")), t=raw) == want


def test_closure_has_shortest_depths_and_survives_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("d", "d"), ("a", "b")], "child string, parent string")
    got = {(r.node, r.ancestor): r.depth for r in fixpoint.closure(e).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 1, ("b", "c"): 1, ("b", "a"): 2, ("c", "a"): 1, ("c", "b"): 2}


def test_longest_depth_is_null_for_cycles_and_unknown_parents(spark):
    e = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, 4), (4, 3), (5, 99), (6, 7), (8, 2)], "child long, parent long")
    n = spark.createDataFrame([(i, i == 0) for i in range(9)], "node long, grounded boolean")
    got = {r.node: r.depth for r in fixpoint.longest_depth(e, n).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: None, 4: None, 5: None, 6: None, 7: None, 8: 3}


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    e = spark.createDataFrame(list(zip(order[:-1], order[1:], strict=True)) + [(1000, 1001), (1002, 1002)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(n), 1000, 1001, 1002]], "node long")
    got = {r.node: r.component for r in fixpoint.components(nodes, e).collect()}
    assert got == dict.fromkeys(range(n), 0) | {1000: 1000, 1001: 1000, 1002: 1002}
    assert {r.node for r in graph.largest_component(nodes, e).collect()} == set(range(n))


def test_missing_extent_passes_the_filter_but_scores_nothing(spark):
    df = spark.createDataFrame([(1, None, None, None, None), (2, 0.0, 0.0, 10.0, 10.0), (3, 10.0, 10.0, 20.0, 20.0), (4, 50.0, 50.0, 60.0, 60.0)], "id long, w double, s double, e double, n double")
    box = tuple(map(F.col, "wsen"))
    assert {r.id for r in df.where(filters.bbox_meets(*box, (5, 5, 10, 10))).collect()} == {1, 2, 3}
    other = tuple(map(F.lit, (0.0, 0.0, 10.0, 20.0)))
    assert [r.x for r in df.orderBy("id").select(linkage.box_iou(box, other).alias("x")).collect()] == [0.0, 0.5, 0.0, 0.0]


def test_time_overlap_repairs_swapped_ends(spark):
    df = spark.createDataFrame([("2020-01-01", "2020-01-11", "2020-01-11", "2020-01-06"), ("2020-01-01", None, "2020-01-01", "2020-01-02")], "a string, b string, c string, d string")
    c = [F.col(x).cast("date") for x in "abcd"]
    assert [r.x for r in df.select(linkage.time_iou(*c).alias("x")).collect()] == [0.5, 0.0]


def test_near_ties_become_gaps(spark):
    s = spark.createDataFrame([("p", "c1", 0.5), ("p", "c2", 0.46), ("q", "c1", 0.5), ("q", "c2", 0.45), ("r", "c1", 0.2)], "part string, concept string, score double")
    got = {r.part: (r.concept, r.gap) for r in meaning.resolve_by_score(s).collect()}
    assert got == {"p": (None, "near-tie:c1|c2"), "q": ("c1", None), "r": (None, "below-threshold")}


def test_ladder(spark):
    parts = [(1, "wind_speed", None, None, None, None), (2, "ws", None, None, None, None), (3, "x", None, None, "c9", None), (4, "speed of air", "", None, None, None), (5, "zzz", "", None, None, None)]
    parts += [(6, "load", None, None, None, "m"), (7, "load", None, None, None, "kW"), (8, "twin", None, None, None, None), (9, "twin", None, "red thing seen from afar", None, None), (10, "odd", "Load", None, None, None), (11, "demand", "Wind speed", None, None, None), (12, "no", None, "speed of air", None, None)]
    df = spark.createDataFrame(parts, "part long, local_name string, label string, definition string, confirmed string, unit string")
    concepts = spark.createDataFrame([("c1", "Wind speed", ["ws"], "speed of air moving", False, None), ("c2", "Load", ["demand"], "power drawn", False, "MW"), ("c3", "zzz", [], "", True, None), ("t1", "Twin", [], "red thing seen from afar", False, None), ("t2", "twin", [], "blue one", False, None)], "concept string, pref_label string, alt_labels array<string>, definition string, abstract boolean, default_unit string")
    units = spark.createDataFrame([("MW", "power", 1e6), ("kW", "power", 1e3), ("m", "length", 1.0)], "unit string, kind string, mult double")
    got = {r.part: (r.concept, r.basis, r.gap, r.alternatives, r.factor) for r in meaning.ladder(df, concepts, units=units).collect()}
    assert {k: v[:2] for k, v in got.items() if k < 6} == {1: ("c1", "label"), 2: ("c1", "alt-label"), 3: ("c9", "confirmed"), 4: ("c1", "similarity"), 5: (None, "gap")}
    assert got[6][:3] == (None, "gap", "wrong-quantity") and got[7] == ("c2", "label", None, None, 0.001)
    assert got[8] == (None, "gap", "ambiguous", ["t1", "t2"], None) and got[9][:2] == ("t1", "similarity")
    assert got[10][:2] == ("c2", "label") and got[11][:2] == ("c1", "label")  # a preferred label before an alternative one
    assert got[12][:2] == ("c1", "similarity")  # by its definition alone


def test_bm25_and_prefixes(spark):
    docs = spark.createDataFrame([(1, "solar load", "x"), (2, "wind", "solar solar"), (3, "hydro", None)], "id long, title string, description string")
    index = search.postings(docs, "id", ["title", "description"])
    asked = spark.createDataFrame([(7, ["sol"])], "request_id long, tokens array<string>")
    terms = search.expand_last(index, asked)
    assert [(r.token, r.damping) for r in terms.collect()] == [("solar", 0.35)]
    scores = {r.id: r.score for r in search.bm25(index, terms, 3).collect()}
    assert set(scores) == {1, 2} and scores[1] > scores[2] > 0


def test_entitlement_does_not_leak(spark):
    d = spark.createDataFrame([(1, "public"), (2, "allowlisted-metadata"), (3, "allowlisted-existence")], "id long, visibility string")
    g = spark.createDataFrame([(3, None, "Ann@X.org")], "dataset_id long, principal_id string, email string")
    c = spark.createDataFrame([("anon", None, None, False, None), ("ann", "p", "ann@x.ORG", False, None), ("boss", "b", None, True, None)], "caller_id string, principal_id string, email string, is_steward boolean, custodian_of long")
    got = {(r.caller_id, r.id, r.full) for r in filters.visible(d, g, c).collect()}
    assert got == {("anon", 1, True), ("anon", 2, False), ("ann", 1, True), ("ann", 2, False), ("ann", 3, True), ("boss", 1, True), ("boss", 2, True), ("boss", 3, True)}


def test_health_counts_failures_since_the_last_success(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    p = spark.createDataFrame([(1, 1, t(1), "unreachable"), (2, 1, t(2), "verified"), (3, 1, t(3), "unreachable"), (4, 1, t(4), "unreachable"), (5, 2, t(1), "unreachable")], "probe_id long, distribution_id long, probed_at timestamp, outcome string")
    got = {r.distribution_id: (r.failures, r.last_success) for r in changes.health(p).collect()}
    assert got == {1: (2, t(2)), 2: (1, None)}


def test_rules_run_in_one_pass(spark):
    df = spark.createDataFrame([(1, "a", None, 1), (2, None, "x", 2)], "id long, name string, code string, parent long")
    found = rules.violations(df, [rules.required("name"), rules.either("name", "code", 2), rules.not_self("parent", "id", 3), rules.pattern("code", "^y", 2)])
    assert {(r.id, r.rule) for r in found.collect()} == {(2, "required"), (2, "pattern"), (1, "not-self"), (2, "not-self")}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_candidates_never_cross(spark):
    keys = spark.createDataFrame([(i, 1, "k") for i in range(50)], "id long, rung int, key string")
    titles = spark.createDataFrame([(i, f"t{i:02}") for i in range(50)], "id long, title string")
    got = linkage.candidates(keys, titles, cap=10)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert got.count() == 50 * 10 - 10 and linkage.pairs_cut(keys, 10).first()["cut"] == 40 * 49


def test_polyline_and_polygon(spark):
    df = spark.createDataFrame([([[0.0, 0.0], [1.0, 0.01], [2.0, 0.0], [3.0, 5.0], [4.0, 0.0]],)], "p array<array<double>>")
    got = df.select(network.simplify("p", F.lit(0.5)).alias("s"), network.clip_polygon(F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))]), F.lit(1.0), F.lit(1.0), F.lit(9.0), F.lit(2.0)).alias("c")).first()
    assert got.s == [[0.0, 0.0], [2.0, 0.0], [3.0, 5.0], [4.0, 0.0]]
    assert sorted(map(tuple, got.c)) == [(1.0, 1.0), (1.0, 2.0), (4.0, 1.0), (4.0, 2.0)]
    assert one(spark, F.size(network.points(F.col("t"))), t="LINESTRING (1.123456 2, 3 4)") == 2


def test_checksum_ignores_order(spark):
    a = spark.range(100).withColumn("x", F.col("id") % 7)
    assert loaders.checksum(a).first() == loaders.checksum(a.repartition(7).orderBy(F.desc("id"))).first()
    assert loaders.checksum(a).first() != loaders.checksum(a.withColumn("x", F.lit(1))).first()


def test_sources(spark, tmp_path):
    rec = {"id": "r1", "type": "Dataset", "title": "T", "distribution": [{"id": "d1", "accessURL": "http://x"}], "hasField": [{"id": "f1", "name": "a"}]}
    (tmp_path / "rec").mkdir()
    (tmp_path / "rec/a.json").write_text(json.dumps(rec))
    (tmp_path / "rec/b.json").write_text("{broken")
    got = loaders.load_records(spark, f"{tmp_path}/rec/*.json")
    assert [got[k].count() for k in ("datasets", "distributions", "parts", "bad")] == [1, 1, 1, 1]
    (tmp_path / "seed.json").write_text(json.dumps({"domains": {"D1": {"name": "One", "datasets": [{"name": "a"}, {"name": "b"}]}}}))
    assert [(r.domain, r.n, r.name) for r in loaders.load_seed(spark, f"{tmp_path}/seed.json").collect()] == [("D1", 0, "a"), ("D1", 1, "b")]
    (tmp_path / "p.json").write_text(json.dumps({"result": {"results": [{"id": 1}, {"id": 2}]}}))
    assert [r.source_record_id for r in loaders.load_payload_pages(spark, "ckan", f"{tmp_path}/p.json").collect()] == ["1", "2"]
    (tmp_path / "c.m").write_text("mpc.bus = [\n 1 2.5; % note\n 2 3\n];\n")
    assert [(r.n, r.id, r.v) for r in loaders.load_matpower(spark, f"{tmp_path}/c.m", "bus", ["id", "v"]).collect()] == [(0, 1.0, 2.5), (1, 2.0, 3.0)]
    (tmp_path / "l.csv").write_text("line_id,geometry\nL1,LINESTRING (1 2, 3 4)\n")
    assert loaders.load_wide_csv(spark, f"{tmp_path}/l.csv", ["line_id", "geometry"]).first().geometry == "LINESTRING (1 2, 3 4)"
    (tmp_path / "n.json").write_text(json.dumps({"components": {"buses": [{"id": 1, "name": "b"}], "arcs": [{"id": 2, "from": 1, "to": 1}], "loads": []}}))
    assert loaders.load_network(spark, f"{tmp_path}/n.json")["arcs"].count() == 1
    (tmp_path / "pages").mkdir()
    for i in range(3):
        (tmp_path / f"pages/{i}.json").write_text(json.dumps([{"id": f"{i}-{j}"} for j in range(2)]))
    spark.dataSource.register(loaders.PagedSource)
    page = spark.read.format("paged_records").option("path", f"{tmp_path}/pages").option("pages", 3).option("checkpoint", 1).load()
    assert sorted(r.id for r in page.collect()) == ["1-0", "1-1", "2-0", "2-1"]
    files = spark.createDataFrame([("z", json.dumps({"metadata": {"t2m/.zarray": {"dtype": "<f4"}, "time/.zarray": {"dtype": "<i8"}}})), ("h", "a, b\n1,2"), ("p", json.dumps({"resources": [{"schema": {"fields": [{"name": "q", "type": "number"}]}}]}))], "path string, text string")
    assert {(r.path, r.field, r.type) for r in loaders.schema_fields(files).collect()} == {("z", "t2m", "<f4"), ("h", "a", None), ("h", "b", None), ("p", "q", "number")}


def test_sinks_replace_their_own_buckets(spark, tmp_path):
    a = spark.range(20).withColumn("v", F.lit(1))
    loaders.replace_output(a, f"{tmp_path}/out", "id", 4)
    loaders.replace_output(a.where("id = 3").withColumn("v", F.lit(2)), f"{tmp_path}/out", "id", 4)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.where("v = 2").count() == 1 and got.count() < 20
    loaders.export_snapshot({"index": a}, f"{tmp_path}/snap")
    assert spark.read.json(f"{tmp_path}/snap/index").count() == 20


def test_shared_members_of_hot_and_rare_keys(spark):
    rng = random.Random(4)
    sets = {i: {rng.randrange(40) for _ in range(15)} | {99} for i in range(12)}
    df = spark.createDataFrame([(i, m) for i, s in sets.items() for m in s], "id long, member long")
    pairs = spark.createDataFrame([(a, b) for a in sets for b in sets if a != b], "source long, target long")
    got = {(r.source, r.target): r.s for r in linkage.shared_members(pairs, df).collect()}
    assert got == {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a != b}


def test_overlaps_of_pairs(spark):
    sets = {1: {1, 2, 3}, 2: {2, 3, 4}, 3: {9}}
    df = spark.createDataFrame([(i, m) for i, s in sets.items() for m in s] + [(1, 1)], "id long, member long")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (1, 7), (7, 8)], "source long, target long")
    got = {(r.source, r.target): (r.o, r.o_shared) for r in linkage.jaccard_from_keys(pairs, df, "o").collect()}
    assert got == {(1, 2): (0.5, 2), (2, 1): (0.5, 2), (1, 3): (0.0, 0), (1, 7): (0.0, 0), (7, 8): (0.0, 0)}


def test_long_chains_and_cycles_have_no_depth_cap(spark):
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 101)] + [(200, 201), (201, 200)], "child long, parent long")
    got = {(r.node, r.ancestor): r.depth for r in fixpoint.closure(chain).collect()}
    assert got == {(a, b): a - b for a in range(1, 101) for b in range(a)} | {(200, 201): 1, (201, 200): 1}
    assert {r.depth for r in fixpoint.closure(chain, max_depth=5).collect()} == {1, 2, 3, 4, 5}
    nodes = spark.createDataFrame([(i, i == 0) for i in [*range(71), 200, 201]], "node long, grounded boolean")
    depth = {r.node: r.depth for r in fixpoint.longest_depth(chain.where("child < 71 or child >= 200"), nodes).collect()}
    assert depth == {i: i for i in range(71)} | {200: None, 201: None}


def test_places_follow_the_whole_order(spark):
    from datavane.operators import views

    rows = [(i, (i * 7) % 50 if i % 9 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(7)
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [r.id for r in sorted(filters.placed(df, ("v", True), tie="id").collect(), key=lambda r: r.place)] == [i for i, _ in want]
    assert sorted(r.place for r in filters.placed(df, ("v", True), tie="id").collect()) == list(range(1, 201))
    other = spark.createDataFrame([(i, i * i) for i in range(198)], "k long, w long")
    got = views.by_row_order(df, other, "id", "k").collect()
    assert len(got) == 200 and all(r.slipped for r in got) and all(r.id == r.k or r.k is None for r in got)


def test_callers_see_what_they_may(spark):

    d = spark.createDataFrame([(1, "public"), (2, "allowlisted-metadata"), (3, "allowlisted-existence"), (4, "allowlisted-existence")], "id long, visibility string")
    g = spark.createDataFrame([(3, "p", None), (2, None, "A@b.c"), (9, "p", None)], "dataset_id long, principal_id string, email string")
    c = spark.createDataFrame([("x", None, None, False, None), ("y", "p", "a@B.c", False, 4), ("s", None, None, True, None)], "caller_id string, principal_id string, email string, is_steward boolean, custodian_of long")
    got = {(r.caller_id, r.id): r.full for r in filters.visible(d, g, c).collect()}
    assert got == {("x", 1): True, ("x", 2): False, ("y", 1): True, ("y", 2): True, ("y", 3): True, ("y", 4): True, **{("s", i): True for i in (1, 2, 3, 4)}}


def test_postings_count_in_their_own_row(spark):

    df = spark.createDataFrame([(1, "b a b", None), (2, "", "c"), (3, None, "a a a")], "id long, t string, d string")
    got = {(r.field, r.token, r.id, r.tf, r.len) for r in search.postings(df, "id", ["t", "d"]).collect()}
    assert got == {("t", "a", 1, 1, 3), ("t", "b", 1, 2, 3), ("d", "c", 2, 1, 1), ("d", "a", 3, 3, 3)}
    assert "Exchange" not in search.postings(df, "id", ["t", "d"])._jdf.queryExecution().executedPlan().toString()


def test_candidates_are_cut_by_source_and_neighbours_are_not(spark):
    keys = spark.createDataFrame([(0, 1, "a"), (0, 1, "b"), (0, 2, "z"), *[(i, 1, "a") for i in range(1, 6)], *[(i, 1, "b") for i in range(6, 11)], (20, 2, "z")], "id long, rung int, key string")
    titles = spark.createDataFrame([(i, f"t{i:02}") for i in range(31)], "id long, title string")
    near = spark.createDataFrame([(0, 30), (0, 1)], "source long, target long")
    got = linkage.candidates(keys, titles, cap=4, neighbours=near)
    assert {(r.target, r.rung) for r in got.where("source = 0").collect()} == {(1, 1), (2, 1), (3, 1), (20, 2), (30, 4)}  # the source takes a place
    seen = linkage.candidates(keys, titles, cap=4, neighbours=near, visible=titles.where("id <> 2 and id <> 30").select("id"))
    assert {r.target for r in seen.where("source = 0").collect()} == {1, 3, 20}


def test_lineage_makes_neighbours_origins_and_derivation(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "c"), ("x", "y")], "child string, parent string")
    up = fixpoint.closure(e)
    nodes = spark.createDataFrame([(i,) for i in "abcdz"], "id string")
    near = {(r.source, r.target) for r in linkage.lineage_rung(up, nodes).collect()}
    assert near == {(s, t) for s in "abcd" for t in "bcd" if s != t}  # the root has no ancestor, so it is no target
    pairs = spark.createDataFrame([("b", "d"), ("d", "c"), ("a", "b"), ("a", "z")], "source string, target string")
    got = {(r.source, r.target): (r.origin, r.depth_source, r.depth_target, r.correlated, r.derived) for r in linkage.with_origin(pairs, up).collect()}
    assert got == {("b", "d"): ("a", 1, 2, True, False), ("d", "c"): ("a", 2, 1, True, True), ("a", "b"): (None, None, None, False, True), ("a", "z"): (None, None, None, False, False)}


def test_shared_sets_count_as_pairs_with_their_sets_do(spark):
    rng = random.Random(4)
    rows = [(i, sorted({rng.randrange(12) for _ in range(4)} | ({99} if i % 2 else set())) if i % 7 else None, [f"m{rng.randrange(3)}"] if i % 5 else None) for i in range(40)]
    profile = spark.createDataFrame(rows, "id long, x array<long>, y array<string>")
    pairs = spark.createDataFrame([(i, j) for i in range(41) for j in range(41) if i != j and (i * j) % 3], "source long, target long")
    names = {"of_x": "x", "of_y": "y"}
    columns = ["source", "target", *[f"{n}{e}" for n in names for e in ("", "_shared", "_both")]]
    want = {tuple(r) for r in linkage.with_overlaps(linkage.paired(pairs, profile), names).select(columns).collect()}
    for often in (1, 6, 256):
        got = linkage.shared_sets(pairs, profile, names, often)
        assert {tuple(r) for r in got.select(columns).collect()} == want and got.count() == len(want)


def test_a_repeated_key_takes_one_place(spark):
    keys = spark.createDataFrame([(i, 1, "a") for i in (0, 1, 1, 1, 2)], "id long, rung int, key string")
    got = linkage.candidates(keys, spark.createDataFrame([(i, f"t{i}") for i in range(3)], "id long, title string"), cap=3)
    assert {(r.source, r.target) for r in got.collect()} == {(s, t) for s in range(3) for t in range(3) if s != t}


def test_neighbours_of_several_origins_come_once(spark):
    edges = [("a", "r"), ("b", "r"), ("a", "q"), ("b", "q"), ("c", "b"), ("d", "q"), ("x", "y"), ("y", "x")]
    up = fixpoint.closure(spark.createDataFrame(edges, "child string, parent string"))
    nodes = spark.createDataFrame([(i,) for i in "abcdxyz"], "node string")
    own = {n: {n} | {r.ancestor for r in up.where(F.col("node") == n).collect()} for n in "abcdxyz"}
    want = sorted((a, b) for a in own for b in own if a < b and own[a] & own[b])
    for block in (1, 2048):
        assert sorted(map(tuple, graph.lineage_neighbours(up, nodes, block).collect())) == want


def test_elements_and_queries_on_one_place_are_looked_at_once(spark):
    q = spark.createDataFrame([(i, 0.0, 0.0) for i in range(300)] + [(900, None, 0.0)], "q long, x double, y double")
    points = spark.createDataFrame([(f"p{i}", i, 0.1, 0.0) for i in range(300)], "element string, seq long, x double, y double")
    routes = spark.createDataFrame([(f"r{i}", i, [[0.1, 0.0], [2.0, 0.0]]) for i in range(300)], "element string, seq long, path array<array<double>>")
    assert {(r.q, r.element, r.distance) for r in network.nearest(q, points, routes, 0.9).collect()} == {(i, "p299", 0.0) for i in range(300)}


def test_places_stand_in_for_missing_boxes(spark):
    rows = [(1, 0.0, 0.5, True), (2, None, 0.5, True), (3, None, 0.0, False)]
    df = spark.createDataFrame(rows, "id int, w double, p double, both boolean")
    a, b = (F.col("w"), F.lit(0.0), F.lit(2.0), F.lit(2.0)), (F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0))
    got = df.withColumns(linkage.geographic(a, b, F.col("p"), F.col("both"))).orderBy("id").collect()
    assert [(r.geographic_overlap, r.geographic_method) for r in got] == [(1.0, "bbox-iou"), (0.5, "place-iris"), (0.0, "none")]


def test_listed(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)], "x array<string>")
    assert [r.y for r in df.select(linkage.listed(F.col("x")).alias("y")).collect()] == ["", "a", "a and b", "a, b and c"]


def brute_nearest(q, points, routes, radius):
    def far(a, b, x, y):
        dx, dy = b[0] - a[0], b[1] - a[1]
        square = dx * dx + dy * dy
        t = 0 if square == 0 else max(0, min(1, ((x - a[0]) * dx + (y - a[1]) * dy) / square))
        return math.hypot(x - (a[0] + t * dx), y - (a[1] + t * dy))

    best, at = None, radius
    for name, _, path in sorted(routes, key=lambda r: r[1]):
        d = round(min((far(a, b, *q) for a, b in zip(path, path[1:])), default=math.inf), 9)
        best, at = (name, d) if d <= at else best, min(at, d)
    for name, _, x, y in sorted(points, key=lambda p: p[1]):
        d = round(max(0, math.hypot(q[0] - x, q[1] - y) - radius / 3), 9)
        best, at = (name, d) if d <= at else best, min(at, d)
    return best


def test_nearest_of_points_and_routes(spark):
    rng = random.Random(3)
    spot = lambda: (rng.uniform(-20, 20), rng.uniform(-20, 20))
    points = [(f"p{i}", i, *spot()) for i in range(60)]
    routes = [(f"r{i}", i, [list(spot())]) for i in range(20)]
    for _, _, path in routes:
        for _ in range(rng.randrange(4)):
            path.append([path[-1][0] + rng.uniform(-3, 3), path[-1][1] + rng.uniform(-3, 3)])
    routes += [("long", 50, [[-20.0, -19.5], [20.0, 19.7]]), ("flat", 51, [[-20.0, 2.0], [20.0, 2.0]]), ("steep", 52, [[4.0, 20.0], [4.0, -20.0]]), ("dot", 53, [[7.0, 7.0], [7.0, 7.0]]), ("short", 54, [[1.0, 1.0]])]
    points += [("a", 98, 4.0, 2.0), ("b", 99, 4.0, 2.0)]  # on a node of two routes: a point, and the later of two
    asked = [spot() for _ in range(400)] + [(4.0, 2.0), (7.0, 7.0), (4.0, 2.3)]
    got = {r.q: (r.element, r.distance) for r in network.nearest(
        spark.createDataFrame([(i, *p) for i, p in enumerate(asked)], "q long, x double, y double"),
        spark.createDataFrame(points, "element string, seq long, x double, y double"),
        spark.createDataFrame(routes, "element string, seq long, path array<array<double>>"), 1.5).collect()}
    want = {i: w for i, p in enumerate(asked) if (w := brute_nearest(p, points, routes, 1.5))}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-8 for k in want) and got[400][0] == "b"
    cells = network.covered_cells(spark.createDataFrame([(0.0, 0.0, 1000.0, 1.0)], "x1 double, y1 double, x2 double, y2 double"), 2.0)
    assert 500 <= cells.count() <= 504  # a long line is one row a cell


def test_depths_along_ten_thousand_nodes(spark):
    n = 10_000
    chain = spark.range(1, n).selectExpr("id AS child", "id - 1 AS parent")
    got = fixpoint.longest_depth(chain, spark.range(n).selectExpr("id AS node", "id = 0 AS grounded"))
    assert got.where("depth <> node").count() == 0 and got.where("depth IS NULL").count() == 0


def test_depths_of_mixed_graphs(spark):
    rng = random.Random(8)
    edges = [(c, rng.randrange(c)) for c in range(5, 120) for _ in range(rng.choice([1, 1, 1, 2, 3]))]
    edges += [(200, 201), (201, 202), (202, 200), (203, 200), (204, 203), (204, 1), (205, 999), (206, 205), (207, 4), (208, 207)]
    nodes = [(i, i in (0, 1, 2, 3)) for i in [*range(120), *range(200, 209)]]  # 4 is a root that isn't grounded
    up = {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)
    known = dict(nodes)

    def depth(x, seen=()):
        if x not in known or x in seen:
            return None
        if x not in up:
            return 0 if known[x] else None
        d = [depth(p, (*seen, x)) for p in up[x]]
        return None if None in d else 1 + max(d)

    got = {r.node: r.depth for r in fixpoint.longest_depth(spark.createDataFrame(edges, "child long, parent long"), spark.createDataFrame(nodes, "node long, grounded boolean")).collect()}
    assert got == {x: depth(x) for x in known}


def test_answers_and_counts_agree_with_the_list(spark):
    rng = random.Random(2)
    d = spark.createDataFrame([(i, rng.choice(["public", "allowlisted-metadata", "allowlisted-existence"])) for i in range(40)], "id long, visibility string")
    g = spark.createDataFrame([(rng.randrange(40), f"p{rng.randrange(6)}", rng.choice([None, "A@x.org"])) for _ in range(25)], "dataset_id long, principal_id string, email string")
    c = spark.createDataFrame([(i, f"p{i}", "a@X.org" if i == 3 else None, i == 5, 7 if i == 2 else None) for i in range(8)], "caller_id long, principal_id string, email string, is_steward boolean, custodian_of long")
    seen = {(r.caller_id, r.id): r.full for r in filters.visible(d, g, c).collect()}
    asked = c.select("caller_id").join(d.select("id"), F.lit(True))
    assert {(r.caller_id, r.id): r.full for r in filters.answered(asked, d, g, c).where("known").collect()} == seen
    counts = {r.caller_id: (r.known, r.full) for r in filters.visible_counts(d, g, c).collect()}
    assert counts == {i: (sum(k[0] == i for k in seen), sum(v for k, v in seen.items() if k[0] == i)) for i in range(8)}


def test_a_name_that_all_have_makes_no_product(spark, monkeypatch):
    rng = random.Random(3)
    d = spark.createDataFrame([(i, rng.choice(["public", "allowlisted-metadata", "allowlisted-existence"])) for i in range(30)], "id long, visibility string")
    g = spark.createDataFrame([(rng.randrange(32), "all", rng.choice([None, "A@x.org", "all"])) for _ in range(40)] + [(3, "p", None)], "dataset_id long, principal_id string, email string")
    c = spark.createDataFrame([(i, rng.choice(["all", "p", None]), rng.choice([None, "a@X.org", "ALL", "none"]), i % 9 == 5, rng.choice([None, 3, 7, 31])) for i in range(60)], "caller_id long, principal_id string, email string, is_steward boolean, custodian_of long")
    seen = {(r.caller_id, r.id): r.full for r in filters.visible(d, g, c).collect()}
    monkeypatch.setattr(filters, "insiders", lambda *_: pytest.fail("a row for each caller and record of a name"))
    asked = c.select("caller_id").join(d.select("id"), F.lit(True))
    assert {(r.caller_id, r.id): r.full for r in filters.answered(asked, d, g, c).where("known").collect()} == seen
    counts = {r.caller_id: (r.known, r.full) for r in filters.visible_counts(d, g, c).collect()}
    assert counts == {i: (sum(k[0] == i for k in seen), sum(v for k, v in seen.items() if k[0] == i)) for i in range(60)}


def test_an_origin_of_a_third_of_all_records_stays_a_list(spark):
    n = 30_000
    up = spark.range(n).where("id % 3 = 0 and id > 0").selectExpr("id AS node", "0L AS ancestor", "1 AS depth")
    origins = linkage.lineage_origins(up, spark.range(n))
    counts = {r.origin: (r.members, r.derived, r.pairs) for r in linkage.origin_counts(origins).where("members > 1").collect()}
    assert counts == {0: (10_000, 9_999, 10_000 * 9_999 - 9_999)} and origins.count() == n + 9_999
    few = linkage.lineage_rung(up, spark.range(n).selectExpr("id"), spark.range(7).selectExpr("id"))
    assert few.count() == 9_999 + 2 * 9_998  # 0 meets all, 3 and 6 all others


def test_all_terms_lie_in_one_field(spark):
    docs = spark.createDataFrame([(1, "solar load", "wind"), (2, "solar", "load"), (3, "x", "load of solar panels"), (4, "solar loader", "")], "id long, title string, description string")
    index = search.postings(docs, "id", ["title", "description"])
    asked = spark.createDataFrame([(7, "solar"), (7, "load")], "request_id long, token string")
    whole = search.all_terms(index, asked)
    assert {(r.id, r.best) for r in whole.collect()} == {(1, 12.0), (3, 2.0)}
    got = search.last_as_prefix(index, spark.createDataFrame([(7, ["solar", "load"])], "request_id long, tokens array<string>"), whole)
    assert {(r.id, round(r.best, 6)) for r in got.collect()} == {(1, round(12 + 2 * 2.1 * 0.35, 6)), (3, 2.0), (4, round(2 * 2.1 * 0.35, 6))}


def test_access_paths_say_what_was_skipped(spark):
    schema = "dataset_id long, distribution_id long, url string, reachable boolean, health string, protocol string, sliceable boolean, chunk_index string, anonymous boolean, requester_pays boolean, bulk boolean"
    paths = spark.createDataFrame([
        (1, 10, "https://a", False, "degraded", None, False, None, True, False, True), (1, 11, "https://b", True, "verified", None, False, None, False, False, True),
        (1, 12, "https://c", True, "verified", None, False, None, None, False, True), (1, 13, "s3://d", True, "verified", "opendap", False, None, False, True, False),
        (2, 20, "https://e", False, "unreachable", None, False, None, True, False, True), (3, 30, None, True, "verified", None, False, None, True, False, True)], schema)
    asked = spark.createDataFrame([(1, 1, None, False), (2, 1, None, True), (3, 1, 10, False), (4, 1, 99, False), (5, 2, None, False), (6, 3, None, False)], "request_id long, dataset_id long, pinned long, wants_slice boolean")
    got = {r.request_id: (r.distribution_id, r.alternatives, r.note) for r in changes.access_path(paths, asked).collect()}
    assert got[1] == (12, 3, changes.SKIPPED % 1)  # not known to need an account goes before one that does
    assert got[2][0] == 13 and got[3] == (10, 3, changes.PINNED % "degraded") and got[4] == (None, 3, None)
    assert got[5] == (20, 0, changes.NONE_LIVE) and got[6][0] is None


def test_entailments_and_their_guard(spark):
    two = lambda rows, a, b: spark.createDataFrame(rows, f"{a} string, {b} string")
    facts = (two([("a", "b"), ("b", "c"), ("b", "a")], "narrower", "broader"), two([("x", "y"), ("y", "x"), ("x", "z")], "a", "b"), two([("a", "S")], "concept", "scheme"), two([("a", "e1"), ("a", "e2")], "concept", "external"), two([("c", "S"), ("c", "T")], "concept", "scheme"))
    rows, counts = graph.materialised(graph.entailments(*facts), spark.createDataFrame([("r",)], "iri string"))
    got = {(r.rule, r.s, r.o) for r in rows.collect()}
    assert {x for x in got if x[0] == "inScheme"} == {("inScheme", "a", "T"), ("inScheme", "b", "S"), ("inScheme", "b", "T")}
    assert {x for x in got if x[0] == "related"} == {("related", "z", "x")} and ("exactMatch", "e1", "e2") in got and ("hasTopConcept", "S", "c") in got
    assert {r.rule: r.n for r in counts.collect()}["inSchemeFromTop"] == 2 and not any(x[1] == x[2] for x in got)
    with pytest.raises(ValueError, match="catalogue record"):
        graph.materialised(graph.entailments(*facts), spark.createDataFrame([("a",)], "iri string"))


def test_publishers_below_a_country_registry(spark):
    urls = ["https://data.gov.uk/x", "https://www.ons.gov.uk", "https://a.b.example.org/", "https://gov.uk/", "https://x.co.jp", "ftp:nothing", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(norm.publisher_key(F.col("u")).alias("p"))
    assert [r.p for r in df.collect()] == ["data.gov.uk", "ons.gov.uk", "example.org", "gov.uk", "x.co.jp", None, None]


def test_pages_and_facets_of_the_whole_match_set(spark):
    scores = spark.createDataFrame([(1, i, float(i % 4)) for i in range(30)] + [(2, 3, 1.0)], "request_id long, id long, score double")
    docs = spark.createDataFrame([(i, f"T{i:02d}", "a" if i < 10 else "b" if i < 29 else None) for i in range(30)], "id long, title string, lang string")
    found = search.matches(scores, docs.where("id <> 7").select("id"))
    assert found.where("request_id = 1").count() == 21  # 22 with a score, one of them not allowed
    page = search.result_page(found, docs.select("id", "title"), 5, 10).where("request_id = 1").orderBy("rank").collect()
    want = sorted((i for i in range(30) if i % 4 and i != 7), key=lambda i: (-(i % 4), i))
    assert [r.id for r in page] == want[5:15] and {(r.total, r.next_offset) for r in page} == {(21, 15)}
    assert {r.next_offset for r in search.result_page(found, docs.select("id", "title"), 15, 10).collect()} == {None}
    got = {(r.request_id, r.value): r.n for r in search.request_facets(found, docs, ["lang"]).collect()}
    assert got == {(1, "a"): sum(i < 10 for i in want), (1, "b"): sum(10 <= i < 29 for i in want), (2, "a"): 1}


def test_schema_pages_show_the_best_label(spark):
    terms = spark.createDataFrame([("u", "label", "kilovolts", None), ("u", "symbol", "kV", None), ("u", "prefLabel", "kilovolt", "d"), ("c", "label", "x", None), ("c", "prefLabel", "z", None), ("c", "prefLabel", "y", None), ("w", "other", "o", None)], "iri string, kind string, label string, definition string")
    assert {(r.iri, r.label, r.definition) for r in views.term_labels(terms).collect()} == {("u", "kV", "d"), ("c", "y", None), ("w", "o", None)}
    parts = spark.createDataFrame([(1, f"p{i}", f"l{i}", "c" if i else None, "u" if i % 2 else None) for i in range(5)] + [(2, "q", "l", None, "nowhere")], "id long, part string, label string, concept string, unit string")
    asked = spark.createDataFrame([(7, 1, 1, 3), (8, 1, 3, 3), (9, 2, 0, 5), (10, 3, 0, 5)], "request_id long, id long, offset long, limit long")
    got = {(r.request_id, r.part): (r.place, r.concept_label, r.unit_label, r.total, r.next_offset) for r in views.schema_pages(parts, terms, asked).collect()}
    assert {k for k in got} == {(7, "p1"), (7, "p2"), (7, "p3"), (8, "p3"), (8, "p4"), (9, "q")}
    assert got[7, "p1"] == (2, "y", "kV", 5, 4) and got[8, "p4"] == (5, "y", None, 5, None) and got[9, "q"] == (1, None, None, 1, None)


def test_best_by_vector_against_brute_force(spark):
    rng = random.Random(5)
    vec = lambda: [rng.choice((-1.0, 0.0, 1.0, 2.0)) for _ in range(4)]
    parts = [(i, vec()) for i in range(40)] + [(40, None), (41, [0.0] * 4), (42, [1.0, 2.0]), (43, [])]
    concepts = [(f"c{i:02}", vec()) for i in range(25)] + [("d", None), ("e", [2.0, 4.0])]

    def cosine(a, b):
        na, nb = (math.sqrt(sum(x * x for x in v or [])) for v in (a, b))
        return round(max(0.0, min(1.0, sum(x * y for x, y in zip(a, b, strict=True)) / (na * nb))), 9) if na and nb and len(a) == len(b) else 0.0

    want = {(p, c, s) for p, v in parts for s, c in [(-s, c) for s, c in sorted((-cosine(v, w), c) for c, w in concepts)[:2]]}
    a = spark.createDataFrame(parts, "part long, vector array<float>").withColumn("score", F.lit(9))
    b = spark.createDataFrame(concepts, "concept string, vector array<float>").withColumn("g", F.lit(9))
    for limit, block in ((1 << 20, 1024), (1 << 20, 7), (700, 3)):  # one matrix; blocks of it; blocks in tasks of their own
        assert {(r.part, r.concept, round(r.score, 9)) for r in meaning.best_by_vector(a, b, limit, block).collect()} == want
    assert meaning.best_by_vector(a, b.limit(0)).count() == 0 and meaning.best_by_vector(a.limit(0), b, 700).count() == 0
    assert {r.part: r.score for r in meaning.best_by_vector(a, b.where("concept = 'e'")).collect()}[42] == 1.0


def test_embedding_is_made_once_a_task_and_keeps_nulls(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "id long, text string").coalesce(1)
    got = {r.id: r.v for r in meaning.embedded(rows, "text", lambda: lambda texts: [[float(len(x)), 1.0] for x in texts], "v").collect()}
    assert got == {1: [2.0, 1.0], 2: None, 3: [0.0, 1.0]}


def test_keyset_pages_are_those_by_offset(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(i, rng.choice(["a", "B", "b", None, "C"]), rng.choice([1, 2, None])) for i in range(57)], "id long, name string, size int").cache()
    for keys in ((("name", False), ("size", True)), (("size", False),), (("size", True), ("name", True))):
        want = [r.id for r in filters.ordered(rows, *keys, tie="id").collect()]
        got, last = [], None
        while page := filters.page_after(rows, *keys, tie="id", last=last, limit=10).collect():
            got += [r.id for r in page]
            last = page[-1].asDict()
        assert got == want
        cursors = {r.page: r.id for r in filters.page_cursors(rows, *keys, tie="id", limit=10).collect()}
        assert cursors == {n + 1: want[10 * n + 9] for n in range(5)}
    assert filters.page_after(rows.limit(0), ("name", False), tie="id", last={"name": None, "id": None}).count() == 0


def test_surrogate_ids_of_a_large_group(spark):
    rows = [(i, "hot" if i % 3 else None if i % 2 else f"k{i % 7}", -i) for i in range(500)]
    got = views.surrogate_ids(spark.createDataFrame(rows, "key long, kind string, rank int").withColumn("id", F.lit("x")).repartition(5), "kind", "rank", "key").collect()
    want = {}
    for kind in {k for _, k, _ in rows}:
        want |= {key: n + 1 for n, (_, key) in enumerate(sorted((rank, key) for key, k, rank in rows if k == kind))}
    assert {r.key: r.id for r in got} == want and len(got) == 500


def test_parts_with_the_same_words_are_scored_once(spark):
    parts = spark.range(300).select(F.col("id").alias("part"), F.when(F.col("id") % 2 == 0, "red bolt").otherwise("bolt, red").alias("local_name"), F.lit("").alias("label"), F.lit(None).cast("string").alias("definition"))
    concepts = spark.createDataFrame([("c", "red bolt", ["red bolt alt"], "steel", False), ("d", "red ring", ["ring alt"], "bolt", False)], "concept string, pref_label string, alt_labels array<string>, definition string, abstract boolean")
    assert meaning.word_scores(parts, concepts)[1].count() == 2
    got = meaning.lexical_scores(parts, concepts)
    assert got.count() == 600 and {(r.concept, round(r.score, 6)) for r in got.collect()} == {("c", round(0.7 * 2 / 3, 6)), ("d", round(0.7 / 4 + 0.15, 6))}
    best = meaning.resolved(parts, concepts).collect()
    assert len(best) == 300 and {(r.concept, r.gap) for r in best} == {("c", None)}


def test_a_text_is_normalised_once_for_all_rules(spark):
    rows = spark.createDataFrame([("Published  quarterly",), (None,), ("MIT",)], "x string")
    for made in (norm.cadence_from_phrase(F.col("x")), norm.license_to_spdx(F.col("x"))):
        plan = rows.select(made.alias("y"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace(") <= 2


def test_texts_are_counted_in_runs_of_bounded_bytes():
    import pyarrow as pa

    texts = pa.array(["a" * 10, None, "b" * 3000000, "", *["c d"] * 700000])
    got = list(search._runs(texts.slice(0, len(texts))))
    assert [lo for lo, _ in got] == [0, *(lo + n for lo, n in got[:-1])] and sum(n for _, n in got) == len(texts)
    assert all(n == 1 or 3 * n <= search.RUN_BYTES + 64 for _, n in got) and len(got) >= 4


def test_scores_shuffle_postings_once_by_document(spark):
    docs = spark.range(50).select("id", F.lit("grid map").alias("title"), F.concat(F.lit("load "), F.col("id").cast("string")).alias("description"))
    index = search.shared.saved(search.postings(docs, "id", ["title", "description"]), "test-index")
    asked = spark.createDataFrame([(1, "load", 1.0), (1, "map", 1.0), (2, "7", 1.0)], "request_id int, token string, damping double")
    scores = search.bm25(index, asked, 50)
    assert scores.count() == 51
    plan = search.matches(scores, docs.select("id"))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(request_id" not in plan and "hashpartitioning(field" not in plan


def test_network_faults_read_the_arcs_once(spark):
    arcs = spark.createDataFrame([(1, 1, 1), (2, 1, 9), (3, 8, 8), (4, None, 1), (5, 1, 2)], "arc_id long, bus0 long, bus1 long")
    got = rules.network_faults(spark.createDataFrame([(1,), (2,)], "bus_id long"), arcs)
    want = [("dangling-bus0", 3), ("dangling-bus0", 4), ("dangling-bus1", 2), ("dangling-bus1", 3), ("self-loop", 1), ("self-loop", 3)]
    assert sorted((r.rule, r.arc_id) for r in got.collect()) == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join LeftAnti") == 1


def test_reach_broadcasts_no_round(spark, monkeypatch):
    plans, cut = [], fixpoint.cut

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(fixpoint, "cut", noted)
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 2)], "child long, parent long")
    got = fixpoint.reach(edges, spark.createDataFrame([(7, 1)], "request_id int, node long"))
    assert sorted((r.node, r.depth) for r in got.collect()) == [(2, 1), (3, 2), (4, 2)]
    assert any("Join" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_scores_that_cannot_be_in_the_top_are_not_sorted(spark):
    rows = [(r, i, float((i * 37 + r) % 50) / 4) for r in range(3) for i in range(400)]
    scores = spark.createDataFrame(rows, "request_id int, id int, score double").coalesce(1)
    titles = spark.createDataFrame([(i, f"t{i % 9}") for i in range(400)], "id int, title string")
    want = {(r, k + 1, i) for r in range(3) for k, (_, _, i) in enumerate(sorted((-s, f"t{i % 9}", i) for q, i, s in rows if q == r and s > 0)[:11])}
    assert {(r.request_id, r.rank, r.id) for r in search.top(scores, titles, 11).collect()} == want
    assert "WindowGroupLimit" not in search._can_be_top(scores, 11)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    assert search._can_be_top(scores, 11).count() < 600
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_all_terms_in_one_field_with_and_without_rare_ones(spark):
    index = spark.createDataFrame([(i, f, w) for i in range(20) for f in ("title", "description") for w in "abcd" if (i * (ord(w) - 95)) % 5 < 3 + (f == "title")], "id int, field string, token string")
    asked = spark.createDataFrame([(q, w) for q, ws in enumerate(("ab", "abcd", "d", "az", "")) for w in ws], "request_id int, token string")
    have = {}
    for r in index.collect():
        have.setdefault((r.id, r.field), set()).add(r.token)
    want = {}
    for q, ws in enumerate(("ab", "abcd", "d", "az")):
        for (i, f), held in have.items():
            if set(ws) <= held:
                want[q, i] = max(want.get((q, i), 0), len(ws) * search.BOOSTS[f])
    assert {(r.request_id, r.id): r.best for r in search.all_terms(index, asked).collect()} == want
