import os
import random

import pytest
from pyspark.sql import functions as F

from datavane.functions import fixpoint, shared
from datavane.operators import linkage, tiles
from datavane.plans import catalog, demo


def test_tiles_equal_brute_force_at_any_number_of_groups(spark, monkeypatch):
    rng = random.Random(5)
    n, made = 70, [(k, i, sorted(rng.sample(range(70), rng.randrange(1, 9))), sorted(rng.sample(range(70), rng.randrange(1, 9)))) for k in (0, 1) for i in range(k * 100, k * 100 + 25)]
    lists = spark.createDataFrame(made, "k int, list long, askers array<int>, members array<int>")
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(900)]
    asked = spark.createDataFrame(pairs, "source int, target int")
    want = {(s, t, *(sum(s in a and t in m for k, _, a, m in made if k == kind) for kind in (0, 1))) for s, t in pairs}
    shares = sorted((s, t, i) for s, t in set(pairs) for _, i, a, m in made if s in a and t in m)
    met = {(s, k): sorted({t for kind, _, a, m in made if kind == k and s in a for t in m}) for k in (0, 1) for s in range(n)}
    for group, run in ((1 << 16, 1 << 20), (20, 16)):
        monkeypatch.setattr(tiles, "GROUP", group)
        monkeypatch.setattr(tiles, "RUN", run)
        assert tiles.groups(n, 500) == ((1, 1) if group > n else (4, 4))
        got = tiles.counts(lists.drop("list"), asked, n, 500, 2).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
        assert sorted(map(tuple, tiles.common(lists, asked, n, 500).collect())) == shares
        hits = tiles.hits(lists.drop("list"), n, 500, {1: 5}).withColumn("numbers", F.array_sort("numbers")).groupBy("source", "k").agg(F.array_sort(F.flatten(F.collect_list("numbers"))).alias("x"))
        assert {(r.source, r.k): r.x[:5] if r.k else r.x for r in hits.collect()} == {x: v[:5] if x[1] else v for x, v in met.items() if v}


def test_pairs_that_share_an_origin_are_candidates_without_a_table_of_pairs(spark):
    titles = spark.createDataFrame([(i, f"t{i:02}") for i in range(12)], "id long, title string")
    keys = spark.createDataFrame([(i, 1, "a") for i in range(4)], "id long, rung int, key string")
    edges = spark.createDataFrame([(i, i // 2) for i in range(1, 12)] + [(40, 5)], "child long, parent long")  # 40 has no title
    up = fixpoint.closure(edges)
    for sources in (None, spark.createDataFrame([(3,), (7,)], "id long")):
        want = linkage.candidates(keys, titles, cap=2, neighbours=linkage.lineage_rung(up, titles, sources), sources=sources)
        got = linkage.candidates(keys, titles, cap=2, origins=linkage.lineage_origins(up, titles), sources=sources)
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
        assert got.where("target = 40").count() > 0


def test_labels_of_links_are_the_same_however_often_a_member_comes(spark):
    sets = spark.createDataFrame([(i, m) for i in range(9) for m in range(6) if (i * m) % 4 < 2], "id long, member long")
    links = spark.createDataFrame([(i, j) for i in range(10) for j in range(9) if i < j], "source long, target long")
    labels = spark.createDataFrame([(m, f"l{9 - m}") for m in range(6)], "member long, label string")
    own = lambda i: {m for m in range(6) if i < 9 and (i * m) % 4 < 2}
    want = {(i, j): sorted(f"l{9 - m}" for m in own(i) & own(j))[:3] for i in range(10) for j in range(9) if i < j}
    for often in (1, 4, 256):
        assert {(r.source, r.target): r.x for r in linkage.shared_labels(links, sets, labels, "x", 3, often=often).collect()} == want


def test_signals_that_need_no_sets_write_no_pairs(spark, monkeypatch):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    names, real = [], shared.saved
    monkeypatch.setattr(shared, "saved", lambda df, name: (names.append(name), real(df, name))[1])
    t = lambda n: demo.table(spark, "/root/testdata/sf0.001", n)
    assert catalog._signals(t, ()).select("source", "target", "temporal_overlap").limit(1).count() == 1
    assert "places" in names and not {"candidates", "overlaps"} & set(names)


@pytest.mark.parametrize("often", [0, 256])
def test_parts_of_labels_come_from_the_same_pass(spark, often):
    sets = {1: range(0, 30, 2), 2: range(0, 30, 3), 3: range(40, 50)}
    rows = spark.createDataFrame([(i, m) for i, ms in sets.items() for m in ms] * 2, "id long, member long")  # a repeated row counts once
    labels = spark.createDataFrame([(m, f"m{m:02d}") for m in range(50)], "member long, label string")
    links = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (9, 1)], "source long, target long")
    got = {(r.source, r.target): (r.x, r.tens) for r in linkage.shared_labels(links, rows, labels, "x", 2, often=often, parts={"tens": F.col("member") % 12 == 0}).collect()}
    assert got == {(1, 2): (["m00", "m06"], ["m00", "m12", "m24"]), (2, 1): (["m00", "m06"], ["m00", "m12", "m24"]), (1, 3): ([], []), (9, 1): ([], [])}
