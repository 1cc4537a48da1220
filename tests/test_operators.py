import math

import pytest
from pyspark.sql import functions as F

from millrace.operators import aggregates, changes, columns, joins, rows, sequences, serving, shapes
from millrace.sources import generate


def values(df, *names):
    return sorted(tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect())


def test_filter(spark):
    df = spark.createDataFrame([(k,) for k in range(1, 6)], "v int")
    assert values(rows.filter_equal(df, "v", [2, 4]), "v") == [2, 4]
    assert values(rows.filter_equal(df, "v", [2, 4], keep=False), "v") == [1, 3, 5]
    near = spark.createDataFrame([(1.0,), (1.0000005,), (1.000002,), (None,)], "v double")
    assert values(rows.filter_equal(near, "v", [1]), "v") == [1.0, 1.0000005]
    assert rows.filter_equal(near, "v", [1], keep=False).count() == 2


def test_bbox_edges(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (1.1, 1.0)], "x double, y double")
    assert rows.filter_bbox(df, 0, 1, 0, 1).count() == 2
    assert rows.filter_bbox(df, 0, 1, 0, 1, strict=True).count() == 0


def test_thin(spark):
    df = spark.createDataFrame([("a", k, x, 0.0) for k, x in enumerate((0.0, 1e-7, 2e-7, 1.0))], "id string, seq int, x double, y double")
    packed = df.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p")).select(rows.thin(F.col("p"), 1e-6).alias("p"))
    assert [p["x"] for p in packed.first()["p"]] == [0.0, 1.0]
    assert values(shapes.thin_parts(df, ["id"], "seq", 1e-6), "x") == [0.0, 1.0]
    none = spark.range(1).select(rows.thin(F.array().cast("array<struct<x:double,y:double>>"), 1.0).alias("p"))
    assert none.first()["p"] == []


def test_unique(spark):
    df = spark.createDataFrame(list(zip("babca", range(1, 6))), "k string, v int")
    assert values(rows.unique_first(df, "k", ["v"]), "v") == [1, 2, 4]
    assert values(rows.unique_first(df, "k", ["v"], last=True), "v") == [3, 4, 5]


def test_append(spark):
    a, b = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(2, "b")], "n int, t string")
    assert rows.append(a, b).columns == ["k", "v"] and rows.append(a, b).count() == 2
    with pytest.raises(ValueError, match="columns differ"):
        rows.append(a, spark.range(1))


@pytest.mark.parametrize("how, n", [("inner", 4), ("left", 6), ("right", 5)])
def test_join(spark, how, n):
    left = spark.createDataFrame([(1,), (2,), (2,), (3,)], "k int")
    right = spark.createDataFrame([(2, "a"), (2, "b"), (4, "c")], "k int, v string")
    assert joins.join_tables(left, right, "k", "k", how).count() == n


def test_lookup(spark):
    right = spark.createDataFrame([("x", 1), ("x", 2), ("", 3), (None, 4)], "k string, v int")
    left = spark.createDataFrame([("x",), ("",), ("z",)], "l string")
    assert [r["f"] for r in joins.lookup(left, right, "l", "k", {"v": "f"}, ["v"]).orderBy(F.desc("l")).collect()] == [None, 1, None]
    assert joins.lookup(left, right, "l", "k", {"v": "f"}, ["v"], last=True).where("l = 'x'").first()["f"] == 2
    assert joins.lookup_fallback(left, right.withColumn("j", F.lit("z")), "l", "k", "j", "v", "f", ["v"]).where("l = 'z'").first()["f"] == 1


def test_point_in_triangle(spark):
    t = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 0.0, 0.0, 4.0), (2, 0.0, 0.0, 4.0, 0.0, 0.0, 4.0)], "o int, ax double, ay double, bx double, by double, cx double, cy double")
    p = spark.createDataFrame([(0.0, 0.0), (2.0, 0.0), (1.0, 1.0)], "x double, y double")
    found = joins.point_in_triangle(p, t, "o", 1.0).orderBy("y", "x").collect()
    assert [(r["hits"], r["hit"]) for r in found] == [(0, None), (0, None), (2, 1)]


def test_nearest_far_and_empty(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 1000.0, 0.0)], "a int, x double, y double")
    b = spark.createDataFrame([(7, 1.0, 0.0), (6, -1.0, 0.0)], "b int, x double, y double")
    assert values(joins.nearest(a, b, "a", "b", 0.5), "a", "nearest") == [(1, 6), (2, 7)]
    assert joins.nearest(a, b.limit(0), "a", "b", 0.5).count() == 0
    assert joins.nearest(a.limit(1), a.limit(1), "a", "a", 0.5, same_layer=True).count() == 0


def test_snap(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0), (2, 0.0, 5.0, 0.0, 5.0)], "segment_id int, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([(1, 3.0, 1.0), (2, -1.0, 0.0), (3, 50.0, 50.0), (4, 0.5, 5.0)], "id int, x double, y double")
    found = {r["id"]: r for r in joins.snap_to_segments(p, s, "id", 2.0, 1.0).collect()}
    assert (found[1]["snapped_x"], found[1]["distance"]) == (3.0, 1.0)
    assert found[2]["snapped_x"] == 0.0 and found[3]["segment_id"] is None and found[4]["segment_id"] == 2


def test_snap_to_long_diagonals(spark):
    """A segment is dealt to the cells along it, and no point in reach is missed, whatever its slope."""
    import random

    rng = random.Random(7)
    place = lambda: rng.uniform(-40, 40)
    ends = [(k, place(), place(), place(), place()) for k in range(12)] + [(12, 3.0, -40.0, 3.0, 40.0), (13, -40.0, 5.0, 40.0, 5.0), (14, 40.0, 40.0, -40.0, -40.0), (15, 1.0, 1.0, 1.0, 1.0)]
    s = spark.createDataFrame(ends, "segment_id int, x1 double, y1 double, x2 double, y2 double")
    own = [(k, place(), place()) for k in range(600)] + [(600, 4.5, 0.0), (601, 0.0, 6.5), (602, -41.5, 5.0)]
    p = spark.createDataFrame(own, "id int, x double, y double")

    def gap(x, y, x1, y1, x2, y2):
        n = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / n)) if n else 0.0
        return ((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2) ** 0.5

    wanted = {}
    for i, x, y in own:
        d, k = min((gap(x, y, *e[1:]), e[0]) for e in ends)
        wanted[i] = k if d <= 1.5 else None
    assert {r["id"]: r["segment_id"] for r in joins.snap_to_segments(p, s, "id", 1.5, 1.0).collect()} == wanted


def test_move_to_street(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0, "KING ST"), (2, 0.0, 1.0, 10.0, 1.0, "SPADINA AVE")], "segment_id int, x1 double, y1 double, x2 double, y2 double, street string")
    p = spark.createDataFrame([(1, 3.0, 0.4, "SPADINA AVE"), (2, 4.0, 0.0, "KING ST"), (3, 5.0, 9.0, None), (4, 6.0, 0.9, None)], "id int, x double, y double, street string")
    found = {r["id"]: r for r in joins.move_to_street(p, s, "id", 2.0, 1.0, "street").collect()}
    assert (found[1]["x"], found[1]["y"], found[1]["segment_id"], found[1]["road_width"]) == (3.0, 1.0, 2, 0.0004) and found[1]["angle"] == pytest.approx(-math.pi / 2)
    assert (found[2]["angle"], found[2]["road_width"]) == (0.0, 0.0002)
    assert (found[3]["x"], found[3]["y"], found[3]["segment_id"], found[3]["angle"]) == (5.0, 9.0, None, 0.0)
    assert (found[4]["y"], found[4]["segment_id"], found[4]["road_width"]) == (1.0, 2, 0.0002)


def test_histograms(spark):
    h = spark.createDataFrame([([0, 5, 200],)], "s array<int>").select(aggregates.as_printable(F.col("s")).alias("p"), aggregates.as_symbols(F.col("s")).alias("y")).first()
    assert h["p"] == " %~" and h["y"] == "  #"
    m = spark.createDataFrame([(" %~", "!! ")], "a string, b string").select(aggregates.merge_printable(F.col("a"), F.col("b"))).first()[0]
    assert m == "!&~"
    day = spark.createDataFrame([("a" * 48, "b" * 48), (None, None)], "p string, t string").select(aggregates.next_slots(F.col("p"), F.col("t"), 46).alias("n"))
    assert [r["n"] for r in day.collect()] == ["aabbbb", " " * 6]


def test_orient(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    df = spark.createDataFrame([("ccw", k, *p) for k, p in enumerate(ring)] + [("cw", k, *p) for k, p in enumerate(ring[::-1])], "id string, seq int, x double, y double")
    turned = sequences.orient(df, ["id"], "seq", "cw")
    areas = {r["id"]: r["area"] for r in sequences.signed_area(turned, ["id"], ["seq"]).collect()}
    assert areas == {"ccw": 1.0, "cw": 1.0}


def test_changes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    log = [{"id": 1, "filename": "f", "search_fields": {"v": "a"}, "update_fields": {"v": "b"}}, {"id": 2, "filename": "f", "search_fields": {"v": "b"}, "update_fields": {"w": "x"}}]
    assert values(changes.replay(df, log, "f"), "id", "v", "w") == [(1, "b", "x"), (2, "b", "x")]
    with pytest.raises(ValueError, match="not supported"):
        changes.replay(df, [{**log[0], "operation": "delete"}], "f")


def test_normalize_of_one_value_is_null(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert [r["v"] for r in columns.normalize(df, ["v"]).collect()] == [None, None]


def test_colours(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0), (0.5, 0.5, 0.5)], "red double, green double, blue double")
    assert values(columns.replace_colours(df, [((1, 0, 0), (0, 0, 1))]), "red", "blue") == [(0.0, 1.0), (0.5, 0.5)]
    a, b = (columns.random_colours(spark.range(5), 4).orderBy("id").collect() for _ in range(2))
    assert a == b and all(0 <= r["red"] < 1 for r in a)


def test_generators(spark):
    ring = generate.circle(spark, 2).orderBy("seq").collect()
    assert len(ring) == 3 and ring[0]["x"] == 1.0
    assert values(generate.square(spark), "x", "y") == [(-1.0, -1.0), (-1.0, 1.0), (1.0, -1.0), (1.0, 1.0)]
    assert generate.random_points(spark, 20, 1).where("x between 0 and 1").count() == 20
    assert generate.tiles(spark, 0, 0, 10, 5, 2.5).count() == 8 and generate.marker(spark, 0, 0, 1).count() == 4


def test_round_up():
    assert [serving.round_up(m) for m in (0, 29, 30, 44, 45, 1439)] == [0, 0, 1, 1, 2, 0]


def test_insert_rows(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "__row long, v string")
    out = rows.insert_rows(df, spark.createDataFrame([(0, "x")], "__row long, v string"), 1)
    assert [r["v"] for r in out.orderBy("__row").collect()] == ["a", "x", "b"]


def test_nearest_ends_with_points_that_are_nowhere(spark):
    rows = [(1, 0.0, 0.0), (2, 1.0, 0.0), (3, float("nan"), 0.0), (4, float("inf"), 1.0), (5, None, 2.0)]
    p = spark.createDataFrame(rows, "i int, x double, y double")
    assert sorted((r["i"], r["nearest"]) for r in joins.nearest(p, p, "i", "i", 0.5, same_layer=True).collect()) == [(1, 2), (2, 1)]


def test_own_street_comes_first(spark):
    """Null names have no own street; beyond the reach nothing is found; an empty layer leaves points as they are."""
    p = spark.createDataFrame([(1, 0.5, 0.1, "a"), (2, 0.5, 0.1, None), (3, 0.5, 9.0, "a"), (4, 0.5, 0.1, "c")], "id int, x double, y double, street string")
    s = spark.createDataFrame([(10, 0.0, 0.0, 1.0, 0.0, "b"), (11, 0.0, 0.4, 1.0, 0.4, "a"), (12, 0.0, 0.0, 1.0, 0.0, None)], "segment_id int, x1 double, y1 double, x2 double, y2 double, street string")
    found = joins.snap_to_segments(p, s, "id", 0.5, 0.5, prefer="street")
    assert {r["id"]: r["segment_id"] for r in found.collect()} == {1: 11, 2: 10, 3: None, 4: 10}
    assert {r["segment_id"] for r in joins.snap_to_segments(p, s.where("false"), "id", 0.5, 0.5, prefer="street").collect()} == {None}


def test_highlighted_vertices(spark):
    v = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 10.0, 0.0), (1, 2, 10.0, 5.0), (2, 0, 3.0, 3.0)], "shape int, seq_id int, x double, y double")
    places = lambda which: sorted({(r["shape"], r["seq_id"]) for r in sequences.highlight_vertices(v, ["shape"], "seq_id", which).collect()})
    assert places("ends") == [(1, 0), (1, 2), (2, 0)] and places("all") == [(1, 0), (1, 1), (1, 2), (2, 0)] and places(1) == [(1, 1)] and places(9) == []
    first = sequences.highlight_vertices(v, ["shape"], "seq_id", 0).where("shape = 1 and seq = 0").first()
    assert (first["x"], first["y"]) == (0.5, 0.0)


def test_nearest_with_outliers(spark):
    import random

    rng = random.Random(6)
    rows = [(k, rng.uniform(-1, 1), rng.uniform(-1, 1)) for k in range(120)] + [(200, 1e4, 3.0), (201, -5e3, -2e4), (202, 1e4 + 3, 3.0), (203, 0.0, 7.0)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    near = lambda a, others: min((math.hypot(a[1] - b[1], a[2] - b[2]), b[0]) for b in others)
    found = {r["id"]: (r["distance"], r["nearest"]) for r in joins.nearest(df, df, "id", "id", 0.01, same_layer=True).collect()}
    assert found.keys() == {r[0] for r in rows}
    for a in rows:
        assert found[a[0]] == pytest.approx(near(a, [b for b in rows if b[0] != a[0]]))
    few = df.where("id % 40 = 0").select(F.col("id").alias("other"), "x", "y")
    found = {r["id"]: (r["distance"], r["nearest"]) for r in joins.nearest(df, few, "id", "other", 0.05).collect()}
    for a in rows:
        assert found[a[0]] == pytest.approx(near(a, [b for b in rows if b[0] % 40 == 0]))


def test_refresh_of_one_key_leaves_the_others(spark, tmp_path):
    df = spark.createDataFrame([(k, k % 3, float(k)) for k in range(12)], "id int, line int, x double")
    path = str(tmp_path / "lines")
    df.write.partitionBy("line").parquet(path)
    files = lambda k: sorted(p.name for p in (tmp_path / "lines" / f"line={k}").glob("*.parquet"))
    before = {k: files(k) for k in range(3)}
    now = serving.refresh_key(df.withColumn("x", F.col("x") * 10), path, ["line"], 1)
    assert {r["id"]: r["x"] for r in now.collect()} == {k: k * 10.0 if k % 3 == 1 else float(k) for k in range(12)}
    assert files(0) == before[0] and files(2) == before[2] and files(1) != before[1]
    assert {r["line"] for r in serving.refresh_key(df.where("line <> 2"), path, ["line"], 2).collect()} == {0, 1} and files(0) == before[0]


def test_crowded_layers_meet_on_small_cells(spark):
    """Points and segments that all lie within one cell of the caller's are not all paired; a far point still looks as far as it may."""
    import random

    rng = random.Random(11)
    ends = [(k, *(rng.uniform(0, 0.9) for _ in range(4)), k % 3) for k in range(400)]
    own = [(k, rng.uniform(0, 0.9), rng.uniform(0, 0.9), k % 4) for k in range(400)] + [(400, 0.5, 1.7, 0), (401, -0.95, 0.4, 1), (402, 5.0, 5.0, 2)]
    s = spark.createDataFrame(ends, "segment_id int, x1 double, y1 double, x2 double, y2 double, street int")
    p = spark.createDataFrame(own, "id int, x double, y double, street int")
    assert joins.crowding(p, 1.0)[0] > 300 > 10 > joins.crowding(p, 1.0)[5]
    at = p.select("street", F.col("id").alias("__p"), "x", "y")
    assert joins.crowding(at, 1.0, ["street"])[0] < 110

    def gap(x, y, x1, y1, x2, y2):
        n = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / n)) if n else 0.0
        return ((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2) ** 0.5

    for prefer in (None, "street"):
        wanted = {}
        for i, x, y, street in own:
            d = [(bool(prefer) and e[5] != street, gap(x, y, *e[1:5]), e[0]) for e in ends]
            wanted[i] = min((v for v in d if v[1] <= 1.0), default=(0, 0, None))[2]
        found = joins.snap_to_segments(p, s, "id", 1.0, 1.0, prefer=prefer)
        assert {r["id"]: r["segment_id"] for r in found.collect()} == wanted
    assert wanted[402] is None and wanted[400] is not None


def test_thin_axes_have_their_own_limits(spark):
    """Values that differ by exactly 40 are not near at a limit of 40; a scaled axis would round some of them to nearer."""
    pairs = [(k, a / 100, (a + 4000) / 100) for k, a in enumerate(range(1, 4000, 7))]
    df = spark.createDataFrame([(k, i, 0.0, y) for k, *ys in pairs for i, y in enumerate(ys)], "id int, seq int, x double, y double")
    packed = df.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p")).select("id", F.size(rows.thin(F.col("p"), 2.0, tall=40.0)).alias("n"))
    found = {r["id"]: r["n"] for r in packed.collect()}
    assert found == {k: 1 + (abs(b - a) >= 40) for k, a, b in pairs}
    assert any((abs(b / 20 - a / 20) >= 2) != (abs(b - a) >= 40) for _, a, b in pairs)


def test_copies_for_shared_keys_shuffle_no_pairs(spark):
    """The pairs of owners are made under the shared key, in the join that makes the copies, and not before it."""
    owners = spark.createDataFrame([(k, k % 2) for k in range(6)] + [(9, None)], "id int, key int")
    rows_ = spark.createDataFrame([(100, 0), (101, 1), (102, 1), (103, 9), (104, 77)], "r int, id int")
    found = joins.duplicate_for_shared_key(rows_, owners, "id", "key", "id")
    wanted = [(r, i) for r, i in ((100, 0), (101, 1), (102, 1), (103, 9), (104, 77))]
    wanted += [(r, o) for r, i in ((100, 0), (101, 1), (102, 1)) for o in range(6) if o % 2 == i % 2 and o != i]
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "__key" in next(line for line in plan.splitlines() if "Join" in line)  # the outermost join is under the shared key


def test_copies_for_many_owners_are_cut_in_blocks(spark, tmp_path, monkeypatch):
    """A key of thousands of owners: every copy is there once, and a file of them repeats itself within short distances."""
    owners = spark.range(4000).selectExpr("id * 7919 as own", "if(id < 3000, 1, id) as key")
    rows_ = spark.range(300).selectExpr("id as r", "id % 150 * 7919 as own")
    found = joins.duplicate_for_shared_key(rows_, owners, "own", "key", "own")
    found.write.parquet(str(tmp_path / "copies"))
    back = spark.read.parquet(str(tmp_path / "copies"))
    assert back.count() == back.distinct().count() == 300 * 3000 and back.agg(F.sum("own")).first()[0] == 300 * 7919 * sum(range(3000))
    assert sum(f.stat().st_size for f in (tmp_path / "copies").glob("*.parquet")) < 0.6 * 300 * 3000
    monkeypatch.setattr(joins, "BLOCKS", (8, 5))
    cut = joins.duplicate_for_shared_key(rows_, owners, "own", "key", "own")
    assert cut.exceptAll(back).isEmpty() and back.exceptAll(cut).isEmpty()


def test_nearest_of_crowds_and_copies(spark):
    """Many points within one cell and many at one place are not all paired: places are one row each, cells shrink."""
    import random

    rng = random.Random(3)
    rows_ = [(k, rng.uniform(0, 1e-3), rng.uniform(0, 1e-3)) for k in range(300)] + [(1000 + k, 0.5, 0.5) for k in range(300)] + [(2000, 7.0, 7.0), (2001, 7.0, 8.0), (2002, 7.0, 7.0)]
    df = spark.createDataFrame(rows_, "id int, x double, y double")
    found = {r["id"]: (r["nearest"], r["distance"]) for r in joins.nearest(df, df, "id", "id", 1.0, same_layer=True).collect()}
    wanted = lambda a, others: min((math.hypot(a[1] - b[1], a[2] - b[2]), b[0]) for b in others)
    for a in rows_:
        d, k = wanted(a, [b for b in rows_ if b[0] != a[0]])
        assert found[a[0]][0] == k and found[a[0]][1] == pytest.approx(d)
    other = df.where("id % 50 = 0").select(F.col("id").alias("o"), "x", "y")
    found = {r["id"]: r["nearest"] for r in joins.nearest(df, other, "id", "o", 1.0).collect()}
    assert found == {a[0]: wanted(a, [b for b in rows_ if b[0] % 50 == 0])[1] for a in rows_}
    assert joins.crowding(df, 1.0)[0] > 250 and joins.crowding(df.where("id < 300"), 1.0)[-1] < joins.CROWD
