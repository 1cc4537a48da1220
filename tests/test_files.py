import csv
import io
import json
import math
import struct
import wave
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace import cli
from millrace.sources import blockfile, delimited, files, generate, shapefile, writers


def test_block_round_trip(spark, tmp_path):
    cols = [("id", blockfile.INT, 4), ("big", blockfile.INT, 8), ("lat", blockfile.FLOAT, 4), ("x", blockfile.FLOAT, 8), ("name", blockfile.CHAR, 24)]
    rows = [(1, 1 << 40, 0.5, 0.1, "one"), (2, -1, 1.5, -0.1, ""), (None, None, None, None, None)]
    data = blockfile.encode(cols, rows, [("test", "lovely"), ("n", 15), ("long", 1 << 40), ("d", 0.25)])
    a, b = blockfile.decode(data + data)
    assert a == b and a.columns == cols
    assert a.rows == [*rows[:2], (0, 0, 0.0, 0.0, "")]
    assert a.attributes == [("test", "lovely"), ("n", 15), ("long", 1 << 40), ("d", 0.25)]
    (tmp_path / "t.b").write_bytes(data + data)
    df = blockfile.read_blocks(spark, str(tmp_path / "t.b"))
    assert df.count() == 6 and df.where("name = 'one'").select("__block").distinct().count() == 2


@pytest.mark.parametrize("damage, message", [(lambda d: b"\0" * 40 + d[40:], "not a block"), (lambda d: d[:8] + struct.pack("<I", 2) + d[12:], "version"), (lambda d: d[:-1], "cut off"), (lambda d: d[:20], "cut off")])
def test_damaged_blocks(damage, message):
    data = blockfile.encode([("a", blockfile.INT, 4)], [(1,)])
    with pytest.raises(ValueError, match=message):
        list(blockfile.decode(damage(data)))


def test_block_writer(spark, tmp_path):
    spark.dataSource.register(blockfile.BlockDataSource)
    spark.range(10).selectExpr("id", "cast(id as string) t").repartition(2).write.format("block").mode("append").option("path", str(tmp_path / "out")).save()
    assert sorted(r["t"] for r in blockfile.read_blocks(spark, str(tmp_path / "out")).collect()) == [str(k) for k in range(10)]


def test_sniffed_text(spark, tmp_path):
    text = 'made by hand\n# a comment\n\nname;note;n\n"a; b";"two\nlines ""x""";1\nc;;2\n'
    (tmp_path / "t.csv").write_text(text)
    shape = delimited.sniff(text.encode())
    assert (shape.delimiter, shape.header) == (";", ("name", "note", "n"))
    found = sorted((r["name"], r["note"], r["n"]) for r in delimited.read_delimited(spark, str(tmp_path / "t.csv")).collect())
    assert found == [("a; b", 'two\nlines "x"', "1"), ("c", None, "2")]
    assert delimited.encoding_of("﻿a".encode("utf-16")) == "utf-16"
    (tmp_path / "p.txt").write_text("1 2 a\n3 4 a\n5 6 b\n")
    kinds = {(r["id"], r["shape_type"]) for r in delimited.read_points(spark, str(tmp_path / "p.txt")).collect()}
    assert kinds == {("a", "line_strip"), ("b", "points")}
    (tmp_path / "f.csv").write_text("a,b\n1,2\n")
    assert delimited.read_fast(spark, str(tmp_path / "f.csv")).columns == ["a", "b"]


def test_shapefile_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(s, p, k, float(s + x), float(y), s * 10, f"n{s}") for s in (0, 1) for p in (0, 1) for k, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 0)])], "shape_row_id int, shape_part_id int, seq int, x double, y double, n int, name string")
    shapefile.write_shapefile(df, str(tmp_path / "t.shp"), ["n", "name"])
    back = shapefile.read_shapefile(spark, str(tmp_path / "t.shp"))
    assert sorted(back.select("shape_row_id", "shape_part_id", "x", "y", "n", "name").collect()) == sorted(df.select("shape_row_id", "shape_part_id", "x", "y", "n", "name").collect())
    part = shapefile.read_shapefile(spark, str(tmp_path / "t.dbf"), columns=["name"], row_id=1, limit=3)
    assert part.columns[-1] == "name" and part.count() == 3 and part.where("shape_row_id <> 1").count() == 0


def test_svg():
    data = b"""<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 10 10"><clipPath><path d="M0 0L1 1"/></clipPath><g transform="scale(2)"><path fill="#ff0000" d="M1 1 L2 1 l0 1 H0 V0 Q 1 1 3 3 Z"/></g>
    <g id="Labels"><path d="M0 0L1 1"/><text x="4" y="5">hello</text></g></svg>"""
    rows = list(files.parse_svg(data))
    assert [r[3:5] for r in rows[:6]] == [(2, 2), (4, 2), (4, 4), (0, 4), (0, 0), (6, 6)] and rows[0][5:8] == (1.0, 0.0, 0.0)
    assert rows[-1][-1] == "hello" and rows[-1][3:5] == (4.0, 5.0) and len({r[0] for r in rows}) == 2
    assert next(files.parse_svg(data, (0, 0, 100, 100)))[3:5] == (20, 20)


def test_kml(spark, tmp_path):
    df = generate.square(spark).selectExpr("shape_row_id", "shape_part_id", "seq", "x", "y", "1.0D red", "0.0D green", "0.5D blue", "1.0D alpha", "'a<b' name")
    writers.write_kml(df, str(tmp_path / "t.kml"), "name")
    found = files.read_kml(spark, str(tmp_path / "t.kml")).orderBy("seq").collect()
    assert [(r["x"], r["y"]) for r in found] == [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)]
    assert found[0]["name"] == "a<b" and found[0]["red"] == 1.0


def test_dem(spark, tmp_path):
    number = lambda v, n=24: f"{v:.6E}".replace("E", "D").rjust(n).encode()
    head = bytearray(b" " * 1024)
    head[528:546] = b"     3     2     4"
    head[816:852] = number(3.0, 12) + number(3.0, 12) + number(1.0, 12)
    head[858:864] = b"     2"
    body = b""
    for c in (1, 2):
        block = bytearray(b" " * 1024)
        block[0:24] = f"{1:6d}{c:6d}{3:6d}{1:6d}".encode()
        block[24:48], block[48:72], block[72:96] = number(-288000.0 + 3 * (c - 1)), number(154800.0), number(0.0)
        block[144:162] = f"{10 * c:6d}{20 * c:6d}{30 * c:6d}".encode()
        body += bytes(block)
    rows = list(files.parse_dem(bytes(head) + body))
    assert [r[4] for r in rows] == [10, 20, 30, 20, 40, 60] and rows[0][2:4] == (-80.0, 43.0)
    (tmp_path / "t.dem").write_bytes(bytes(head) + body)
    lit = files.elevation_colours(files.read_dem(spark, str(tmp_path / "t.dem")), water=5)
    assert lit.where("red between 0 and 1 and alpha = 1").count() == 6


def _field(number, value):
    if isinstance(value, int):
        return files.to_varint(number << 3) + files.to_varint(value)
    return files.to_varint(number << 3 | 2) + files.to_varint(len(value)) + value


def test_osm(spark, tmp_path):
    packed = lambda values: b"".join(files.to_varint(files.to_zigzag(v)) for v in values)
    plain = lambda values: b"".join(files.to_varint(v) for v in values)
    texts = b"".join(_field(1, t) for t in (b"", b"highway", b"primary"))
    dense = _field(1, packed([5, 1])) + _field(8, packed([436000000, 10])) + _field(9, packed([-794000000, -10])) + _field(10, plain([1, 2, 0, 0]))
    way = _field(1, 9) + _field(2, plain([1])) + _field(3, plain([2])) + _field(8, packed([5, 1, -1]))
    block = _field(1, texts) + _field(2, _field(2, dense)) + _field(2, _field(3, way))
    blob = _field(3, zlib.compress(block))
    head = _field(1, b"OSMData") + _field(3, len(blob))
    data = struct.pack(">I", len(head)) + head + blob
    rows = list(files.parse_osm(data))
    assert rows[0][:2] == ("node", 5) and rows[0][2] == pytest.approx(43.6) and rows[0][3] == pytest.approx(-79.4) and rows[0][5] == ["highway=primary"]
    assert rows[2][:2] == ("way", 9) and rows[2][4] == [5, 6, 5]
    (tmp_path / "t.pbf").write_bytes(data)
    nodes = files.osm_nodes(files.read_osm(spark, str(tmp_path / "t.pbf")))
    assert sorted((r["id"], r["num_ways"]) for r in nodes.collect()) == [(5, 1), (6, 1)]
    assert [files.zigzag(files.to_zigzag(v)) for v in (0, -1, 7)] == [0, -1, 7]


def test_wave():
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes((1000 * np.sin(2 * math.pi * 1000 * np.arange(8000) / 8000)).astype("<i2").tobytes())
    rows = list(files.parse_wave(out.getvalue(), 10))
    assert len(rows) == 10 and rows[0][2] == pytest.approx(1000 / math.sqrt(2), rel=0.01) and rows[0][4] > 0.99


def test_csv_writer(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"', 0.5), (2, "plain", None)], "k int, t string, d double")
    writers.write_csv(df, str(tmp_path / "o.csv"), order=["k"])
    assert (tmp_path / "o.csv").read_text() == '"k","t","d"\n1,"a,""b""",0.500000\n2,plain,\n'


def test_js_writer(spark, tmp_path):
    writers.write_js(generate.square(spark), str(tmp_path / "o.js"), "parks", [("command", 'say "x"')], shapes=True)
    text = (tmp_path / "o.js").read_text()
    block = json.loads(text.removeprefix("var parks = ").rstrip().removesuffix(";"))["blocks"][0]
    assert block["attributes"] == [["command", 'say "x"']] and block["shapes"][0]["parts"][0][0] == [-1.0, -1.0]
    writers.write_js(spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"), str(tmp_path / "r.js"), "t")
    block = json.loads((tmp_path / "r.js").read_text().removeprefix("var t = ").rstrip().removesuffix(";"))["blocks"][0]
    assert sorted(map(str, block["rows"])) == ["[1, 'a']", "[2, None]"]


def test_sql_writer(spark, tmp_path):
    df = spark.createDataFrame([(k, 'q"\\') for k in range(150)], "k int, v string").coalesce(1)
    writers.write_sql(df, str(tmp_path / "o.sql"), "t", drop=True)
    lines = (tmp_path / "o.sql").read_text().splitlines()
    assert lines[0].startswith("DROP") and lines[1].startswith("CREATE") and len(lines) == 4 and '(0,"q\\"\\\\")' in lines[2]


def test_png_writer(spark, tmp_path):
    writers.write_png(generate.circle(spark), str(tmp_path / "o.png"), 64)
    data = (tmp_path / "o.png").read_bytes()
    assert data.startswith(b"\x89PNG") and struct.unpack(">2I", data[16:24]) == (64, 63)


def picture(path):
    data = path.read_bytes()
    w, h = struct.unpack(">2I", data[16:24])
    at, packed = 8, b""
    while at < len(data):
        size = struct.unpack(">I", data[at : at + 4])[0]
        packed += data[at + 8 : at + 8 + size] if data[at + 4 : at + 8] == b"IDAT" else b""
        at += size + 12
    raw = zlib.decompress(packed)
    return [[tuple(raw[y * (3 * w + 1) + 1 + 3 * x :][:3]) for x in range(w)] for y in range(h)]


def test_png_of_tesselated_shapes(spark, tmp_path):
    """From a shapefile to filled triangles, with a hole and the shape's colour."""
    ring = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    hole = [(4, 4), (4, 6), (6, 6), (6, 4), (4, 4)]
    rows = [(0, part, i, float(x), float(y)) for part, r in enumerate((ring, hole)) for i, (x, y) in enumerate(r)]
    df = spark.createDataFrame(rows, "shape_row_id int, shape_part_id int, seq int, x double, y double")
    df.withColumns({c: F.lit(v) for c, v in (("red", 1.0), ("green", 0.0), ("blue", 0.0))}).write.parquet(str(tmp_path / "s.parquet"))
    assert cli.run(spark, f"read {tmp_path}/s.parquet | tesselate | png {tmp_path}/o.png --width=101") is None
    image = picture(tmp_path / "o.png")
    assert image[20][20] == image[80][30] == (255, 0, 0) and image[50][50] == (255, 255, 255)
    shapefile.write_shapefile(df, str(tmp_path / "s.shp"))
    assert cli.run(spark, f"read {tmp_path}/s.shp | tesselate | png {tmp_path}/p.png --width=101") is None
    image = picture(tmp_path / "p.png")
    assert image[20][20] == image[80][30] == (0, 0, 0) and image[50][50] == (255, 255, 255)


def test_png_of_points(spark, tmp_path):
    df = spark.createDataFrame([(k, 0, 0, 1, float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (10, 10), (5, 5), (6, 5)])], "shape_row_id int, shape_part_id int, seq int, shape_part_type int, x double, y double")
    dark = lambda **o: {(x, y) for x, row in enumerate(zip(*(writers.write_png(df, str(tmp_path / "q.png"), 101, **o) or picture(tmp_path / "q.png")))) for y, c in enumerate(row) if c == (0, 0, 0)}
    assert dark() == {(1, 99), (99, 1), (50, 50), (60, 50)}
    assert dark(point_size=3) == {(x + i, y + j) for x, y in ((1, 99), (99, 1), (50, 50), (60, 50)) for i in (-1, 0, 1) for j in (-1, 0, 1)}
    assert dark(zoom=3.0) == {(50, 50), (79, 50)}  # the outer ones are outside now
    assert dark(rotation=90.0) == {(1, 50), (99, 50), (50, 50), (60, 50)}


def test_command_line(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string").write.parquet(str(tmp_path / "t.parquet"))
    found = cli.run(spark, f"read {tmp_path}/t.parquet | filter --column=k --values=2 | unique --column=k --order=v | strcat --columns=k,v --name=both")
    assert [r["both"] for r in found.collect()] == ["2 b"]
    assert cli.run(spark, f"read {tmp_path}/t.parquet | csv {tmp_path}/o.csv --order=v") is None
    assert (tmp_path / "o.csv").read_text().count("\n") == 4
    with pytest.raises(ValueError, match="no such step"):
        cli.run(spark, f"read {tmp_path}/t.parquet | nothing")


def test_feeds(spark, tmp_path):
    from pyspark.sql import functions as F

    from millrace.sources import feeds

    (tmp_path / "c.json").write_text('{"carparks": [{"id": "1", "rate": "2.5", "address": "20 Dundas Street East"}, {"id": "2", "rate": "3", "address": "1 King St. W."}]}')
    df = feeds.read_records(spark, str(tmp_path / "c.json"), "carparks")
    assert dict(df.dtypes) == {"id": "bigint", "rate": "double", "address": "string"}
    assert sorted(r[0] for r in df.select(feeds.short_address(F.col("address"))).collect()) == ["1 King St W", "20 Dundas St E"]
    wkt = 'PROJCS["MTM",GEOGCS["G",DATUM["D",SPHEROID["Clarke",6378206.4,294.9]]], UNIT["Meter",1.0]]'
    assert feeds.parse_wkt(wkt) == ["PROJCS", "MTM", ["GEOGCS", "G", ["DATUM", "D", ["SPHEROID", "Clarke", 6378206.4, 294.9]]], ["UNIT", "Meter", 1.0]]
    (tmp_path / "stops.txt").write_text("stop_id,stop_name\n1,A\n")
    assert feeds.read_transit(spark, str(tmp_path), "stops")["stops"].count() == 1
    df.createOrReplaceTempView("parks_view")
    assert feeds.has(spark, "parks_view", "rate") and not feeds.has(spark, "parks_view", "x") and not feeds.has(spark, "no_such")


def test_a_row_that_repeats_the_header_is_a_row(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for k in range(2):
        (tmp_path / "a" / f"{k}.csv").write_text("a,b\n1,2\na,b\n3,4\n")
    found = delimited.read_delimited(spark, str(tmp_path / "a" / "*.csv")).collect()
    assert sorted((r["a"], r["b"]) for r in found) == [("1", "2")] * 2 + [("3", "4")] * 2 + [("a", "b")] * 2


def test_several_shapefiles_are_read_in_pairs(spark, tmp_path):
    for k in range(2):
        df = spark.createDataFrame([(0, 0, i, float(i + k), 0.0, k) for i in range(3)], "shape_row_id int, shape_part_id int, seq int, x double, y double, n int")
        shapefile.write_shapefile(df, str(tmp_path / f"s{k}.shp"), ["n"], kind=shapefile.ARC)
    found = sorted((r["n"], r["x"]) for r in shapefile.read_shapefile(spark, str(tmp_path / "*.shp")).collect())
    assert found == [(0, 0.0), (0, 1.0), (0, 2.0), (1, 1.0), (1, 2.0), (1, 3.0)]


def test_triangles_are_filled(spark):
    rows = [(0, 0, k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)])]
    df = spark.createDataFrame(rows, "shape_row_id int, shape_part_id int, seq int, x double, y double")
    found, width, height = writers.pixels(df, 100, margin=0.0, fill=True)
    n = found.count()
    assert (width, height) == (100, 100) and abs(n - 5000) < 120 and writers.pixels(df, 100, margin=0.0)[0].count() < 400


def test_pipeline_of_shapes(spark, tmp_path):
    found = cli.run(spark, "generate --shape=square | clip --ring=0,-2,2,-2,2,2,0,2 | bbox-polygon --by=shape_row_id").collect()
    assert {(r["x"], r["y"]) for r in found} == {(0.0, -1.0), (1.0, -1.0), (1.0, 1.0), (0.0, 1.0)}
    assert cli.run(spark, "generate --shape=square | tesselate").count() == 6
    assert cli.run(spark, "generate | highlight --i=3").count() == 63
    assert cli.run(spark, "generate --n=100 | dump --order=seq").count() == 27
    assert cli.run(spark, "generate | winding --direction=cw | along").count() == 50


def test_table_changes(spark):
    df = spark.createDataFrame([(1, 2, "x", 1.5)], "a long, b int, c string, d double")
    assert writers.table_changes(df, "t", {"a": "int", "b": "int", "d": "varchar(255)"}) == [
        "ALTER TABLE `t` MODIFY COLUMN `a` bigint;", "ALTER TABLE `t` ADD COLUMN `c` varchar(255);"
    ]


def test_empty_evolution(spark, tmp_path):
    path = str(tmp_path / "grown")
    writers.append_evolving(spark.createDataFrame([], "a int"), path)
    back = writers.append_evolving(spark.createDataFrame([(1, "n")], "a int, b string"), path)
    assert [tuple(r) for r in back.select("a", "b").collect()] == [(1, "n")]


def test_one_block_file_is_several_tasks(spark, tmp_path, request):
    cols = [("id", blockfile.INT, 4), ("big", blockfile.INT, 8), ("u", blockfile.UINT, 4), ("f", blockfile.FLOAT, 4), ("x", blockfile.FLOAT, 8), ("name", blockfile.CHAR, 12)]
    rows = [(k, k << 33, 4_000_000_000 + k, k / 2, k / 7, f"é{k}" if k % 3 else "") for k in range(5000)]
    data = blockfile.encode(cols, rows[:1200]) + blockfile.encode(cols, []) + blockfile.encode(cols, rows[1200:], [("a", 1)])
    (tmp_path / "t.b").write_bytes(data)
    df = blockfile.read_blocks(spark, str(tmp_path / "t.b"), 20_000)
    assert df.rdd.getNumPartitions() > 5
    found = sorted(df.collect(), key=lambda r: r["id"])
    assert [tuple(r)[:6] for r in found] == [tuple(r) for r in rows]
    assert [(r["__block"], r["__row"]) for r in found] == [(0, k) for k in range(1200)] + [(2, k) for k in range(3800)]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.python.filterPushdown.enabled"))
    df = blockfile.read_blocks(spark, str(tmp_path / "t.b"), 20_000)
    few = df.where("id >= 1190 and id < 1210 and name <> ''").select("id", "__row")
    assert sorted(tuple(r) for r in few.collect()) == [(k, k if k < 1200 else k - 1200) for k in range(1190, 1210) if k % 3]
    whole = blockfile.read_whole_blocks(spark, str(tmp_path / "t.b")).collect()
    assert sorted(tuple(r)[:6] for r in whole) == sorted(tuple(r)[:6] for r in found)


def test_writer_cuts_long_partitions_into_blocks(spark, tmp_path, monkeypatch):
    spark.dataSource.register(blockfile.BlockDataSource)
    spark.range(70_000).coalesce(1).write.format("block").mode("append").save(str(tmp_path / "o"))
    df = blockfile.read_blocks(spark, str(tmp_path / "o"))
    assert df.count() == df.select("id").distinct().count() == 70_000 and df.select("__block").distinct().count() == 2
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.b").write_bytes(b"nothing")
    with pytest.raises(Exception, match="block cut off"):
        blockfile.read_blocks(spark, str(tmp_path / "bad"))


def test_shapefile_of_many_ranges(spark, tmp_path):
    rows = [(k, p, i, float(k + i), float(-p), k if k % 3 else None, f"n{k}") for k in range(40) for p in range(1 + k % 2) for i in range(3 + k % 5)]
    df = spark.createDataFrame(rows, "shape_row_id int, shape_part_id int, seq int, x double, y double, n long, t string").repartition(7)
    shapefile.write_shapefile(df, str(tmp_path / "m.shp"), ["n", "t"])
    shp, shx, dbf = ((tmp_path / f"m.{e}").read_bytes() for e in ("shp", "shx", "dbf"))
    at, sizes = 100, []
    for k in range(40):
        number, words = struct.unpack_from(">2I", shp, at)
        assert number == k + 1 and struct.unpack_from(">2I", shx, 100 + 8 * k) == (at // 2, words)
        at += 8 + 2 * words
        sizes.append(words)
    assert at == len(shp) == 2 * struct.unpack_from(">I", shp, 24)[0] and len(shx) == 100 + 8 * 40 and struct.unpack_from("<4d", shp, 36) == (0.0, -1.0, 45.0, 0.0)
    assert shapefile.read_dbf(dbf)[1] == [(k if k % 3 else None, f"n{k}") for k in range(40)] and dbf.endswith(b"\x1a")
    back = shapefile.read_shapefile(spark, str(tmp_path / "m.shp")).orderBy("seq").collect()
    assert [(r["shape_row_id"], r["shape_part_id"], r["x"], r["y"]) for r in back] == [(r[0], r[1], r[3], r[4]) for r in rows]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["m.dbf", "m.shp", "m.shx"]
    cut = shapefile.read_shapefile(spark, str(tmp_path / "m.shp"), most=700).withColumn("task", F.spark_partition_id()).orderBy("seq").collect()
    assert [r["seq"] for r in cut] == list(range(len(rows))) and [(r["shape_row_id"], r["x"], r["n"], r["t"]) for r in cut] == [(r[0], r[3], r[5], r[6]) for r in rows]
    assert len({r["task"] for r in cut}) > 3
    second = [r for r in rows if r[1] == 1]
    (tmp_path / "m.shx").unlink()
    part = shapefile.read_shapefile(spark, str(tmp_path / "m.shp"), columns=["t"], part_id=1, limit=9, most=300).orderBy("seq").collect()
    assert [(r["seq"], r["shape_row_id"], r["x"], r["t"]) for r in part] == [(k, r[0], r[3], r[6]) for k, r in enumerate(second[:9])] and "n" not in part[0]


def test_empty_single_files(spark, tmp_path):
    none = spark.createDataFrame([], "shape_row_id int, shape_part_id int, seq int, x double, y double")
    shapefile.write_shapefile(none, str(tmp_path / "e.shp"))
    assert [len((tmp_path / f"e.{e}").read_bytes()) for e in ("shp", "shx", "dbf")] == [100, 100, 34]
    writers.write_csv(none, str(tmp_path / "e.csv"), quotes=False)
    assert (tmp_path / "e.csv").read_text() == "shape_row_id,shape_part_id,seq,x,y\n"
    writers.write_js(none, str(tmp_path / "e.js"), "e")
    assert (tmp_path / "e.js").read_text().endswith('"rows": [\n]\n}]\n};\n')


def test_parts_are_joined_in_order(spark, tmp_path):
    df = spark.range(0, 5000, 1, 13).selectExpr("id k", "repeat('x', cast(id % 90 as int)) v")
    writers.write_csv(df, str(tmp_path / "o.csv"), quotes=False, order=["k"])
    assert (tmp_path / "o.csv").read_text() == "k,v\n" + "".join(f"{k},{'x' * (k % 90)}\n" for k in range(5000))
    writers.write_js(df.select("k"), str(tmp_path / "o.js"), "o")
    text = (tmp_path / "o.js").read_text()
    assert json.loads(text[text.index("{") : text.rindex("}") + 1])["blocks"][0]["rows"] == [[k] for k in range(5000)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_file_with_quoted_line_breaks_is_several_tasks(spark, tmp_path, end):
    rows = [[str(k), ["plain", 'a "quoted" one', f"two{end}lines, {k}", f'"{end}"{end}', "", '5" pipe', f"{end}" * 50][k % 7], f"t{k}" * (k % 11)] for k in range(9000)]
    text = io.StringIO(newline="")
    csv.writer(text, lineterminator=end).writerows([["k", "v", "w"], *rows])
    text.write(f"9000,{'long' * 60000}{end}9001,5\" pipe,stray{end}{end}9002,\"{f'1{end}' * 70000}\",end{end}9003,last,one")
    (tmp_path / "q.csv").write_bytes(text.getvalue().encode())
    df = delimited.read_delimited(spark, str(tmp_path / "q.csv"), 20_000)
    found = sorted(((int(r["k"]), r["v"] or "", r["w"] or "") for r in df.collect()))
    plain = lambda t: t.replace("\r\n", "\n")
    wanted = [(int(k), plain(v), w) for k, v, w in rows] + [(9000, "long" * 60000, ""), (9001, '5" pipe', "stray"), (9002, "1\n" * 70000, "end"), (9003, "last", "one")]
    assert found == wanted
    assert df.rdd.getNumPartitions() > 10
    whole = delimited._read_whole(spark, str(tmp_path / "q.csv"), delimited.sniff(text.getvalue().encode()[:5000]), 1)
    assert sorted((int(r["k"]), plain(r["v"] or ""), r["w"] or "") for r in whole.collect()) == wanted


@given(st.text(alphabet='a",\n\r', max_size=60), st.integers(0, 60))
def test_quote_states_at_any_cut(text, cut):
    """Two spans, the second in the state that the first ends in, give the record ends of the whole."""
    data = text.encode()
    k = data.find(b"\n", cut) + 1
    ends, last = delimited.record_ends(data, False, ",")
    first, state = delimited.record_ends(data[:k], False, ",")
    second, end = delimited.record_ends(data[k:], state, ",")
    assert [*first.tolist(), *(second + k).tolist()] == ends.tolist() and end == last


def test_one_osm_file_is_several_tasks(spark, tmp_path):
    nodes = [("node", k, 40 + k / 1000, -79 - k / 1000, None) for k in range(20)]
    ways = [("way", 100 + k, None, None, [k, k + 1, k]) for k in range(19)]
    header = bytearray(files.osm_blob([])).replace(b"\n\x07OSMData", b"\n\x09OSMHeader")  # a blob of another kind is passed over
    header[3] += 2
    (tmp_path / "t.pbf").write_bytes(bytes(header) + b"".join(files.osm_blob(x) for x in (nodes[:9], nodes[9:] + ways[:5], ways[5:])))
    df = files.read_osm(spark, str(tmp_path / "t.pbf"), 1)
    found = df.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r["id"] for r in found) == [*range(20), *range(100, 119)] and len({r["task"] for r in found}) == 3
    assert {(r["id"], round(r["lat"], 6), round(r["lon"], 6)) for r in found if r["kind"] == "node"} == {(i, round(a, 6), round(b, 6)) for _, i, a, b, _ in nodes}
    assert {(r["id"], tuple(r["refs"])) for r in found if r["kind"] == "way"} == {(i, tuple(r)) for _, i, _, _, r in ways}
    assert files.read_osm(spark, str(tmp_path / "t.pbf")).count() == 39
    (tmp_path / "c.pbf").write_bytes((tmp_path / "t.pbf").read_bytes()[:-3])
    with pytest.raises(Exception, match="blob cut off"):
        files.read_osm(spark, str(tmp_path / "c.pbf")).count()


def test_large_inputs_are_read_in_ranges_for_the_cores():
    """The number of tasks does not grow with the input for ever, and small inputs keep the ranges asked for."""
    from millrace.sources.blockfile import RANGE_BYTES, RANGES, paced

    assert paced(1 << 20, 1 << 14, 4) == 1 << 14 and paced(0, 5, 0) == 5
    for total in (10 << 20, 400 << 20, 3 << 30):
        assert total / paced(total, 1 << 14, 12) <= max(RANGES * 12 + 12, total / RANGE_BYTES[1]) * (4 if total < 20 << 20 else 1) * 2
    assert paced(1 << 40, 1 << 14, 12) == RANGE_BYTES[1] and paced(1 << 40, 64 << 20, 12) == 64 << 20


def test_a_large_file_of_small_spans_is_read_whole(spark, tmp_path, monkeypatch):
    from millrace.sources import blockfile, delimited

    monkeypatch.setattr(blockfile, "RANGE_BYTES", (64, 4096))
    text = "a,b\n" + "".join(f'{k},"x\n""{k}"\n' for k in range(20000))
    (tmp_path / "t.csv").write_text(text)
    df = delimited.read_delimited(spark, str(tmp_path / "t.csv"), 16)
    assert df.rdd.getNumPartitions() <= len(text) / 4096 + 2
    assert sorted((int(r["a"]), r["b"]) for r in df.collect()) == [(k, f'x\n"{k}') for k in range(20000)]


def test_shapefile_vertices_are_counted_by_heads(spark, tmp_path):
    """The heads give as many vertices as the parsed records, and a shape's pieces from several frames are one record."""
    from millrace.sources import shapefile

    rows = [(k, p, i, float(i % 5), float(k), f"n{k}") for k in range(40) for p in range(1 + k % 3) for i in range(2 + k % 7)]
    df = spark.createDataFrame(rows, "shape_row_id int, shape_part_id int, seq int, x double, y double, name string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for kind in (shapefile.POINT, shapefile.MULTIPOINT, shapefile.ARC, shapefile.POLYGON):
            stem = f"{tmp_path}/s{kind}"
            shapefile.write_shapefile(df, f"{stem}.shp", ["name"], kind=kind)
            data = open(f"{stem}.shp", "rb").read()
            parsed = [len(v) for _, _, parts in shapefile.read_shp(data) for v in parts]
            assert shapefile._vertices(stem, 100, len(data)) == sum(parsed) == (40 if kind == shapefile.POINT else len(rows))
            back = shapefile.read_shapefile(spark, f"{stem}.shp", most=200).groupBy("name").count().collect()
            assert len(back) == 40 and sum(r["count"] for r in back) == sum(parsed)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_shapefile_index_beyond_four_gigabytes(tmp_path, monkeypatch):
    """Offsets are unsigned words of two bytes, so ranges go on behind 4 GB; the index is read some entries at a time."""
    stem, size, each = str(tmp_path / "big"), 6 << 30, 300 << 20
    at = list(range(100, size - each, each))
    end = at[-1] + each
    with open(f"{stem}.shp", "wb") as f:  # sparse: null shapes, then a point
        f.write(struct.pack(">7I", 9994, 0, 0, 0, 0, 0, (end + 28) // 2))
        f.seek(end)
        f.write(struct.pack(">2I", len(at) + 1, 10) + struct.pack("<I2d", shapefile.POINT, 1.5, 2.5))
    with open(f"{stem}.shx", "wb") as f:
        f.write(bytes(100) + b"".join(struct.pack(">2I", p // 2, each // 2 - 4) for p in at) + struct.pack(">2I", end // 2, 10))
    for entries in (1, 4, 1 << 20):
        monkeypatch.setattr(shapefile, "INDEX_ENTRIES", entries, raising=False)
        found = list(shapefile.shape_extents(stem, 700 << 20))
        assert all(high - low <= 700 << 20 for _, low, high in found) and len(found) == len(at) // 2
        assert [low for _, low, _ in found] == [[*at, end][k] for k, _, _ in found] and [high for *_, high in found] == [*[low for _, low, _ in found[1:]], end + 28]
    assert list(shapefile._range(stem, end, end + 28, len(at))) == [(len(at), shapefile.POINT, [[(1.5, 2.5)]])]
