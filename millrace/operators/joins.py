"""Equi joins, lookups and spatial joins. Spatial joins meet on grid cells, never on a bare range predicate."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import scalars as S
from millrace.plans.session import checkpointed, stored


def join_tables(left: DataFrame, right: DataFrame, left_on: str, right_on: str, how: str = "left", zero: bool = False) -> DataFrame:
    """Left, inner or right; a right column whose name the left has is left out. With ``zero``, misses are 0 and ""."""
    new = [c for c in right.columns if c not in left.columns]
    kept = right.select(F.col(right_on).alias("__on"), *new)
    out = left.join(kept, F.col(left_on) == F.col("__on"), how)
    if how == "right":
        out = out.withColumn(left_on, F.coalesce(left_on, "__on"))
    if zero:
        empty = lambda f: F.lit("") if isinstance(f.dataType, T.StringType) else F.lit(0).cast(f.dataType)
        out = out.withColumns({f.name: F.coalesce(f.name, empty(f)) for f in right.schema if f.name in new and isinstance(f.dataType, (T.StringType, T.NumericType))})
    return out.drop("__on")


def first_per_key(right: DataFrame, key: str, order: Sequence[str], last: bool = False) -> DataFrame:
    """One row per key, empty texts and nulls left out."""
    from millrace.operators.rows import unique_first

    kept = right.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return unique_first(kept, key, order, last)


def lookup(left: DataFrame, right: DataFrame, left_key: str | Column, right_key: str, take: Mapping[str, str], order: Sequence[str], last: bool = False) -> DataFrame:
    """Columns of the first (or last) matching row, named by ``take``; null without one. Left rows are never multiplied."""
    one = first_per_key(right, right_key, order, last).select(F.col(right_key).alias("__key"), *[F.col(c).alias(n) for c, n in take.items()])
    key = F.col(left_key) if isinstance(left_key, str) else left_key
    return left.join(one, key == F.col("__key"), "left").drop("__key")


def lookup_fallback(left: DataFrame, right: DataFrame, left_key: str, first_key: str, second_key: str, column: str, name: str, order: Sequence[str], second_left_key: str | None = None) -> DataFrame:
    """By the first key, else by the second (and ``second_left_key``, if that is another column of the left)."""
    a = lookup(left, right, left_key, first_key, {column: "__a"}, order)
    b = lookup(a, right, second_left_key or left_key, second_key, {column: "__b"}, order)
    return b.withColumn(name, F.coalesce("__a", "__b")).drop("__a", "__b")


def duplicate_for_shared_key(rows: DataFrame, owners: DataFrame, owner_id: str, shared: str, row_owner: str) -> DataFrame:
    """The rows, and a copy of each for every other owner with the same shared key.

    A key's rows and its owners are cut by hash in blocks of some ``BLOCKS`` each; blocks of rows are dealt to the tasks
    and meet all blocks of owners. What is shuffled are rows, and owners once for each block of rows, never their pairs; a
    key is in many tasks. Copies come block by block, so the same few owners follow each row and a file repeats itself
    at short distances, where it is written small.
    """
    c = F.col
    many, few = BLOCKS
    a = owners.select(c(owner_id).alias("__own"), c(shared).alias("__shared"))
    counted = rows.groupBy(c(row_owner).alias("__of")).agg(F.count("*").alias("__n"))
    blocks = lambda n, size: F.ceil(n / size).cast("long")
    totals = a.join(counted, c("__own") == c("__of"), "left").groupBy(c("__shared").alias("__key")).agg(blocks(F.count("*"), few).alias("__few"), blocks(F.sum("__n"), many).alias("__many")).where("__many > 0")
    known = a.join(totals, c("__shared") == c("__key")).drop("__key")
    names = [f"__c{i}" for i in range(len(rows.columns))]
    keyed = rows.join(known, c(row_owner) == c("__own")).select(*[rows[n].alias(m) for n, m in zip(rows.columns, names)], "__own", "__shared", "__many")
    # so many tasks as asked for: small blocks make many copies
    dealt = keyed.withColumn("__block", F.pmod(F.xxhash64(*names), "__many")).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__shared", "__block")
    taken = dealt.groupBy("__shared", "__block").agg(F.collect_list(F.struct(*names, "__own")).alias("__rows"))
    others = known.groupBy(c("__shared").alias("__key"), "__many", F.pmod(F.xxhash64("__own"), "__few").alias("__o")).agg(F.collect_list("__own").alias("__others"))
    others = others.select("__key", "__others", F.explode(F.sequence(F.lit(0).cast("long"), c("__many") - 1)).alias("__at"))
    met = taken.join(others, (c("__shared") == c("__key")) & (c("__block") == c("__at"))).select(F.explode("__rows").alias("__row"), "__others").select("__row", F.explode("__others").alias("__other")).where("__row.__own <> __other")
    return rows.union(met.select(*[c("__other" if n == row_owner else f"__row.{m}").alias(n) for n, m in zip(rows.columns, names)]))


def cells(low: Column, high: Column, size: float) -> Column:
    """The numbers of the grid cells that a range touches."""
    return F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long"))


def point_in_triangle(points: DataFrame, triangles: DataFrame, order: str, cell: float, last: bool = False, point_id: str | None = None) -> DataFrame:
    """Adds hits (triangles that hold the point strictly inside) and hit, the first one's ``order`` (or the last's).

    triangles: ax, ay, bx, by, cx, cy. A triangle is dealt to the cells of its bounds, a point to its own cell; the
    barycentric test follows. Points without a triangle have 0 and null. ``cell`` should be near a triangle's size.
    ``point_id`` names a unique column; without one the points are numbered and checkpointed.
    """
    bounds = lambda f, *c: f(*[F.col(x) for x in c])
    dealt = (
        triangles.select("ax", "ay", "bx", "by", "cx", "cy", F.col(order).alias("__order"))
        .withColumn("__cx", F.explode(cells(bounds(F.least, "ax", "bx", "cx"), bounds(F.greatest, "ax", "bx", "cx"), cell)))
        .withColumn("__cy", F.explode(cells(bounds(F.least, "ay", "by", "cy"), bounds(F.greatest, "ay", "by", "cy"), cell)))
    )
    keyed = points.withColumns({"__px": F.floor(F.col("x") / cell).cast("long"), "__py": F.floor(F.col("y") / cell).cast("long"), "__id": F.col(point_id) if point_id else F.monotonically_increasing_id()})
    keyed = keyed if point_id else checkpointed(keyed)
    c = F.col
    v0x, v0y, v1x, v1y, v2x, v2y = c("cx") - c("ax"), c("cy") - c("ay"), c("bx") - c("ax"), c("by") - c("ay"), c("x") - c("ax"), c("y") - c("ay")
    cross = v0x * v1y - v1x * v0y
    u = F.try_divide(v2x * v1y - v1x * v2y, cross)
    v = F.try_divide(v0x * v2y - v2x * v0y, cross)
    met = keyed.select("__id", "__px", "__py", "x", "y").join(dealt, (c("__px") == c("__cx")) & (c("__py") == c("__cy"))).where((u > 0) & (v > 0) & (u + v < 1))
    pick = F.max if last else F.min
    hits = met.groupBy("__id").agg(F.count("*").alias("hits"), pick("__order").alias("hit"))
    return keyed.join(hits, "__id", "left").withColumn("hits", F.coalesce("hits", F.lit(0))).drop("__id", "__px", "__py")


def within_box(left: DataFrame, right: DataFrame, reach: float, names: Mapping[str, str]) -> DataFrame:
    """Pairs at most ``reach`` apart in x and in y (edges included). ``names`` renames the right columns; x, y by x2, y2."""
    size = max(reach, 1e-9)
    r = right.select(*[F.col(c).alias(n) for c, n in names.items()]).withColumns({"__cx": F.floor(F.col("x2") / size).cast("long"), "__cy": F.floor(F.col("y2") / size).cast("long")})
    near = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    spread = left.withColumn("__dx", F.explode(near)).withColumn("__dy", F.explode(near))
    spread = spread.withColumns({"__lx": F.floor(F.col("x") / size).cast("long") + F.col("__dx"), "__ly": F.floor(F.col("y") / size).cast("long") + F.col("__dy")}).drop("__dx", "__dy")
    met = spread.join(r, (F.col("__lx") == F.col("__cx")) & (F.col("__ly") == F.col("__cy")))
    return met.where((F.abs(F.col("x") - F.col("x2")) <= reach) & (F.abs(F.col("y") - F.col("y2")) <= reach)).drop("__lx", "__ly", "__cx", "__cy")


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, cell: float, same_layer: bool = False) -> DataFrame:
    """(left_id, nearest, distance) of the nearest right point; ties go to the smaller id. ids must be unique.

    Points at one place are one with its two smallest ids, and cells are halved from ``cell`` until a place shares its own
    with few others (CROWD). First the three by three cells around each point are searched: a find within one cell's size is
    final, as nothing outside can be nearer. For the points still open the right layer's counts per cell, and per block of
    2, 4, 8 ... cells, tell the smallest block size at which a neighbour stands in the three by three blocks around; it is
    then at most sqrt(8) blocks away, so one search in blocks four times as large settles it. A lone point has no row.
    Points with a null, NaN or infinite coordinate are nowhere: they have no row and are no one's neighbour.
    """
    c = F.col
    given = right.where(_finite("x", "y")).select(c(right_id).alias("__r"), c("x").alias("x2"), c("y").alias("y2"))
    places = given.groupBy("x2", "y2").agg(F.min("__r").alias("__r"), F.count("*").alias("__n"))
    if same_layer:  # a copy's neighbour is the smallest other one
        shared = places.where("__n > 1").select(c("x2").alias("__x"), c("y2").alias("__y"), c("__r").alias("__least"))
        second = given.join(shared, (c("x2") == c("__x")) & (c("y2") == c("__y"))).where("__r <> __least").groupBy("__x", "__y").agg(F.min("__r").alias("__s"))
        places = places.join(second, (c("x2") == c("__x")) & (c("y2") == c("__y")), "left").drop("__x", "__y")
    else:
        places = places.withColumn("__s", c("__r"))
    places = stored(places.drop("__n"))
    crowds = [float("inf")]
    while crowds[-1] > CROWD:
        crowds = crowding(places.select(c("x2").alias("x"), c("y2").alias("y")), cell)
        cell /= 2 ** next((k for k, n in enumerate(crowds) if n <= CROWD), len(crowds) - 1)
        if len(crowds) == 1:
            break
    place = lambda n: F.floor(c(n) / cell).cast("long")
    r = places.select("__r", "__s", "x2", "y2", place("x2").alias("__cx"), place("y2").alias("__cy"))
    points = stored(left.where(_finite("x", "y")).select(c(left_id).alias("__l"), "x", "y", place("x").alias("__px"), place("y").alias("__py")))
    other = F.when(c("__l") != c("__r"), c("__r")).otherwise(c("__s")) if same_layer else c("__r")
    gap = F.sqrt(F.pow(c("x") - c("x2"), 2) + F.pow(c("y") - c("y2"), 2))
    near = F.array(*[F.lit(d).cast("long") for d in (-1, 0, 1)])
    block = lambda n: F.call_function("shiftright", c(n), c("level"))

    def around(df: DataFrame) -> DataFrame:
        """The blocks of a point's level that touch its own."""
        spread = df.withColumn("__dx", F.explode(near)).withColumn("__dy", F.explode(near))
        return spread.withColumns({"__bx": block("__px") + c("__dx"), "__by": block("__py") + c("__dy")}).drop("__dx", "__dy")

    def searched(df: DataFrame, levels: list[int]) -> DataFrame:
        dealt = r.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).select("__r", "__s", "x2", "y2", c("level").alias("__level"), block("__cx").alias("__rx"), block("__cy").alias("__ry"))
        met = around(df).join(dealt, (c("level") == c("__level")) & (c("__bx") == c("__rx")) & (c("__by") == c("__ry"))).withColumn("__id", other).where("__id is not null")
        return met.groupBy("__l").agg(F.min(F.struct(gap.alias("d"), c("__id").alias("id"))).alias("m")).select("__l", c("m.id").alias("nearest"), c("m.d").alias("distance"))

    found = stored(searched(points.withColumn("level", F.lit(0)), [0]).where(c("distance") <= cell))
    open_ = stored(points.join(found, "__l", "left_anti"))
    ends = open_.select("x", "y").union(r.select("x2", "y2")).agg(F.count("*"), F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    done = found.withColumnRenamed("__l", left_id)
    if open_.isEmpty():
        return done
    top = max(0, math.ceil(math.log2(max(ends[1], ends[2], cell) / cell))) + 1
    levels = F.sequence(F.lit(0), F.lit(top))
    counts = r.groupBy("__cx", "__cy").agg(F.count("*").alias("n")).withColumn("level", F.explode(levels))
    counts = counts.groupBy(c("level").alias("__level"), block("__cx").alias("__rx"), block("__cy").alias("__ry")).agg(F.sum("n").alias("n"))
    probes = around(open_.withColumn("level", F.explode(levels))).join(counts, (c("level") == c("__level")) & (c("__bx") == c("__rx")) & (c("__by") == c("__ry")))
    first = probes.groupBy("__l", "level").agg(F.sum("n").alias("n")).where(c("n") > int(same_layer)).groupBy("__l").agg((F.min("level") + 2).alias("level"))
    placed = stored(open_.join(first, "__l"))
    used = sorted(row[0] for row in placed.select("level").distinct().collect())  # at most one for each doubling of the extent
    if not used:
        return done
    return done.union(searched(placed, used).withColumnRenamed("__l", left_id))


#: Rows, and owners, of a block of those that share a key.
BLOCKS = (2048, 128)
#: What dealing a row to a cell costs, in tests of a pair: cells shrink until both costs are alike.
DEAL_COST = 8.0
#: Cells are halved so often at most, and levels so many are weighed at once.
HALVINGS = 16
#: Places of a nearest search that share a cell, on average.
CROWD = 3.0


def _finite(*names: str) -> Column:
    """All columns are numbers: not null, NaN or infinite."""
    found = F.lit(True)
    for n in names:
        found &= F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double")) & (F.abs(F.col(n).cast("double")) < float("inf"))
    return found


def crowding(points: DataFrame, cell: float, by: Sequence[str] = ()) -> list[float]:
    """How many points share a point's cell on average, for cells of ``cell``, a half, a quarter ... of it."""
    points = points.where(_finite("x", "y"))
    ends = points.agg(F.max(F.abs("x")), F.max(F.abs("y"))).first()
    halvings = max(0, min(HALVINGS, 50 + math.floor(math.log2(cell / max(float(ends[0] or 0), float(ends[1] or 0), cell)))))  # the cells' numbers are longs
    finest = cell / 2**halvings
    at = points.groupBy(*by, F.floor(F.col("x") / finest).cast("long").alias("i"), F.floor(F.col("y") / finest).cast("long").alias("j")).agg(F.count("*").alias("n"))
    up = at.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(halvings))))
    block = lambda n: F.call_function("shiftright", F.col(n), halvings - F.col("k"))
    n = up.groupBy("k", *by, block("i").alias("bi"), block("j").alias("bj")).agg(F.sum("n").cast("double").alias("n"))
    found = dict(n.groupBy("k").agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).collect())  # a row per level
    return [found.get(k, 0.0) for k in range(halvings + 1)]


def _dealt_along(segments: DataFrame, reach: float, cell: float) -> DataFrame:
    """Segments dealt to the cells along them: in each column of cells, those near the stretch whose points that column can reach."""
    c = F.col
    wider = reach * (1 + 1e-6)
    box = lambda f, a, b, d: f(c(a), c(b)) + d
    columns = segments.withColumn("__cx", F.explode(cells(box(F.least, "x1", "x2", -wider), box(F.greatest, "x1", "x2", wider), cell)))
    inside = lambda edge: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(edge - c("x1"), c("x2") - c("x1"))))
    y_at = lambda share, end: F.when(c("x1") == c("x2"), c(end)).otherwise(c("y1") + share * (c("y2") - c("y1")))
    columns = columns.withColumns({"__ya": y_at(inside(c("__cx") * cell - wider), "y1"), "__yb": y_at(inside((c("__cx") + 1) * cell + wider), "y2")})
    return columns.withColumn("__cy", F.explode(cells(box(F.least, "__ya", "__yb", -wider), box(F.greatest, "__ya", "__yb", wider), cell))).drop("__ya", "__yb")


def _nearest_segments(points: DataFrame, segments: DataFrame, reach: float, cell: float, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(__p, s) of the points (__p, x, y, by...) with a segment of the same ``by`` within ``reach``, and the points without one.

    Rounds of a growing reach: a point with a segment within a round's reach has its nearest among those of its cell and
    is done, the others go on. Each round's cells are as small as their open points' crowding warrants: a test of
    a pair against a row dealt to a cell. The first reach is a quarter of a cell, each next one at least eight times as far.
    """
    c = F.col
    dx, dy = c("x2") - c("x1"), c("y2") - c("y1")
    t = F.coalesce(F.try_divide((c("x") - c("x1")) * dx + (c("y") - c("y1")) * dy, dx * dx + dy * dy), F.lit(0.0))
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    foot_x, foot_y = c("x1") + along * dx, c("y1") + along * dy
    gap = F.sqrt(F.pow(c("x") - foot_x, 2) + F.pow(c("y") - foot_y, 2))
    row = F.struct(gap.alias("distance"), c("segment_id"), foot_x.alias("snapped_x"), foot_y.alias("snapped_y"), F.atan2(dy, dx).alias("angle"))
    own = [f"__of_{k}" for k in by]
    count, span = segments.agg(F.count("*"), F.sum(F.abs(dx) + F.abs(dy))).first()
    count, span = count or 0, span or 0.0
    open_, done, now = points, [], 0.0
    while count and now < reach:
        costs = [(count + 2 * span * 2**k / cell) * (DEAL_COST + crowd) for k, crowd in enumerate(crowding(open_, cell, by))]
        size = cell / 2 ** min(range(len(costs)), key=lambda k: costs[k])
        now = max(size / 4, 8 * now)
        now = reach if now > reach / 4 else now
        size = max(size, min(now, cell))
        at = open_.withColumns({"__px": F.floor(c("x") / size).cast("long"), "__py": F.floor(c("y") / size).cast("long")})
        dealt = _dealt_along(segments, now, size).withColumnsRenamed(dict(zip(by, own)))
        if done:  # few points are open: only their cells are of use
            dealt = dealt.join(at.select(*[c(k).alias(o) for k, o in zip(by, own)], c("__px").alias("__cx"), c("__py").alias("__cy")).distinct(), [*own, "__cx", "__cy"], "left_semi")
        on = (c("__px") == c("__cx")) & (c("__py") == c("__cy"))
        for k, o in zip(by, own):
            on &= c(k) == c(o)
        met = at.join(dealt, on).select("__p", row.alias("s")).where(c("s.distance") <= now)
        done.append(stored(met.groupBy("__p").agg(F.min("s").alias("s"))))
        open_ = stored(open_.join(done[-1], "__p", "left_anti"))
        if open_.isEmpty():
            break
    return (reduce(DataFrame.union, done) if done else points.join(segments.drop(*by)).select("__p", row.alias("s")).limit(0)), open_


def snap_to_segments(points: DataFrame, segments: DataFrame, point_id: str, reach: float, cell: float, prefer: str | None = None) -> DataFrame:
    """Moves points to the nearest segment (x1, y1, x2, y2, segment_id) within ``reach``.

    Returns the points with snapped_x, snapped_y, segment_id, distance and angle, null if none is in reach. A foot
    off the segment's ends becomes the nearer end; ties go to the smaller id. Points and segments meet on cells, of ``cell``
    or as much smaller as the points lie closer together, in rounds of a growing reach (``_nearest_segments``): with n of
    each in one place the pairs tested and the rows dealt grow as n to the power 1.5, not as its square.
    With ``prefer``, a column of both tables, segments of the point's own value (its street's name, say) come before nearer
    ones of others: they are searched first, the others for the points that found none.
    """
    c = F.col
    kept = stored(segments.select("x1", "y1", "x2", "y2", "segment_id", *([c(prefer).alias("__by")] if prefer else [])).where(_finite("x1", "y1", "x2", "y2")))
    own = points.select(c(point_id).alias("__p"), "x", "y", *([c(prefer).alias("__by")] if prefer else []))
    own = stored(own.where(_finite("x", "y")))
    found = []
    if prefer:
        first, own = _nearest_segments(own, kept, reach, cell, ["__by"])
        found, own, kept = [first], own.drop("__by"), kept.drop("__by")
    best = reduce(DataFrame.union, [*found, _nearest_segments(own, kept, reach, cell)[0]])
    return points.join(best, c(point_id) == c("__p"), "left").select(*[points[x] for x in points.columns], "s.snapped_x", "s.snapped_y", "s.segment_id", "s.distance", "s.angle")


def move_to_street(
    points: DataFrame, segments: DataFrame, point_id: str, reach: float, cell: float, prefer: str | None = None, width: float = 0.0002, wide: Sequence[object] = S.WIDE_STREETS
) -> DataFrame:
    """Puts points on the street: x and y become the nearest place on a segment (``snap_to_segments``), if one is in reach.

    Adds segment_id, distance (null without a segment), angle, the direction from that place to where the point was (0 if it
    did not move 1e-9 or had no segment), and road_width, twice ``width`` where the point's ``prefer`` is one of ``wide``.
    """
    c = F.col
    found = snap_to_segments(points, segments, point_id, reach, cell, prefer)
    away = F.atan2(c("y") - c("snapped_y"), c("x") - c("snapped_x"))
    told = found.withColumns({"angle": F.when(c("distance") >= 1e-9, away).otherwise(F.lit(0.0)), "road_width": S.road_width(c(prefer), width, wide) if prefer else F.lit(width)})
    return told.withColumns({"x": F.coalesce("snapped_x", "x"), "y": F.coalesce("snapped_y", "y")}).drop("snapped_x", "snapped_y")


def align_to_lines(points: DataFrame, vertices: DataFrame, point_id: str, reach: float, cell: float) -> DataFrame:
    """Points within ``reach`` of a line, with line, distance and along: the length of the line up to the foot."""
    w = Window.partitionBy("line").orderBy("seq")
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    chained = vertices.withColumn("__s", F.coalesce(step, F.lit(0.0))).withColumn("start", F.sum("__s").over(w))
    segments = chained.select(
        "line", "start", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"), F.struct("line", "seq").alias("segment_id")
    ).where("x2 is not null")
    snapped = snap_to_segments(points, segments, point_id, reach, cell).where("segment_id is not null")
    starts = chained.select(F.struct("line", "seq").alias("segment_id"), "start", F.col("x").alias("x1"), F.col("y").alias("y1"))
    joined = snapped.join(starts, "segment_id")
    along = F.col("start") + F.sqrt(F.pow(F.col("snapped_x") - F.col("x1"), 2) + F.pow(F.col("snapped_y") - F.col("y1"), 2))
    return joined.select(*points.columns, F.col("segment_id.line").alias("line"), "distance", along.alias("along"))


def cut_at_overlaps(df: DataFrame, shape: str, order: str, reach: float) -> tuple[DataFrame, DataFrame]:
    """Lines that another line starts on end there.

    Where a shape's first vertex is nearer than ``reach`` to another shape, that one keeps its vertices up to its
    nearest one (the earliest, if several start on it). Returns the vertices kept, and a connector per pair:
    (shape, other, x, y, x2, y2). All pairs are judged on the input; ties go to the earlier vertex.
    """
    starts = df.groupBy(F.col(shape).alias("__s")).agg(F.min_by(F.struct("x", "y"), order).alias("p")).select("__s", "p.x", "p.y")
    near = within_box(starts, df, reach, {shape: "__o", order: "__at", "x": "x2", "y": "y2"}).where("__s <> __o")
    gap = F.sqrt(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2))
    best = near.select("__s", "__o", "x", "y", F.struct(gap.alias("d"), "__at", "x2", "y2").alias("v")).where(F.col("v.d") < reach).groupBy("__s", "__o", "x", "y").agg(F.min("v").alias("v"))
    ends = best.groupBy("__o").agg(F.min("v.__at").alias("__end"))
    kept = df.join(ends, F.col(shape) == F.col("__o"), "left").where(F.col("__end").isNull() | (F.col(order) <= F.col("__end"))).select(*df.columns)
    return kept, best.select(F.col("__s").alias("shape"), F.col("__o").alias("other"), "x", "y", "v.x2", "v.y2")
