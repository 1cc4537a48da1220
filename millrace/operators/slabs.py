"""Edges on a tree of slabs: what crosses an edge, and what lies straight above or below a place.

Slabs are stretches of x between quantiles of a bounded sample (results do not depend on where they lie), joined by twos
to the nodes of a tree. An edge is long in the few nodes that cover the slabs between its ends, and short in the nodes
that hold an end. In a node the long edges of one ring lie above each other in one order, so a search by halves gives
those that an edge passes or that are next to a place. An edge has a row for each of its nodes, some two for each
doubling of the table, however many slabs it passes; the short edges of large nodes are dealt over several groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ends in a slab, slabs at most, rows of a group, and how near (as a share of the values) counts as touching.
ENDS_A_SLAB, SLABS, GROUP, NEAR = 32, 1 << 15, 40_000, 1e-11


class Slabs:
    """Borders of slabs, the levels of their tree and the number of edges that they were made for."""

    def __init__(self, edges: DataFrame):
        self.count = edges.count()
        most = min(max(self.count // ENDS_A_SLAB, 1), SLABS)
        share = min(1.0, 8 * most / max(self.count, 1))
        xs = np.sort(edges.sample(share, seed=7).select("px").toPandas()["px"].to_numpy(float)) if share < 1 or most > 1 else np.empty(0)
        self.borders = np.unique(xs[np.linspace(0, len(xs) - 1, most + 1).astype(int)[1:-1]]) if len(xs) else xs
        self.levels = max(int(len(self.borders)).bit_length(), 0) + 1

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.borders, x, "right")

    def node(self, level: int, k: np.ndarray) -> np.ndarray:
        return (1 << (self.levels - level)) + k

    def groups(self, level: int) -> int:
        """How many groups share the short edges of a node."""
        return max(1, (2 * self.count >> (self.levels - 1 - level)) // GROUP) if level else 1

    def dealt(self, edges: DataFrame) -> DataFrame:
        """Rows of ``edges`` (px, py, qx, qy and others) for their nodes, with node, group, long and leaf; a place is an edge of no length."""
        own, fields = self, edges.schema.simpleString()[7:-1]
        buckets = max(1, self.count * 2 * self.levels // GROUP)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                px = pdf["px"].to_numpy(float)
                qx = pdf["qx"].to_numpy(float)
                i, j = own.of(np.minimum(px, qx)), own.of(np.maximum(px, qx))
                parts = []
                every = np.arange(len(pdf))
                for level in range(own.levels):
                    first, last = (i + (1 << level)) >> level, j >> level  # the nodes within i + 1 ... j - 1
                    spread = own.groups(level)
                    for rows, k in ((np.flatnonzero((first < last) & (first & 1 == 1)), first), (np.flatnonzero((first < last) & (last & 1 == 1)), last - 1)):
                        for s in range(spread):
                            parts.append((rows, own.node(level, k[rows]), np.full(len(rows), s), True, False))
                    for rows, k in ((every, i >> level), (np.flatnonzero(i >> level != j >> level), j >> level)):
                        parts.append((rows, own.node(level, k[rows]), (rows * 7919 + len(parts)) % spread, False, level == 0))
                at = np.concatenate([p[0] for p in parts])
                node, salt = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
                out = pdf.iloc[at].reset_index(drop=True)
                out["node"], out["salt"] = node, salt
                out["group"] = ((node * 2654435761 + salt * 40503) % 4294967291) % buckets
                out["long"] = np.concatenate([np.full(len(p[0]), p[3]) for p in parts])
                out["leaf"] = np.concatenate([np.full(len(p[0]), p[4]) for p in parts])
                yield out

        return edges.mapInPandas(run, f"{fields},node bigint,salt bigint,group bigint,long boolean,leaf boolean")

    def bounds(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where nodes begin and end along x."""
        depth = np.frexp(node.astype(float))[1] - 1
        size = 1 << (self.levels - depth)
        k = (node - (np.int64(1) << depth.astype(np.int64))) * size
        ends = np.concatenate([[-np.inf], self.borders, np.full(2 * (1 << self.levels), np.inf)])
        return ends[k], ends[k + size]


def height(at: np.ndarray, px, py, qx, qy) -> np.ndarray:
    """y of edges where they pass x; at an end exactly that end's, so that edges that meet there tie."""
    return np.where(at == qx, qy, py + (qy - py) * ((at - px) / (qx - px)))


class Long:
    """The long edges of a group of rows, ring by ring and node by node from below."""

    def __init__(self, rows: pd.DataFrame, slabs: Slabs):
        low, high = slabs.bounds(rows["node"].to_numpy())
        c = [rows[n].to_numpy(float) for n in ("px", "py", "qx", "qy")]
        order = np.lexsort((height((low + high) / 2, *c), rows["ring"].to_numpy(), rows["node"].to_numpy()))
        self.e, self.c = rows["e"].to_numpy()[order], [v[order] for v in c]
        lists = rows[["node", "ring", "salt"]].iloc[order].assign(start=np.arange(len(order)))
        self.lists = lists.groupby(["node", "ring", "salt"], sort=False)["start"].agg(["min", "max"]).reset_index().rename(columns={"min": "start", "max": "stop"})
        self.lists["stop"] += 1

    def below(self, x: np.ndarray, y: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The place in each list of the first edge that does not run below (x, y)."""
        lo, hi = start.copy(), stop.copy()
        while (todo := np.flatnonzero(lo < hi)).size:
            mid = (lo[todo] + hi[todo]) >> 1
            under = height(x[todo], *[v[mid] for v in self.c]) < y[todo]
            lo[todo[under]] = mid[under] + 1
            hi[todo[~under]] = mid[~under]
        return lo

    def touches(self, at: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.abs(height(x, *[v[at] for v in self.c]) - y) <= NEAR * (1 + np.abs(y))


def _spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) for all numbers first <= number < last of each row."""
    size = np.maximum(last - first, 0)
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[row]


def _passed(query: pd.DataFrame, long: Long, slabs: Slabs) -> tuple[np.ndarray, np.ndarray]:
    """(e of the query, e of the long edge) of those that the query's edges pass or touch within their node."""
    met = query.merge(long.lists, on=["node", "salt"])
    c = [met[n].to_numpy(float) for n in ("px", "py", "qx", "qy")]
    low, high = slabs.bounds(met["node"].to_numpy())
    start, stop = met["start"].to_numpy(), met["stop"].to_numpy()
    ends = []
    for x, y, cut in ((c[0], c[1], c[0] < low), (c[2], c[3], c[2] > high)):
        border = np.where(x < low, low, high)
        with np.errstate(all="ignore"):
            ends.append((np.where(cut, border, x), np.where(cut, height(border, *c), y)))
    at = [long.below(x, y, start, stop) for x, y in ends]
    first, last = np.minimum(*at), np.maximum(*at)
    for step, edge in ((-1, first), (1, last)):  # and those that touch either end
        todo = np.arange(len(edge))
        while todo.size:
            next_one = edge[todo] + (-1 if step < 0 else 0)
            todo, next_one = (v[(next_one >= start[todo]) & (next_one < stop[todo])] for v in (todo, next_one))
            near = np.zeros(len(todo), bool)
            for x, y in ends:
                near |= long.touches(next_one, x[todo], y[todo])
            todo = todo[near]
            edge[todo] += step
    row, place = _spans(first, last)
    return met["e"].to_numpy()[row], long.e[place]


def meeting(a: DataFrame, b: DataFrame) -> DataFrame:
    """(ea, eb): the edges of two layers that may meet, with all that do; a, b: (ring, e, px, py, qx, qy), ids being long.

    Edges of one ring must not cross.
    """
    ahead = (F.col("px") <= F.col("qx"))
    sides = [df.select("ring", "e", *[F.when(ahead, F.col(n)).otherwise(F.col(m)).alias(n) for n, m in (("px", "qx"), ("py", "qy"), ("qx", "px"), ("qy", "py"))], F.lit(k).alias("layer")) for k, df in enumerate((a, b))]
    both = sides[0].union(sides[1])
    slabs = Slabs(both)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        of_a, of_b = pdf[pdf["layer"] == 0], pdf[pdf["layer"] == 1]
        found = []
        # a's edges, long ones in their first group alone, with b's long ones; b's short ones with a's long ones
        lead = of_a[~of_a["long"] | (of_a["salt"] == 0)]
        for query, other, turned in ((lead, of_b[of_b["long"]], False), (of_b[~of_b["long"]], of_a[of_a["long"]], True)):
            if len(query) and len(other):
                pair = _passed(query, Long(other, slabs), slabs)
                found.append(pair[::-1] if turned else pair)
        ends = [df[df["leaf"]] for df in (of_a, of_b)]
        met = ends[0].merge(ends[1], on=["node"], suffixes=("", "_b"))
        x = (met["px"] <= met["qx_b"]) & (met["px_b"] <= met["qx"])
        y = (np.minimum(met["py"], met["qy"]) <= np.maximum(met["py_b"], met["qy_b"])) & (np.minimum(met["py_b"], met["qy_b"]) <= np.maximum(met["py"], met["qy"]))
        met = met[x & y]
        found.append((met["e"].to_numpy(), met["e_b"].to_numpy()))
        return pd.DataFrame({"ea": np.concatenate([f[0] for f in found]), "eb": np.concatenate([f[1] for f in found])})

    return slabs.dealt(both).groupBy("group").applyInPandas(run, "ea bigint, eb bigint").distinct()


def _seen(pdf: pd.DataFrame, slabs: Slabs) -> pd.DataFrame:
    """(v, side, n, height, slope, e): for places v of a group and their lists, the n edges above and below, and the next one."""
    places, edges = pdf[pdf["layer"] == 1], pdf[pdf["layer"] == 0]
    long, out = Long(edges[edges["long"]], slabs), []

    def add(v: np.ndarray, side: int, n: np.ndarray, x: np.ndarray, c: list[np.ndarray], e: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            out.append(pd.DataFrame({"v": v, "side": side, "n": n, "height": height(x, *c), "slope": (c[3] - c[1]) / (c[2] - c[0]), "e": e}))

    met = places.merge(long.lists, on=["node", "ring", "salt"])
    x, y, start, stop = (met[n].to_numpy() for n in ("px", "py", "start", "stop"))
    at = long.below(x, y, start, stop)
    for side, n, place in ((1, stop - at, at), (-1, at - start, at - 1)):
        has = n > 0
        add(met["e"].to_numpy()[has], side, n[has], x[has], [v[place[has]] for v in long.c], long.e[place[has]])
    met = places[places["leaf"]].merge(edges[edges["leaf"]], on=["node", "ring"], suffixes=("", "_e"))
    x, y = met["px"].to_numpy(), met["py"].to_numpy()
    c = [met[f"{n}_e"].to_numpy() for n in ("px", "py", "qx", "qy")]
    between = ((c[0] < x) | ((c[0] == x) & (c[1] < y))) & ((x < c[2]) | ((x == c[2]) & (y < c[3])))
    turn = (c[2] - c[0]) * (y - c[1]) - (c[3] - c[1]) * (x - c[0])
    for side, has in ((1, between & (turn < 0)), (-1, between & (turn > 0))):
        add(met["e"].to_numpy()[has], side, np.ones(has.sum(), int), x[has], [v[has] for v in c], met["e_e"].to_numpy()[has])
    return pd.concat(out)


def seen(edges: DataFrame, places: DataFrame) -> DataFrame:
    """(v, side, e): the edge of its ring straight above (side 1) or below (-1) each place, where a line on from there
    crosses an odd number of edges. edges: (ring, e, px, py, qx, qy); places: (ring, v, x, y).

    Edges of one ring must not cross. Straight is as if the plane leant a little, so no two places are above each other.
    """
    c = F.col
    ahead = F.struct("px", "py") < F.struct("qx", "qy")
    turned = [F.when(ahead, c(n)).otherwise(c(m)).alias(n) for n, m in (("px", "qx"), ("py", "qy"), ("qx", "px"), ("qy", "py"))]
    of = [edges.select("ring", "e", *turned, F.lit(0).alias("layer")), places.select("ring", c("v").alias("e"), c("x").alias("px"), c("y").alias("py"), c("x").alias("qx"), c("y").alias("qy"), F.lit(1).alias("layer"))]
    slabs = Slabs(of[0])
    dealt = slabs.dealt(of[0].union(of[1])).where("layer = 1 or long or leaf")
    found = dealt.groupBy("group").applyInPandas(lambda pdf: _seen(pdf, slabs), "v bigint, side int, n bigint, height double, slope double, e bigint")
    # of edges that end at one height, the steeper one is nearer where the plane leans
    near = F.struct(c("side") * -c("height"), "slope", "e")
    return found.groupBy("v", "side").agg(F.sum("n").alias("n"), F.max(near).alias("k")).where("n % 2 = 1").select("v", "side", "k.e")
