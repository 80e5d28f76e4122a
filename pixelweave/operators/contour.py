"""Contours of masks: rings of grid corners, simplification and path text.

A cell's side is a border edge if the cell beyond is unset; edges are directed
with the set cell on their right. Linking edges end to start gives closed
rings. Where two set cells meet only at a corner, the walk turns right and so
stays with its cell: four-connected regions and holes never share a ring; by
``cross`` it goes over to the other cell instead. Outer rings are given with
negative area (y down), holes with positive.

No region has to fit in one task. It is cut into tiles; a tile, with the cells
around it, links its own edges into closed rings and into chains that leave it.
Chains are a linked list over the whole table, ranked by pointer doubling: each
round a chain's pointer skips twice as many, until every chain knows the first
one of its ring and how far ahead that is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.functions.paths import ring_array
from pixelweave.functions.shared import by_batch, changes, discard, materialize

EPSILON, STRAIGHT = 0.75, 1e-3
RING = "array<struct<x:double,y:double>>"
TILE = 256
#: An edge's number is its start corner, rows first, and its direction; corners are below 2 ** ROW.
ROW = 28


def corner_number(x, y, way):
    return ((y << ROW) + x) * 4 + way


def linked_edges(group: np.ndarray, x: np.ndarray, y: np.ndarray, own: np.ndarray, cross: bool = False):
    """The border edges of the ``own`` cells of groups, in chains.

    Gives arrays over edges in chain order: ``chain`` (its number), ``group``,
    ``number``, ``way``, and per chain its first edge's place, whether it is
    closed, and the number of the edge that goes on from it elsewhere. A closed
    chain begins with its smallest edge.
    """
    x0, y0 = int(x.min()) - 1, int(y.min()) - 1
    wide, high = int(x.max()) - x0 + 2, int(y.max()) - y0 + 2
    place = (group * high + y - y0) * wide + x - x0
    order = np.argsort(place, kind="stable")
    place, group, x, y, own = place[order], group[order], x[order], y[order], own[order]

    def found(at: np.ndarray) -> np.ndarray:
        """Rows of cells, -1 for unset ones."""
        k = np.minimum(np.searchsorted(place, at), len(place) - 1)
        return np.where(place[k] == at, k, -1)

    # Steps to the cell ahead, and to the cell ahead on the left, in directions right, down, left, up.
    ahead, left = np.array([1, wide, -1, -wide]), np.array([-wide, 1, wide, -1])
    mine = np.flatnonzero(own)
    cell, way = np.repeat(mine, 4), np.tile(np.arange(4), len(mine))
    open_ = found(place[cell] + left[way]) < 0
    cell, way = cell[open_], way[open_]
    if not len(cell):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, np.zeros(0, bool), none
    straight, across = found(place[cell] + ahead[way]), found(place[cell] + ahead[way] + left[way])
    turns_left = (across >= 0) & ((straight >= 0) | cross)
    on = np.where(turns_left, across, np.where(straight >= 0, straight, cell))
    turn = np.where(turns_left, 3, np.where(straight >= 0, 0, 1))
    # Where an edge of a cell begins: its corners in turn.
    dx, dy = np.array([0, 1, 1, 0]), np.array([0, 0, 1, 1])
    number = corner_number(x[cell] + dx[way], y[cell] + dy[way], way)
    next_way = (way + turn) % 4
    next_number = corner_number(x[on] + dx[next_way], y[on] + dy[next_way], next_way)
    names = cell * 4 + way
    at = np.searchsorted(names, on * 4 + next_way)
    inside = own[on]
    n = len(names)
    follows = np.where(inside, np.minimum(at, n - 1), np.arange(n))
    # The smallest edge of every cycle, by doubling; then the cycle is cut before it.
    rounds = n.bit_length()
    reach, least = follows.copy(), number.copy()
    for _ in range(rounds):
        least = np.minimum(least, least[reach])
        reach = reach[reach]
    ring = inside[reach]  # an edge that ends nowhere lies on a cycle
    cut = ring & (number[follows] == least)
    follows[cut] = np.flatnonzero(cut)
    # How far each edge is from the end of its chain.
    reach, far = follows.copy(), (follows != np.arange(n)).astype(np.int64)
    for _ in range(rounds):
        far += far[reach]
        reach = reach[reach]
    order = np.lexsort((-far, reach))
    end = reach[order]
    first = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
    chain = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    return chain, group[cell][order], number[order], way[order], first, ring[order][first], next_number[end[first]]


def turning(chain: np.ndarray, way: np.ndarray, first: np.ndarray, closed: np.ndarray) -> np.ndarray:
    """Edges at which a chain changes its direction; the first of an open chain always counts."""
    if not len(chain):
        return np.zeros(0, bool)
    last = np.append(first[1:], len(chain)) - 1
    before = np.concatenate([[0], way[:-1]])
    before[first] = np.where(closed, way[last], -1)
    return before != way


def link_rings(cells, cross: bool = False) -> list[np.ndarray]:
    """Closed corner rings of a set or array of ``(x, y)`` cells, each from its topmost, then leftmost corner, in the order of these."""
    cells = np.array(list(cells) if isinstance(cells, set) else cells, np.int64).reshape(-1, 2)
    if not len(cells):
        return []
    moved = cells - cells.min(axis=0)
    _, _, number, _, first, _, _ = linked_edges(np.zeros(len(cells), np.int64), moved[:, 0], moved[:, 1], np.ones(len(cells), bool), cross)
    corners = np.stack([(number >> 2) & ((1 << ROW) - 1), number >> (ROW + 2)], axis=1) + cells.min(axis=0)
    return [corners[a:b] for a, b in sorted(zip(first, np.append(first[1:], len(number))), key=lambda r: number[r[0]])]


def signed_area(ring) -> float:
    p = np.asarray(ring, float)
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def without_straight(ring):
    """Drop corners that lie on the line of their neighbours; under three left, keep all."""
    p = np.asarray(ring, float)
    back, on = p - np.roll(p, 1, axis=0), np.roll(p, -1, axis=0) - p
    kept = p[np.abs(back[:, 0] * on[:, 1] - back[:, 1] * on[:, 0]) > STRAIGHT]
    return kept if len(kept) >= 3 else p


def line_distance(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances from the lines through ``a`` and ``b``; from the point where they coincide."""
    d, off = b - a, p - a
    length = np.hypot(d[..., 0], d[..., 1])
    along = np.abs(d[..., 0] * off[..., 1] - d[..., 1] * off[..., 0]) / np.maximum(length, 1e-6)
    return np.where(length < 1e-6, np.hypot(off[..., 0], off[..., 1]), along)


def first_largest(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest value of each run, and the place of its first occurrence."""
    most = np.maximum.reduceat(values, starts)
    at = np.where(values == np.repeat(most, lengths), np.arange(len(values)), len(values))
    return most, np.minimum.reduceat(at, starts)


def simplify_all(points: np.ndarray, lengths: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Closed rings, one behind the other, simplified by Ramer-Douglas-Peucker level by level: their points and lengths.

    A ring is opened at two far points: the one farthest from its first, and
    the one farthest from that. All open segments of all rings are split in one
    round at their farthest points, until none is farther than ``epsilon``.
    Rings under four points, and those with under three left, are unchanged.
    """
    if not len(points):
        return points, lengths
    filled = lengths > 0
    starts = (np.cumsum(lengths) - lengths)[filled]
    held = lengths[filled]

    def farthest(origin: np.ndarray) -> np.ndarray:
        off = points - np.repeat(points[origin], held, axis=0)
        return first_largest((off * off).sum(axis=1), starts, held)[1]

    one = farthest(starts)
    two = farthest(one)
    low, high = np.minimum(one, two), np.maximum(one, two)
    # Each ring from its lower far point round to it again.
    turned = held + 1
    begin = np.cumsum(turned) - turned
    step = np.arange(int(turned.sum())) - np.repeat(begin, turned)
    source = np.repeat(starts, turned) + (np.repeat(low - starts, turned) + step) % np.repeat(held, turned)
    q = points[source]
    keep = np.zeros(len(q), bool)
    keep[begin] = True
    keep[begin + high - low] = True
    keep[begin + held] = True
    a, b = np.concatenate([begin, begin + high - low]), np.concatenate([begin + high - low, begin + held])
    while True:
        longer = b - a > 1
        a, b = a[longer], b[longer]
        if not len(a):
            break
        inner = b - a - 1
        run = np.cumsum(inner) - inner
        at = np.repeat(a + 1 - run, inner) + np.arange(int(inner.sum()))
        most, where = first_largest(line_distance(q[at], q[np.repeat(a, inner)], q[np.repeat(b, inner)]), run, inner)
        split = most > epsilon
        middle = at[where[split]]
        keep[middle] = True
        a, b = np.concatenate([a[split], middle]), np.concatenate([middle, b[split]])
    keep[begin + held] = False  # the first point again
    left = np.add.reduceat(keep.astype(np.int64), begin)
    plain = (held < 4) | (left < 3)
    chosen = np.where(np.repeat(plain, turned), step < np.repeat(held, turned), keep)
    out = np.where(np.repeat(plain, turned), np.repeat(starts, turned) + np.minimum(step, np.repeat(held, turned) - 1), source)[chosen]
    sizes = np.zeros(len(lengths), np.int64)
    sizes[filled] = np.where(plain, held, left)
    return points[out], sizes


def simplify_ring(ring, epsilon: float = EPSILON) -> np.ndarray:
    p = np.asarray(ring, float).reshape(-1, 2)
    return simplify_all(p, np.array([len(p)]), epsilon)[0]


def mask_rings(cells, epsilon: float = EPSILON) -> list[tuple[bool, np.ndarray]]:
    """``(is hole, ring)`` of a mask's cells, outer rings first, straight corners dropped and simplified."""
    found = [(signed_area(ring) < 0, simplify_ring(without_straight(ring[::-1]), epsilon)) for ring in link_rings(cells)]
    return sorted((r for r in found if len(r[1]) >= 3), key=lambda r: r[0])


def tiled(mask: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """Cells in their tile ``(tx, ty)``, and once more in each tile that they border on (``own`` is false there)."""
    at_side = lambda c: F.concat(F.array(F.lit(0)), F.when(F.col(c) % tile == 0, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")), F.when(F.col(c) % tile == tile - 1, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    cells = mask.select(*keys, "x", "y").withColumn("sx", F.explode(at_side("x"))).withColumn("sy", F.explode(at_side("y")))
    own = (F.col("sx") == 0) & (F.col("sy") == 0)
    return cells.select(*keys, (F.floor(F.col("x") / tile) + F.col("sx")).alias("tx"), (F.floor(F.col("y") / tile) + F.col("sy")).alias("ty"), "x", "y", own.alias("own"))


def ranked_chains(chains: DataFrame, keys: list[str], most_rounds: int = 60) -> DataFrame:
    """``chains(keys, head, next, corners)`` with ``ring``, the smallest head of its ring, and ``ahead``, how many chains on that is.

    Pointer doubling: after ``k`` rounds a chain has looked at ``2 ** k``. A
    round in which no chain learns of a smaller head is the last.
    """
    now = chains.select(*keys, "head", "next", F.col("head").alias("ring"), F.lit(0).cast("long").alias("ahead"))
    written = None
    for k in range(most_rounds):
        onward = now.select(*keys, F.col("head").alias("next"), F.col("next").alias("after"), F.col("ring").alias("other"), F.col("ahead").alias("more"))
        less = F.col("other") < F.col("ring")
        step = now.join(onward, [*keys, "next"]).select(*keys, "head", F.col("after").alias("next"), F.least("ring", "other").alias("ring"), F.when(less, F.col("more") + (1 << k)).otherwise(F.col("ahead")).alias("ahead"), less.alias("learned"))
        step = materialize(step, "chain-ranks")
        if written is not None:
            discard(written)
        written, now = step, step.drop("learned")
        if step.filter("learned").isEmpty():
            return chains.join(now.select(*keys, "head", "ring", "ahead"), [*keys, "head"])
    raise RuntimeError(f"rings did not close in {most_rounds} rounds")


def corner_rings(mask: DataFrame, keys: list[str], tile: int = TILE, cross: bool = False) -> DataFrame:
    """``(keys, corners)``: the numbers of the corners at which each ring of each mask turns, in its own order, from anywhere."""
    kinds = ", ".join(f"{k} {mask.schema[k].dataType.simpleString()}" for k in keys)

    def kernel(cells: pd.DataFrame) -> pd.DataFrame:
        starts = changes(cells, [*keys, "ty", "tx"])
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(cells))))
        # Groups are moved to the same place, so that numbers within a batch stay small.
        ox, oy = cells["tx"].to_numpy() * tile, cells["ty"].to_numpy() * tile
        x, y = cells["x"].to_numpy(np.int64) - ox + 1, cells["y"].to_numpy(np.int64) - oy + 1
        chain, of, number, way, first, closed, goes_on = linked_edges(group, x, y, cells["own"].to_numpy(), cross)
        shift = corner_number(ox[starts] - 1, 0, 0) + ((oy[starts] - 1) << (ROW + 2))
        kept = turning(chain, way, first, closed)
        number, of_chain = number + shift[of], of[first]
        n = np.add.reduceat(kept.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        heads = cells.iloc[starts[of_chain]]
        lists = np.split(number[kept], np.cumsum(n)[:-1]) if len(first) else []
        return pd.DataFrame({**{k: heads[k].to_numpy() for k in keys}, "head": number[first], "next": goes_on + shift[of_chain], "closed": closed, "corners": pd.Series(lists, dtype=object)})

    linked = materialize(by_batch(tiled(mask, keys, tile), [*keys, "ty", "tx"], ["y", "x"], kernel, f"{kinds}, head long, next long, closed boolean, corners array<bigint>"), "chains")
    whole, chains = linked.filter("closed").select(*keys, "corners"), linked.filter("not closed")
    if chains.isEmpty():
        return whole
    ranked = ranked_chains(chains, keys)
    joined = ranked.groupBy(*keys, "ring").agg(F.array_sort(F.collect_list(F.struct((-F.col("ahead")).alias("place"), "head", "corners"))).alias("p"))
    # The smallest head is 0 ahead of itself and sorts last; a ring may begin anywhere.
    return whole.unionByName(joined.select(*keys, F.flatten(F.transform("p", lambda p: p["corners"])).alias("corners")))


def finished(number: np.ndarray, lengths: np.ndarray, epsilon: float) -> list[pa.Array]:
    """``start``, ``is_hole`` and ``pts`` of rings of corner numbers, one behind the other: from their smallest corner, turned round, simplified."""
    starts = np.cumsum(lengths) - lengths
    step = np.arange(len(number)) - np.repeat(starts, lengths)
    least, at = first_largest(-number, starts, lengths) if len(number) else (number, number)
    turned = np.repeat(starts, lengths) + (np.repeat(at - starts, lengths) + step) % np.repeat(lengths, lengths)
    number = number[turned]
    way = number & 3
    before = np.concatenate([[0], way[:-1]])
    before[starts] = way[starts + lengths - 1]
    kept = before != way  # a chain's first corner may be a straight one
    lengths = np.add.reduceat(kept.astype(np.int64), starts) if len(number) else lengths
    number = number[kept]
    starts = np.cumsum(lengths) - lengths
    back = np.repeat(2 * starts + lengths - 1, lengths) - np.arange(len(number))  # turned round: the set cell on the left
    p = np.stack([(number >> 2) & ((1 << ROW) - 1), number >> (ROW + 2)], axis=1).astype(float)[back]
    on = np.arange(len(p)) + 1
    on[starts + lengths - 1] = starts
    area = np.add.reduceat(p[:, 0] * p[on, 1] - p[on, 0] * p[:, 1], starts) if len(p) else np.zeros(0)
    p, sizes = simplify_all(p, lengths, epsilon)
    return [pa.array(-least), pa.array(area > 0), ring_array(p.reshape(-1, 2), sizes)]


def trace_rings(mask: DataFrame, keys: list[str], epsilon: float = EPSILON, tile: int = TILE, cross: bool = False) -> DataFrame:
    """``(keys, ring_id, is_hole, pts)`` of each mask ``(keys, x, y)``; a mask is one region of one image.

    Outer rings come first, then by their topmost, leftmost corner. ``cross``
    links set cells that meet at a corner only into one ring.
    """
    kinds = ", ".join(f"{k} {mask.schema[k].dataType.simpleString()}" for k in keys)

    def rows(batches):
        for batch in batches:
            if batch.num_rows:
                corners = batch.column("corners")
                made = finished(corners.flatten().to_numpy(), corners.value_lengths().to_numpy().astype(np.int64), epsilon)
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *made], names=[*keys, "start", "is_hole", "pts"])

    rings = corner_rings(mask, keys, tile, cross).mapInArrow(rows, f"{kinds}, start long, is_hole boolean, pts {RING}")
    order = Window.partitionBy(*keys).orderBy("is_hole", "start")
    return rings.withColumn("ring_id", F.row_number().over(order) - 1).select(*keys, "ring_id", "is_hole", "pts")


def simplify_rings(rings: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """``rings`` with ``pts`` simplified, the rings of a batch level by level."""

    @F.pandas_udf(RING)
    def simple(points: pd.Series) -> pd.Series:
        rows = [[(p["x"], p["y"]) for p in ring] for ring in points]
        p, sizes = simplify_all(np.array([xy for ring in rows for xy in ring], float).reshape(-1, 2), np.array([len(r) for r in rows], np.int64), epsilon)
        made, ends = [{"x": a, "y": b} for a, b in p.tolist()], np.cumsum(sizes).tolist()
        return pd.Series([made[b - n : b] for b, n in zip(ends, sizes.tolist())])

    return rings.withColumn("pts", simple("pts"))


# --- relational twins on arrays of points ---


def next_point(points, i):
    return F.get(points, (i + 1) % F.size(points))


def ring_area(points) -> F.Column:
    """Shoelace over the closed ring."""
    terms = F.transform(points, lambda p, i: p["x"] * next_point(points, i)["y"] - next_point(points, i)["x"] * p["y"])
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t) / 2


def drop_straight(points) -> F.Column:
    before = lambda i: F.get(points, (i + F.size(points) - 1) % F.size(points))

    def turns(p, i):
        b, n = before(i), next_point(points, i)
        return F.abs((p["x"] - b["x"]) * (n["y"] - p["y"]) - (p["y"] - b["y"]) * (n["x"] - p["x"])) > STRAIGHT

    kept = F.filter(points, turns)
    return F.when(F.size(kept) >= 3, kept).otherwise(points)


def oriented(points, outer) -> F.Column:
    """Outer rings with negative area, holes with positive."""
    area = ring_area(points)
    return F.when((outer & (area > 0)) | (~outer & (area < 0)), F.reverse(points)).otherwise(points)


def curve_commands(points: str, threshold) -> F.Column:
    """``(corner, c1, c2, p)`` per side of a closed ring in column ``points``: control points and end of a cubic.

    A point is a corner where the ring turns by ``threshold`` degrees or more.
    A smooth point's tangent is half the way between its neighbours, a corner
    has those of its own sides; controls lie a third of a tangent away. A side
    between two corners stays straight (``corner``).
    """
    n = F.size(points)
    less = lambda a, b: (a["x"] - b["x"], a["y"] - b["y"])

    def turned(p, i):
        """A point with whether it is a corner, so that this is told once per point."""
        back, on = F.get(points, F.pmod(i - 1, n)), F.get(points, F.pmod(i + 1, n))
        (ax, ay), (bx, by) = less(p, back), less(on, p)
        angle = F.degrees(F.abs(F.atan2(ax * by - ay * bx, ax * bx + ay * by)))
        return F.struct(p["x"].alias("x"), p["y"].alias("y"), (F.round(angle, 6) >= threshold).alias("turns"))

    def sides(marked):
        at = lambda i: F.get(marked, F.pmod(i, n))

        def side(p, i):
            q = at(i + 1)
            straight = less(q, p)
            out = [F.when(p["turns"], s).otherwise(t / 2) for s, t in zip(straight, less(q, at(i - 1)))]
            into = [F.when(q["turns"], s).otherwise(t / 2) for s, t in zip(straight, less(at(i + 2), p))]
            point = lambda x, y, name: F.struct(x.alias("x"), y.alias("y")).alias(name)
            return F.struct((p["turns"] & q["turns"]).alias("corner"), point(p["x"] + out[0] / 3, p["y"] + out[1] / 3, "c1"), point(q["x"] - into[0] / 3, q["y"] - into[1] / 3, "c2"), point(q["x"], q["y"], "p"))

        return F.transform(marked, side)

    kept = F.when(n >= 3, F.col(points)).otherwise(F.slice(points, 1, 0))
    # An array of one array binds the marked points to a name, so that they are made once.
    return F.get(F.transform(F.array(F.transform(kept, turned)), sides), 0)
