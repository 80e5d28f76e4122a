"""SVG path data of straight lines: reading every form of it, and writing the shortest.

A path is read from its start to its end, each step from where the last one
stopped, so it is done by small helpers on Arrow batches, a path at a time and
in time linear in its length. For writing, coordinates are whole hundredths, so
a rewritten path has the geometry of the one it came from.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

COMMAND = re.compile("([A-DF-Za-df-z])([^A-DF-Za-df-z]*)")
NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
#: How many numbers a step takes.
TAKES = {"M": 2, "L": 2, "H": 1, "V": 1}
#: Lines that a cubic is read as.
FLAT = 8
#: Paths that may be rewritten: closed rings of moves and lines.
RINGS_ONLY = re.compile(r"\s*(?:[Mm][^A-Za-z]*(?:[LlHhVv][^A-Za-z]*)*[Zz]\s*)+")

#: Closed rings of an absolute move and lines, every number apart from the next.
PLAIN = re.compile(r"(?:M{0} {0}(?:L{0} {0})*Z)+".format(r"-?[0-9]+(?:\.[0-9]+)?"))
BLANKS = str.maketrans("MLZ", "   ")


def read_path(d: str) -> list[list[tuple[float, float]]]:
    """The rings of a path, as lists of points.

    A ring begins at each move, or where a line follows a close; further pairs
    behind a move are lines. A cubic becomes ``FLAT`` lines; other curves and
    arcs are passed over.
    """
    rings: list[list[tuple[float, float]]] = []
    x = y = sx = sy = 0.0
    closed = True
    for letter, rest in COMMAND.findall(d):
        kind, relative = letter.upper(), letter.islower()
        if kind == "Z":
            x, y, closed = sx, sy, True
        if kind == "C" and rings:
            numbers = [float(t) for t in NUMBER.findall(rest)]
            for k in range(0, len(numbers) - 5, 6):
                c = [(a + x * relative, b + y * relative) for a, b in zip(numbers[k : k + 6 : 2], numbers[k + 1 : k + 6 : 2])]
                if closed:
                    rings.append([(sx, sy)])
                for j in range(1, FLAT + 1):
                    t, u = j / FLAT, 1 - j / FLAT
                    w = (u * u * u, 3 * u * u * t, 3 * u * t * t, t * t * t)
                    rings[-1].append(tuple(w[0] * at + w[1] * c[0][n] + w[2] * c[1][n] + w[3] * c[2][n] for n, at in enumerate((x, y))))
                (x, y), closed = c[2], False
        if kind not in TAKES:
            continue
        numbers, takes = [float(t) for t in NUMBER.findall(rest)], TAKES[kind]
        for k in range(0, len(numbers) - takes + 1, takes):
            a, b = numbers[k], numbers[k + takes - 1]
            x, y = (x if kind == "V" else a + (x if relative else 0)), (y if kind == "H" else b + (y if relative else 0))
            if kind == "M" and k == 0:
                sx, sy = x, y
                rings.append([(x, y)])
            else:
                if closed:
                    rings.append([(sx, sy)])
                rings[-1].append((x, y))
            closed = False
    return rings


def short_number(value: int) -> str:
    """The shortest text of a number of hundredths."""
    whole, part = divmod(abs(value), 100)
    text = f"{whole or ''}.{part:02}".rstrip("0") if part else str(whole)
    return "-" + text if value < 0 else text


def short_join(numbers: list[str]) -> str:
    """Numbers with a blank between two only where they would run together."""
    out = numbers[0]
    for before, t in zip(numbers, numbers[1:]):
        out += t if t[0] == "-" or (t[0] == "." and "." in before) else " " + t
    return out


def short_ring(points: list[tuple[int, int]]) -> str:
    """A ring of hundredths by its shortest commands; ``z`` alone closes one that ends where it began."""
    points = points[:-1] if len(points) > 1 and points[-1] == points[0] else points
    numbers = [short_number(v) for v in points[0]]
    out, last_letter, last = ["M" + short_join(numbers)], "", numbers[-1]
    for (px, py), (x, y) in zip(points, points[1:]):
        kinds = [("h", [x - px]), ("H", [x])] if y == py else [("v", [y - py]), ("V", [y])] if x == px else [("l", [x - px, y - py]), ("L", [x, y])]
        told = [(letter, [short_number(v) for v in values]) for letter, values in kinds]
        letter, numbers = min(told, key=lambda t: (len(short_join(([last] if t[0] == last_letter else []) + t[1])) - (len(last) if t[0] == last_letter else -1), t[0] != last_letter))
        text = short_join(numbers)
        out.append(short_join([last, *numbers])[len(last) :] if letter == last_letter else letter + text)
        last_letter, last = letter, numbers[-1]
    return "".join(out) + "z"


def short_path(d: str) -> str:
    """The shortest text of a path of closed rings, or ``d`` itself where that is no shorter or has other commands."""
    if not RINGS_ONLY.fullmatch(d):
        return d
    made = "".join(short_ring([(round(x * 100), round(y * 100)) for x, y in ring]) for ring in read_path(d))
    return made if len(made) < len(d) else d


def short_svg(svg: str) -> str:
    return re.sub(r'(<(?:\w+:)?path\b[^>]*?\sd=")([^"]*)', lambda m: m[1] + short_path(m[2]), svg)


def each_text(helper, kind: str, column: Column) -> Column:
    """``helper`` of every text of a column; null for null."""

    def texts(values: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else helper(t) for t in values])

    return F.pandas_udf(texts, kind)(column)


def rings_of(texts: list[str | None]) -> pa.Array:
    """:func:`read_path` of texts as one array; null for null.

    A path of nothing but ``M``, ``L`` and ``Z`` is cut at these letters, and
    the numbers of all texts become one buffer: no point is an object.
    """
    numbers: list = []
    points, rings = [], []
    for t in texts:
        if t is None:
            rings.append(None)
            continue
        if PLAIN.fullmatch(t):
            sizes = [ring.count("L") + 1 for ring in t.split("Z")[:-1]]
            numbers += t.translate(BLANKS).split()
        else:
            read = read_path(t)
            sizes = [len(ring) for ring in read]
            numbers += [v for ring in read for point in ring for v in point]
        points += sizes
        rings.append(len(sizes))
    made = ring_array(np.array(list(map(float, numbers))).reshape(-1, 2), np.array(points, np.int64))
    held = np.array([n or 0 for n in rings], np.int64)
    return pa.ListArray.from_arrays(starts_of(held), made, mask=pa.array([n is None for n in rings], pa.bool_()))


def starts_of(lengths: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())


def ring_array(points: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Rings that lie one behind the other in ``points`` as an array of arrays of ``(x, y)``."""
    xy = pa.StructArray.from_arrays([pa.array(points[:, k], pa.float64()) for k in (0, 1)], names=["x", "y"])
    return pa.ListArray.from_arrays(starts_of(lengths), xy)


def path_rings(d: Column) -> Column:
    """:func:`read_path` of a column, points as structs."""

    def read(texts: pa.Array) -> pa.Array:
        return rings_of(texts.to_pylist())

    return F.arrow_udf(read, "array<array<struct<x:double,y:double>>>")(d)


def optimized_path(d: Column) -> Column:
    return each_text(short_path, "string", d)


def optimized_svg(svg: Column) -> Column:
    """An SVG's text with the data of all its paths at its shortest; all else stays."""
    return each_text(short_svg, "string", svg)
