"""Measures and predicates on a geometry column.

A geometry is ``struct<type, parts>`` where ``parts`` is parts -> rings -> positions. A line is
one ring per part, a point one position. Predicates work on an array of edges
``struct<ax, ay, bx, by>``; a point is one edge of length zero, so every kind shares one form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionscore.functions.projection import let

POSITION = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
GEOMETRY = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("parts", T.ArrayType(T.ArrayType(T.ArrayType(POSITION)))),
    ]
)
EDGE_FIELDS = ("ax", "ay", "bx", "by")

# Fixed value: how far from an edge, as a cross product in degrees, still counts as on it.
BORDER_TOLERANCE = 1e-12
# The same in projected metres, per metre of edge (rounding of coordinates near 6 000 km).
METRIC_TOLERANCE = 1e-6


def _position(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _typed(kind: str, parts: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), parts.alias("parts"))


def point(x: Column, y: Column) -> Column:
    return _typed("Point", F.array(F.array(F.array(_position(x, y)))))


def linestring(*xy: tuple[Column, Column]) -> Column:
    return _typed("LineString", F.array(F.array(F.array(*[_position(x, y) for x, y in xy]))))


def polygon(*rings: list[tuple[Column, Column]]) -> Column:
    shells = [F.array(*[_position(x, y) for x, y in ring]) for ring in rings]
    return _typed("Polygon", F.array(F.array(*shells)))


def multi(geom: Column) -> Column:
    """The same parts under the multi-part type name."""
    kind = geom["type"]
    return F.struct(
        F.when(kind.startswith("Multi"), kind).otherwise(F.concat(F.lit("Multi"), kind)).alias("type"),
        geom["parts"].alias("parts"),
    )


def rings(geom: Column) -> Column:
    return F.flatten(geom["parts"])


def positions(geom: Column) -> Column:
    return F.flatten(rings(geom))


def is_empty(geom: Column) -> Column:
    return geom.isNull() | (F.coalesce(F.size(positions(geom)), F.lit(0)) <= 0)


def ring_edges(ring: Column) -> Column:
    n = F.size(ring)

    def edge(a: Column, b: Column) -> Column:
        return F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))

    lone = F.transform(ring, lambda p: edge(p, p))
    return F.when(n <= 1, lone).otherwise(
        F.zip_with(F.slice(ring, 1, F.greatest(n - 1, F.lit(0))), F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), edge)
    )


def edges(geom: Column) -> Column:
    """All edges of a geometry as one flat array."""
    return F.flatten(F.transform(rings(geom), ring_edges))


def bbox(geom: Column) -> Column:
    xs = F.transform(positions(geom), lambda p: p["x"])
    ys = F.transform(positions(geom), lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("xmin"),
        F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"),
        F.array_max(ys).alias("ymax"),
    )


def _sum(array: Column, value) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, item: acc + value(item))


def _ring_moments(ring: Column, origin: Column) -> Column:
    """Signed double area and first moments of a ring about ``origin``."""

    def add(acc: Column, e: Column) -> Column:
        ax, ay = e["ax"] - origin["x"], e["ay"] - origin["y"]
        bx, by = e["bx"] - origin["x"], e["by"] - origin["y"]
        cross = ax * by - bx * ay
        return F.struct(
            (acc["a"] + cross).alias("a"),
            (acc["mx"] + (ax + bx) * cross).alias("mx"),
            (acc["my"] + (ay + by) * cross).alias("my"),
        )

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    return F.aggregate(ring_edges(ring), zero, add)


def _moments(geom: Column, origin: Column) -> Column:
    """Area and moments of a polygon: shells add, holes subtract, whatever their winding."""

    def signed(ring: Column, i: Column) -> Column:
        def oriented(m: Column) -> Column:
            sign = F.signum(m["a"]) * F.when(i == 0, 1.0).otherwise(-1.0)
            return F.struct((m["a"] * sign).alias("a"), (m["mx"] * sign).alias("mx"), (m["my"] * sign).alias("my"))

        return let(_ring_moments(ring, origin), oriented)

    each = F.flatten(F.transform(geom["parts"], lambda part: F.transform(part, signed)))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    return F.aggregate(
        each,
        zero,
        lambda acc, m: F.struct(
            (acc["a"] + m["a"]).alias("a"), (acc["mx"] + m["mx"]).alias("mx"), (acc["my"] + m["my"]).alias("my")
        ),
    )


def _origin(geom: Column) -> Column:
    return geom["parts"][0][0][0]


def area_m2(geom: Column) -> Column:
    return let(_origin(geom), lambda o: _moments(geom, o)["a"] / 2.0)


def centroid(geom: Column) -> Column:
    """Area-weighted centroid ``struct<x, y>`` of a projected polygon."""

    def from_moments(o: Column) -> Column:
        return let(
            _moments(geom, o),
            lambda m: F.struct(
                (o["x"] + m["mx"] / F.nullif(m["a"] * 3.0, F.lit(0.0))).alias("x"),
                (o["y"] + m["my"] / F.nullif(m["a"] * 3.0, F.lit(0.0))).alias("y"),
            ),
        )

    return let(_origin(geom), from_moments)


def length_m(geom: Column) -> Column:
    return _sum(edges(geom), lambda e: F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"]))


def scaled_degree_length(geom: Column) -> Column:
    """Line length in degrees of latitude, longitudes shrunk by the cosine of the mean latitude."""
    return F.when(
        geom["type"].isin("LineString", "MultiLineString"),
        _sum(
            edges(geom),
            lambda e: F.hypot(
                (e["bx"] - e["ax"]) * F.cos(F.radians((e["by"] + e["ay"]) / 2.0)), e["by"] - e["ay"]
            ),
        ),
    ).otherwise(F.lit(0.0))


def _cross(e: Column, x: Column, y: Column) -> Column:
    return (x - e["ax"]) * (e["by"] - e["ay"]) - (y - e["ay"]) * (e["bx"] - e["ax"])


def on_edge(e: Column, x: Column, y: Column, *, metric: bool = False) -> Column:
    if metric:
        tol = F.lit(METRIC_TOLERANCE)
        near = F.abs(_cross(e, x, y)) <= tol * F.greatest(F.lit(1.0), F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"]))
    else:
        tol = F.lit(BORDER_TOLERANCE)
        near = F.abs(_cross(e, x, y)) <= tol
    return (
        near
        & (x >= F.least(e["ax"], e["bx"]) - tol)
        & (x <= F.greatest(e["ax"], e["bx"]) + tol)
        & (y >= F.least(e["ay"], e["by"]) - tol)
        & (y <= F.greatest(e["ay"], e["by"]) + tol)
    )


def ray_crosses(e: Column, x: Column, y: Column) -> Column:
    """Whether the ray going east from ``(x, y)`` crosses the edge (half-open in y)."""
    straddles = (e["ay"] > y) != (e["by"] > y)
    at = (e["bx"] - e["ax"]) * (y - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"]
    return straddles & (x < at)


def covers_edges(edge_array: Column, x: Column, y: Column, *, metric: bool = False) -> Column:
    """Border-inclusive containment by edge parity.

    Over a valid polygon the parity of all rings together leaves hole interiors out and keeps
    every border in, whichever part or ring an edge came from.
    """
    odd = F.size(F.filter(edge_array, lambda e: ray_crosses(e, x, y))) % 2 == 1
    return F.exists(edge_array, lambda e: on_edge(e, x, y, metric=metric)) | odd


def _turn(e: Column, x: Column, y: Column) -> Column:
    return (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])


def passes_east(e: Column, x: Column, y: Column) -> Column:
    """Whether the edge's line is east of ``(x, y)`` at that height (strictly)."""
    turn = _turn(e, x, y)
    return F.when(e["by"] > e["ay"], turn > 0).otherwise(turn < 0)


def _below(e: Column, x: Column, y: Column) -> Column:
    """Whether going up the line at ``x`` to ``(x, y)`` passes the edge, which spans ``x``.

    On the edge itself a rising edge is not passed yet, so that this agrees with :func:`passes_east`.
    """
    turn = _turn(e, x, y)
    s = F.when(e["ax"] < e["bx"], turn).otherwise(-turn)
    rising = F.when(e["ax"] < e["bx"], e["by"] > e["ay"]).otherwise(e["ay"] > e["by"])
    return (s > 0) | ((s == 0) & ~rising)


def odd_in_cell(edge_array: Column, odd: Column, east: Column, south: Column, x: Column, y: Column) -> Column:
    """Whether the ray going east from ``(x, y)`` meets an odd number of a region's edges.

    Only the edges that touch the point's cell are needed: ``odd`` says it for the cell's corner ``(east, south)``.
    From there the way leads up the east side, over the edges that cross it, and then west
    to the point, over the edges between. Ends of edges count half-open, as for a ray.
    """
    up = F.filter(
        edge_array,
        lambda e: ((e["ax"] > east) != (e["bx"] > east)) & (_below(e, east, y) != _below(e, east, south)),
    )
    west = F.filter(
        edge_array,
        lambda e: ((e["ay"] > y) != (e["by"] > y)) & passes_east(e, x, y) & ~passes_east(e, east, y),
    )
    return ((F.size(up) + F.size(west)) % 2 == 1) != odd


def covers(geom: Column, x: Column, y: Column, *, metric: bool = False) -> Column:
    return covers_edges(edges(geom), x, y, metric=metric)


def point_segment_distance(px, py, ax, ay, bx, by) -> Column:
    dx, dy = bx - ax, by - ay
    t = ((px - ax) * dx + (py - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.coalesce(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def segments_meet(ax, ay, bx, by, cx, cy, dx, dy, *, slack: float = 0.0) -> Column:
    """Whether two closed segments share a point (touching counts, collinear overlap counts)."""

    def side(px, py, qx, qy, rx, ry):
        return (qx - px) * (ry - py) - (qy - py) * (rx - px)

    s = F.lit(slack)
    d1, d2 = side(cx, cy, dx, dy, ax, ay), side(cx, cy, dx, dy, bx, by)
    d3, d4 = side(ax, ay, bx, by, cx, cy), side(ax, ay, bx, by, dx, dy)
    straddle = ((d1 <= s) & (d2 >= -s) | (d1 >= -s) & (d2 <= s)) & ((d3 <= s) & (d4 >= -s) | (d3 >= -s) & (d4 <= s))
    boxes = (
        (F.greatest(ax, bx) >= F.least(cx, dx) - s)
        & (F.greatest(cx, dx) >= F.least(ax, bx) - s)
        & (F.greatest(ay, by) >= F.least(cy, dy) - s)
        & (F.greatest(cy, dy) >= F.least(ay, by) - s)
    )
    return boxes & straddle


def segment_distance(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    apart = F.least(
        point_segment_distance(ax, ay, cx, cy, dx, dy),
        point_segment_distance(bx, by, cx, cy, dx, dy),
        point_segment_distance(cx, cy, ax, ay, bx, by),
        point_segment_distance(dx, dy, ax, ay, bx, by),
    )
    return F.when(segments_meet(ax, ay, bx, by, cx, cy, dx, dy), 0.0).otherwise(apart)


def _fields(e: Column):
    return tuple(e[f] for f in EDGE_FIELDS)


def distance(left: Column, right: Column) -> Column:
    """Planar distance of two geometries in one row (0 when one covers the other's vertex)."""
    pairs = F.transform(
        edges(left),
        lambda a: F.array_min(F.transform(edges(right), lambda b: segment_distance(*_fields(a), *_fields(b)))),
    )
    a0, b0 = _origin(left), _origin(right)
    inside = (right["type"].endswith("Polygon") & covers(right, a0["x"], a0["y"], metric=True)) | (
        left["type"].endswith("Polygon") & covers(left, b0["x"], b0["y"], metric=True)
    )
    return F.when(inside, 0.0).otherwise(F.array_min(pairs))


def covered_fraction(ax, ay, bx, by, t0, t1, edge_array, *, metric: bool = True, inside=None) -> Column:
    """Share of a segment's parameter range ``[t0, t1]`` that lies in a polygon's closed area.

    The segment is cut wherever it meets an edge (parallel edges cut it at their ends), and a
    piece counts when its midpoint is covered, so a piece along a border counts. ``inside(x, y)``
    decides that where the edges alone do not.
    """
    inside = inside or (lambda x, y: covers_edges(edge_array, x, y, metric=metric))
    sx, sy = bx - ax, by - ay
    norm = F.nullif(sx * sx + sy * sy, F.lit(0.0))

    def cuts(e: Column) -> Column:
        ex, ey = e["bx"] - e["ax"], e["by"] - e["ay"]
        det = F.nullif(sx * ey - sy * ex, F.lit(0.0))
        t = ((e["ax"] - ax) * ey - (e["ay"] - ay) * ex) / det
        u = ((e["ax"] - ax) * sy - (e["ay"] - ay) * sx) / det
        start = ((e["ax"] - ax) * sx + (e["ay"] - ay) * sy) / norm
        end = ((e["bx"] - ax) * sx + (e["by"] - ay) * sy) / norm
        meets = u.between(-1e-9, 1.0 + 1e-9)
        return F.when(det.isNull(), F.array(start, end)).otherwise(F.array(F.when(meets, t)))

    inner = F.filter(
        F.flatten(F.transform(edge_array, cuts)), lambda t: t.isNotNull() & (t > t0) & (t < t1)
    )
    stops = F.array_sort(F.array_distinct(F.concat(F.array(t0, t1), inner)))

    def covered(points: Column) -> Column:
        n = F.size(points)
        pieces = F.zip_with(
            F.slice(points, 1, F.greatest(n - 1, F.lit(0))),
            F.slice(points, 2, F.greatest(n - 1, F.lit(0))),
            lambda a, b: F.struct(a.alias("a"), b.alias("b")),
        )

        def share(piece: Column) -> Column:
            mid = (piece["a"] + piece["b"]) / 2.0
            return F.when(inside(ax + mid * sx, ay + mid * sy), piece["b"] - piece["a"]).otherwise(0.0)

        return _sum(pieces, share)

    return let(stops, covered)


def clipped_length(line: Column, poly: Column) -> Column:
    """Length of a line inside a polygon's closed area, both projected and in one row."""
    return _sum(
        edges(line),
        lambda s: F.hypot(s["bx"] - s["ax"], s["by"] - s["ay"])
        * covered_fraction(*_fields(s), F.lit(0.0), F.lit(1.0), edges(poly)),
    )


def ring_is_closed(ring: Column) -> Column:
    first, last = F.element_at(ring, 1), F.element_at(ring, -1)
    return (first["x"] == last["x"]) & (first["y"] == last["y"])


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def ring_problem(ring: Column, role: Column) -> Column:
    """The first structural problem of a ring, or NULL."""
    n = F.coalesce(F.size(ring), F.lit(0))
    ok = F.forall(ring, lambda p: p.isNotNull() & finite(p["x"]) & finite(p["y"]))
    return (
        F.when(n < 4, F.concat(role, F.lit(" ring with fewer than four positions")))
        .when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit("non-finite "), role, F.lit(" ring position")))
        .when(~ring_is_closed(ring), F.concat(F.lit("unclosed "), role, F.lit(" ring")))
    )


def structure_problem(geom: Column) -> Column:
    """The first structural reason a polygon cannot be a region outline, or NULL."""
    part_problems = F.flatten(
        F.transform(
            geom["parts"],
            lambda part: F.when(
                F.coalesce(F.size(part), F.lit(0)) == 0, F.array(F.lit("polygon without an exterior ring"))
            ).otherwise(
                F.transform(
                    part,
                    lambda ring, i: ring_problem(ring, F.when(i == 0, F.lit("exterior")).otherwise(F.lit("interior"))),
                )
            ),
        )
    )
    return (
        F.when(geom.isNull() | geom["type"].isNull(), "no geometry")
        .when(~geom["type"].isin("Polygon", "MultiPolygon"), "unsupported geometry")
        .when(F.coalesce(F.size(geom["parts"]), F.lit(0)) <= 0, "empty geometry")
        .otherwise(F.element_at(F.concat(F.filter(part_problems, lambda p: p.isNotNull()), F.array(F.lit(None).cast("string"))), 1))
    )
