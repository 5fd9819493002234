"""WGS84 degrees to UTM metres (Krueger series, GRS80) as Column arithmetic.

The series is written as stages whose results are reused by the next stage. On flat rows a
stage is one ``withColumns`` (so the optimizer computes each intermediate once inside a single
generated loop); on nested geometry a stage binds its results through ``let``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the GRS80 ellipsoid and the UTM grid.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257222101
SCALE = 0.9996
FALSE_EASTING = 500000.0

_N = FLATTENING / (2 - FLATTENING)
RECTIFYING = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ECCENTRICITY = 2 * math.sqrt(_N) / (1 + _N)
ALPHA = (
    _N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3 + 41 / 180 * _N**4,
    13 / 48 * _N**2 - 3 / 5 * _N**3 + 557 / 1440 * _N**4,
    61 / 240 * _N**3 - 103 / 140 * _N**4,
    49561 / 161280 * _N**4,
)

Names = Callable[[str], Column]


def _angles(lon: Column, lat: Column, lon0: float) -> dict[str, Column]:
    return {"s": F.sin(F.radians(lat)), "d": F.radians(lon - F.lit(lon0))}


def _conformal(v: Names) -> dict[str, Column]:
    return {
        "t": F.sinh(F.atanh(v("s")) - F.lit(ECCENTRICITY) * F.atanh(F.lit(ECCENTRICITY) * v("s"))),
        "cd": F.cos(v("d")),
        "sd": F.sin(v("d")),
    }


def _sphere(v: Names) -> dict[str, Column]:
    return {
        "xi": F.atan2(v("t"), v("cd")),
        "eta": F.asinh(v("sd") / F.sqrt(v("t") * v("t") + v("cd") * v("cd"))),
    }


def _double_angles(v: Names) -> dict[str, Column]:
    two_xi, two_eta = v("xi") * 2.0, v("eta") * 2.0
    return {
        "xi": v("xi"),
        "eta": v("eta"),
        "c2": F.cos(two_xi),
        "s2": F.sin(two_xi),
        "ch2": F.cosh(two_eta),
        "sh2": F.sinh(two_eta),
    }


def _fourth_angles(v: Names) -> dict[str, Column]:
    keep = {name: v(name) for name in ("xi", "eta", "c2", "s2", "ch2", "sh2")}
    return keep | {
        "c4": 2.0 * v("c2") * v("c2") - 1.0,
        "s4": 2.0 * v("s2") * v("c2"),
        "ch4": 2.0 * v("ch2") * v("ch2") - 1.0,
        "sh4": 2.0 * v("sh2") * v("ch2"),
    }


def _series(v: Names) -> tuple[Column, Column]:
    """Easting and northing from the double and fourth angles (sixth and eighth by addition)."""
    a1, a2, a3, a4 = (F.lit(a) for a in ALPHA)
    c6 = v("c4") * v("c2") - v("s4") * v("s2")
    s6 = v("s4") * v("c2") + v("c4") * v("s2")
    ch6 = v("ch4") * v("ch2") + v("sh4") * v("sh2")
    sh6 = v("sh4") * v("ch2") + v("ch4") * v("sh2")
    c8 = 2.0 * v("c4") * v("c4") - 1.0
    s8 = 2.0 * v("s4") * v("c4")
    ch8 = 2.0 * v("ch4") * v("ch4") - 1.0
    sh8 = 2.0 * v("sh4") * v("ch4")
    east = (
        v("eta") + a1 * v("c2") * v("sh2") + a2 * v("c4") * v("sh4") + a3 * c6 * sh6 + a4 * c8 * sh8
    )
    north = (
        v("xi") + a1 * v("s2") * v("ch2") + a2 * v("s4") * v("ch4") + a3 * s6 * ch6 + a4 * s8 * ch8
    )
    k = F.lit(SCALE * RECTIFYING)
    return F.lit(FALSE_EASTING) + k * east, k * north


_STAGES = (_conformal, _sphere, _double_angles, _fourth_angles)


def with_utm(
    df: DataFrame, lon: str, lat: str, x: str = "x", y: str = "y", *, lon0: float = 9.0
) -> DataFrame:
    """Add projected metres for a flat ``(lon, lat)`` pair."""
    prefix = f"__utm_{x}_"
    name: Names = lambda part: F.col(prefix + part)
    kept = df.columns
    out = df.withColumns(
        {prefix + k: c for k, c in _angles(F.col(lon).cast("double"), F.col(lat).cast("double"), lon0).items()}
    )
    for stage in _STAGES:
        out = out.withColumns({prefix + k: c for k, c in stage(name).items()})
    east, north = _series(name)
    # The row marker keeps this projection in one place: otherwise a filter on x or y would be
    # pushed below it with the whole series written out once per use.
    here = F.monotonically_increasing_id() >= 0
    return out.select(
        *[c for c in kept if c not in (x, y)], F.when(here, east).alias(x), F.when(here, north).alias(y)
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for use in ``body`` (inside nested array functions)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def utm_position(lon: Column, lat: Column, *, lon0: float = 9.0) -> Column:
    """``struct<x, y>`` in metres for one position; for use inside array lambdas."""

    def run(stages, bound: Column) -> Column:
        names: Names = lambda part: bound[part]
        if not stages:
            east, north = _series(names)
            return F.struct(east.alias("x"), north.alias("y"))
        parts = [c.alias(k) for k, c in stages[0](names).items()]
        return let(F.struct(*parts), lambda nxt: run(stages[1:], nxt))

    first = F.struct(*[c.alias(k) for k, c in _angles(lon, lat, lon0).items()])
    return let(first, lambda bound: run(_STAGES, bound))


def project_utm(geom: Column, *, lon0: float = 9.0) -> Column:
    """A geometry column from degrees to metres, keeping its type and nesting."""
    return F.struct(
        geom["type"].alias("type"),
        F.transform(
            geom["parts"],
            lambda part: F.transform(
                part,
                lambda ring: F.transform(ring, lambda p: utm_position(p["x"], p["y"], lon0=lon0)),
            ),
        ).alias("parts"),
    )
