"""GeoJSON text to and from the geometry column.

Coordinates nest by type, so a reader keeps them as JSON text and the type decides the shape.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regionscore.functions.geometry import finite

RAW_GEOMETRY = "struct<type: string, coordinates: string>"

_P = "array<double>"
_PP = f"array<{_P}>"
_PPP = f"array<{_PP}>"
_PPPP = f"array<{_PPP}>"


def _pos(p: Column) -> Column:
    return F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))


def _line(line: Column) -> Column:
    return F.transform(line, _pos)


def geometry_from_json(kind: Column, coordinates: Column) -> Column:
    """Geometry column from a GeoJSON type and its raw coordinates; extra dimensions are dropped."""
    c = coordinates
    parts = (
        F.when(kind == "Point", F.array(F.array(F.array(_pos(F.from_json(c, _P))))))
        .when(kind == "MultiPoint", F.transform(F.from_json(c, _PP), lambda p: F.array(F.array(_pos(p)))))
        .when(kind == "LineString", F.array(F.array(_line(F.from_json(c, _PP)))))
        .when(kind == "MultiLineString", F.transform(F.from_json(c, _PPP), lambda li: F.array(_line(li))))
        .when(kind == "Polygon", F.array(F.transform(F.from_json(c, _PPP), _line)))
        .when(
            kind == "MultiPolygon",
            F.transform(F.from_json(c, _PPPP), lambda poly: F.transform(poly, _line)),
        )
    )
    return F.when(parts.isNotNull(), F.struct(kind.alias("type"), parts.alias("parts")))


def _xy(p: Column) -> Column:
    return F.array(p["x"], p["y"])


def _xys(line: Column) -> Column:
    return F.transform(line, _xy)


def geometry_to_json(geom: Column) -> Column:
    """GeoJSON text of a geometry column."""
    kind, parts = geom["type"], geom["parts"]
    coordinates = (
        F.when(kind == "Point", F.to_json(_xy(parts[0][0][0])))
        .when(kind == "MultiPoint", F.to_json(F.transform(parts, lambda p: _xy(p[0][0]))))
        .when(kind == "LineString", F.to_json(_xys(parts[0][0])))
        .when(kind == "MultiLineString", F.to_json(F.transform(parts, lambda p: _xys(p[0]))))
        .when(kind == "Polygon", F.to_json(F.transform(parts[0], _xys)))
        .when(kind == "MultiPolygon", F.to_json(F.transform(parts, lambda p: F.transform(p, _xys))))
    )
    return F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), coordinates, F.lit("}"))


def _is_position(p: Column) -> Column:
    return (F.size(p) >= 2) & F.forall(p, finite)


def _all(array: Column, rule, least: int = 1) -> Column:
    return (F.size(array) >= least) & F.forall(array, rule)


def _is_line(line: Column) -> Column:
    return _all(line, _is_position, 2)


def _is_ring(ring: Column) -> Column:
    return _all(ring, _is_position, 4) & (F.element_at(ring, 1) == F.element_at(ring, -1))


def _is_polygon(rings: Column) -> Column:
    return _all(rings, _is_ring)


def geojson_is_valid(kind: Column, coordinates: Column, members: Column | None = None) -> Column:
    """Whether a GeoJSON geometry follows the grammar of its type.

    ``members`` is the ``array<struct<type, coordinates>>`` of a GeometryCollection.
    """

    def simple(k: Column, c: Column) -> Column:
        return F.coalesce(
            F.when(k == "Point", _is_position(F.from_json(c, _P)))
            .when(k == "MultiPoint", _all(F.from_json(c, _PP), _is_position))
            .when(k == "LineString", _is_line(F.from_json(c, _PP)))
            .when(k == "MultiLineString", _all(F.from_json(c, _PPP), _is_line))
            .when(k == "Polygon", _is_polygon(F.from_json(c, _PPP)))
            .when(k == "MultiPolygon", _all(F.from_json(c, _PPPP), _is_polygon)),
            F.lit(False),
        )

    if members is None:
        return simple(kind, coordinates)
    collection = F.coalesce(_all(members, lambda m: simple(m["type"], m["coordinates"])), F.lit(False))
    return F.when(kind == "GeometryCollection", collection).otherwise(simple(kind, coordinates))
