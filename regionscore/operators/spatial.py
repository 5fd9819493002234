"""Spatial joins between features and regions, all of them equi-joins on grid cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionscore.functions import geometry as G
from regionscore.functions.projection import project_utm, with_utm
from regionscore.operators.nearest import nearest
from regionscore.operators.region_index import (
    KEY,
    RegionIndex,
    _anchors,
    build_index,
    cell_of,
    edge_cells,
    edge_rows,
    region_cells,
    segment_pieces,
)


def _usable(x: str, y: str) -> Column:
    return G.finite(F.col(x)) & G.finite(F.col(y))


def region_matches(
    points: DataFrame,
    index: RegionIndex,
    point_id: str,
    *,
    x: str = "lon",
    y: str = "lat",
    keep_where: Column | None = None,
) -> DataFrame:
    """Every point that lies in some region, with ``regions``: the sorted ids that cover it.

    With ``keep_where`` all points stay: those it holds for are looked up, and points in no
    region or not looked up have NULL. A point meets one row, the packed regions of its cell, so nothing is
    regrouped. In the cells where too many regions pile up to pack them, candidates are joined
    one by one and regrouped per id and place, so that records that share an id stay apart.
    """
    asked = _usable(x, y) if keep_where is None else keep_where & _usable(x, y)
    located = index.located(points if keep_where is not None else points.where(asked), x, y, asked)
    packed, crowded = index.packed()
    at = F.col(x), F.col(y)
    joined = located.join(packed, list(KEY), "left")
    # Most cells have one candidate, and most of those are full: no array work for them.
    several = F.array_sort(
        F.transform(
            F.filter("candidates", lambda c: c["full"] | index.covers(c["edges"], c["odd"], *at)), lambda c: c["region"]
        )
    )
    hits = (
        F.when(F.col("full"), F.array("region"))
        .when(F.col("candidates").isNotNull(), several)
        .when(index.covers(F.col("edges"), F.col("odd"), *at), F.array("region"))
    )
    matched = joined.withColumn("regions", hits).drop("region", "full", "edges", "odd", "candidates")
    if crowded.limit(1).count():
        pairs = (
            located.where(F.col("cx").isNotNull())
            .join(crowded, list(KEY))
            .where(F.col("full") | index.covers(F.col("edges"), F.col("odd"), *at))
            .groupBy(F.col(point_id).alias("__point"), F.col(x).alias("__at_x"), F.col(y).alias("__at_y"))
            .agg(F.array_sort(F.collect_set("region")).alias("__several"))
        )
        # a record without an id is matched like any other
        same = F.col(point_id).eqNullSafe(F.col("__point")) & (F.col(x) == F.col("__at_x")) & (F.col(y) == F.col("__at_y"))
        matched = matched.join(pairs, same & F.col("cx").isNotNull(), "left")
        matched = matched.withColumn("regions", F.coalesce("__several", "regions")).drop("__point", "__at_x", "__at_y", "__several")
    matched = matched.drop(*KEY)
    return matched.where(F.size("regions") > 0) if keep_where is None else matched


def assign_regions(
    points: DataFrame,
    regions: DataFrame | None = None,
    *,
    point_id: str,
    region_id: str = "nuts_code",
    geom: str = "geom",
    x: str = "lon",
    y: str = "lat",
    ambiguous: str = "lowest",
    index: RegionIndex | None = None,
) -> DataFrame:
    """Points with the region that covers them, borders included.

    ``ambiguous`` decides about a point several regions cover: ``lowest`` gives it to the lowest
    id, ``reject`` drops it, ``all`` repeats it for each region. Points in no region drop out.
    """
    index = index or build_index(regions, region_id, geom)
    matched = region_matches(points, index, point_id, x=x, y=y)
    if ambiguous == "all":
        return matched.withColumn(region_id, F.explode("regions")).drop("regions")
    if ambiguous == "reject":
        matched = matched.where(F.size("regions") == 1)
    elif ambiguous != "lowest":
        raise ValueError(f"unknown rule for ambiguous points: {ambiguous}")
    return matched.withColumn(region_id, F.get("regions", F.lit(0))).drop("regions")


def in_any_region(
    points: DataFrame,
    regions: DataFrame | None = None,
    *,
    region_id: str = "nuts_code",
    geom: str = "geom",
    x: str = "lon",
    y: str = "lat",
    index: RegionIndex | None = None,
) -> DataFrame:
    """Points covered by at least one region: membership in the union without building it."""
    index = index or build_index(regions, region_id, geom)
    located = index.located(points.where(_usable(x, y)), x, y)
    cells = index.cells.select(*[F.col(c).alias(f"__{c}") for c in index.cells.columns])
    inside = F.col("__full") | index.covers(F.col("__edges"), F.col("__odd"), F.col(x), F.col(y))
    on = (F.col("depth") == F.col("__depth")) & (F.col("cx") == F.col("__cx")) & (F.col("cy") == F.col("__cy")) & inside
    return located.join(cells, on, "left_semi").drop(*KEY)


def count_in_regions(
    points: DataFrame,
    regions: DataFrame,
    aggregates: dict[str, Column],
    *,
    point_id: str,
    region_id: str = "nuts_code",
    geom: str = "geom",
    x: str = "lon",
    y: str = "lat",
    index: RegionIndex | None = None,
) -> DataFrame:
    """Per-region aggregates of the points each region covers; a region without points stays.

    A point on a shared border counts for both neighbours. Aggregates of an empty region come
    out as NULL; the caller decides which of them mean zero.
    """
    hits = assign_regions(
        points, regions, point_id=point_id, region_id=region_id, geom=geom, x=x, y=y, ambiguous="all", index=index
    )
    rolled = hits.groupBy(region_id).agg(*[c.alias(name) for name, c in aggregates.items()])
    return regions.select(region_id).join(rolled, region_id, "left")


def _touches(index: RegionIndex) -> Column:
    """Whether a segment piece and its candidate region share a point."""
    ax, ay, bx, by = (F.col(f) for f in G.EDGE_FIELDS)
    mid = F.least(F.greatest((F.col("t0") + F.col("t1")) / 2.0, F.lit(0.0)), F.lit(1.0))
    meets = F.exists(
        "edges",
        lambda e: G.segments_meet(
            ax, ay, bx, by, e["ax"], e["ay"], e["bx"], e["by"], slack=G.BORDER_TOLERANCE
        ),
    )
    mid_covered = index.covers(F.col("edges"), F.col("odd"), ax + mid * (bx - ax), ay + mid * (by - ay))
    return F.col("full") & (F.col("t0") <= F.col("t1")) | meets | (F.col("t0") <= F.col("t1")) & mid_covered


def containing(features: DataFrame, feature_id: str, anchors: DataFrame, *, geom: str = "geom") -> DataFrame | None:
    """``(region, feature)`` for polygon features that cover a position of ``anchors(region, x, y)``; None without polygons."""
    areas = features.where(F.col(f"{geom}.type").isin("Polygon", "MultiPolygon"))
    if not areas.limit(1).count():
        return None
    found = assign_regions(
        anchors.withColumnRenamed("region", "__region"), point_id="__region", region_id="feature", x="x", y="y", ambiguous="all",
        index=build_index(areas, feature_id, geom),
    )
    return found.select(F.col("__region").alias("region"), "feature").distinct()


def intersect_pairs(
    features: DataFrame,
    feature_id: str,
    index: RegionIndex,
    *,
    geom: str = "geom",
    region_id: str = "nuts_code",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Distinct ``(region, feature)`` pairs of features of any kind that meet a region.

    A feature meets a region when one of its edges touches the region, or when it is a polygon around a part of the
    region: then it covers any position of that part, so one position of each is looked up among the
    polygon features. ``keep`` columns of the feature travel along, so the features need not be joined again.
    """
    pieces = index.cut(edge_rows(features, [feature_id, *keep], geom))
    hits = pieces.join(index.cells, list(KEY)).where(_touches(index)).select("region", feature_id, *keep)
    around = containing(features, feature_id, index.anchors, geom=geom)
    if around is not None:
        named = around.withColumnRenamed("feature", feature_id)
        hits = hits.unionByName(named.join(features.select(feature_id, *keep), feature_id) if keep else named)
    return (
        hits.groupBy(F.col("region").alias(region_id), feature_id)
        .agg(F.lit(True).alias("__met"), *[F.first(c).alias(c) for c in keep])
        .drop("__met")
    )


def clip_lengths(
    lines: DataFrame,
    regions: DataFrame,
    *,
    line_id: str,
    region_id: str = "nuts_code",
    geom: str = "geom",
    projected: str = "geom_m",
    keep: Sequence[str] = (),
    index: RegionIndex | None = None,
    metric_index: RegionIndex | None = None,
) -> DataFrame:
    """``(region, line, *keep, length_km)`` for every line that meets a region in degrees.

    The length is measured in metres on the projected shapes, so a line that only touches a
    region appears with length zero, and a line along a shared border counts for both sides.
    Pieces are cut by the grid first: cells do not overlap, so nothing is counted twice.
    """
    index = index or build_index(regions, region_id, geom)
    metric_index = metric_index or build_index(regions, region_id, projected, metric=True)
    segments = edge_rows(lines, [line_id, *keep], geom)

    touching = (
        index.cut(segments)
        .join(index.cells, list(KEY))
        .where(_touches(index))
        .select("region", line_id, *keep, F.lit(True).alias("meets"), F.lit(0.0).alias("metres"))
    )
    flat = with_utm(with_utm(segments, "ax", "ay", "px", "py"), "bx", "by", "qx", "qy").select(
        line_id, *keep, F.col("px").alias("ax"), F.col("py").alias("ay"), F.col("qx").alias("bx"), F.col("qy").alias("by")
    )
    ax, ay, bx, by = (F.col(f) for f in G.EDGE_FIELDS)
    t0, t1 = F.col("t0"), F.col("t1")

    def inside(px: Column, py: Column) -> Column:
        return metric_index.covers(F.col("edges"), F.col("odd"), px, py)

    share = F.when(F.col("full"), t1 - t0).otherwise(G.covered_fraction(ax, ay, bx, by, t0, t1, F.col("edges"), inside=inside))
    measured = (
        metric_index.cut(flat)
        .where(t1 > t0)
        .join(metric_index.cells, list(KEY))
        .select(
            "region", line_id, *keep, F.lit(False).alias("meets"), (F.hypot(bx - ax, by - ay) * share).alias("metres")
        )
    )
    return (
        touching.unionByName(measured)
        .groupBy("region", line_id)
        .agg(F.max("meets").alias("meets"), F.sum("metres").alias("metres"), *[F.first(c).alias(c) for c in keep])
        .where("meets")
        .select(F.col("region").alias(region_id), line_id, *keep, (F.col("metres") / 1000.0).alias("length_km"))
    )


def point_segments(points: DataFrame, point_id: str, x: str, y: str) -> DataFrame:
    """Points in the segment form ``(id, ax, ay, bx, by)``."""
    return points.where(G.finite(F.col(x)) & G.finite(F.col(y))).select(
        point_id, F.col(x).alias("ax"), F.col(y).alias("ay"), F.col(x).alias("bx"), F.col(y).alias("by")
    )


def metre_segments(features: DataFrame, feature_id: str, geom: str = "geom") -> DataFrame:
    """Features of any kind as projected segments ``(id, ax, ay, bx, by)`` in metres."""
    flat = edge_rows(features, [feature_id], geom)
    return with_utm(with_utm(flat, "ax", "ay", "px", "py"), "bx", "by", "qx", "qy").select(
        feature_id, F.col("px").alias("ax"), F.col("py").alias("ay"), F.col("qx").alias("bx"), F.col("qy").alias("by")
    )


def _near_cells(edges: DataFrame, cells: DataFrame, metres: float, cell: float) -> tuple[DataFrame, DataFrame]:
    """Cells wholly within the margin, and for the rest the edges that may be within it.

    An edge is spread over the cells that the box of its part in a cell reaches, and dropped where it is farther than
    the margin from the cell.
    """
    pieces = segment_pieces(edges, cell).where("t0 <= t1")
    inner = pieces.select("cx", "cy").unionByName(cells.select("cx", "cy")).distinct()

    def ends(a: str, b: str) -> list[Column]:
        return [F.col(a) + F.col(t) * (F.col(b) - F.col(a)) for t in ("t0", "t1")]

    xs, ys = ends("ax", "bx"), ends("ay", "by")
    box = pieces.select(
        *G.EDGE_FIELDS, F.least(*xs).alias("x0"), F.greatest(*xs).alias("x1"), F.least(*ys).alias("y0"), F.greatest(*ys).alias("y1")
    )
    spread = box.withColumn("cx", F.explode(F.sequence(cell_of(F.col("x0") - metres, cell), cell_of(F.col("x1") + metres, cell)))).withColumn(
        "cy", F.explode(F.sequence(cell_of(F.col("y0") - metres, cell), cell_of(F.col("y1") + metres, cell)))
    )
    gap_x = F.greatest(F.col("cx") * F.lit(cell) - F.col("x1"), F.col("x0") - (F.col("cx") + 1) * F.lit(cell), F.lit(0.0))
    gap_y = F.greatest(F.col("cy") * F.lit(cell) - F.col("y1"), F.col("y0") - (F.col("cy") + 1) * F.lit(cell), F.lit(0.0))
    near = spread.where(F.hypot(gap_x, gap_y) <= metres * (1 + 1e-9)).join(inner, ["cx", "cy"], "left_anti")
    outer = near.select("cx", "cy", *G.EDGE_FIELDS).distinct()
    return inner, outer


def within_distance(
    features: DataFrame,
    regions: DataFrame,
    *,
    feature_id: str,
    region_id: str = "nuts_code",
    geom: str = "geom",
    projected: str = "geom_m",
    metres: float = 10_000.0,
) -> DataFrame:
    """Features that lie in a region or within ``metres`` of one (a context margin).

    Cells are small enough that any cell an edge passes lies wholly inside the margin. Only the
    cells around them need a distance, and that is a semi-join: the first edge close enough ends
    the search, whatever the number of features in a cell. A polygon feature around a region may have
    no edge near it; it covers a position of the region.
    """
    cell = metres / 2.0
    metric = regions.select(F.col(region_id).alias("region"), F.col(projected).alias("__g"))
    edges = edge_rows(metric, [], "__g")
    inside = region_cells(metric, "region", "__g", cell, metric=True).where("full").select("cx", "cy")
    inner, outer = _near_cells(edges, inside, metres, cell)
    pieces = edge_cells(metre_segments(features, feature_id, geom), cell, 0.0)
    sure = pieces.join(inner, ["cx", "cy"], "left_semi").select(feature_id)
    p, o = pieces.alias("p"), outer.alias("o")
    close = (
        G.segment_distance(
            *[F.col(f"p.{f}") for f in G.EDGE_FIELDS], *[F.col(f"o.{f}") for f in G.EDGE_FIELDS]
        )
        <= metres
    )
    near = p.join(
        o, (F.col("p.cx") == F.col("o.cx")) & (F.col("p.cy") == F.col("o.cy")) & close, "left_semi"
    ).select(feature_id)
    found = sure.unionByName(near)
    around = containing(features, feature_id, _anchors(regions, region_id, geom), geom=geom)
    if around is not None:
        found = found.unionByName(around.select(F.col("feature").alias(feature_id)))
    return features.join(found.distinct(), feature_id, "left_semi")


def with_region_measures(regions: DataFrame, *, geom: str = "geom") -> DataFrame:
    """Add the projected outline, its area and its centroid."""
    projected = regions.withColumn("geom_m", project_utm(F.col(geom)))
    return projected.withColumns(
        {"area_km2": G.area_m2(F.col("geom_m")) / 1e6, "__c": G.centroid(F.col("geom_m"))}
    ).select(
        *[c for c in regions.columns if c not in ("geom_m", "area_km2", "centroid_x", "centroid_y")],
        "geom_m",
        "area_km2",
        F.col("__c.x").alias("centroid_x"),
        F.col("__c.y").alias("centroid_y"),
    )


def read_box(
    df: DataFrame,
    west: float,
    south: float,
    east: float,
    north: float,
    *,
    lon: str = "lon",
    lat: str = "lat",
    where: Column | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Rows inside a box (plain comparisons, so they reach the Parquet statistics)."""
    out = df.where(F.col(lon).between(west, east) & F.col(lat).between(south, north))
    if where is not None:
        out = out.where(where)
    return out.limit(limit) if limit is not None else out


def nearest_feature(
    origins: DataFrame,
    features: DataFrame,
    *,
    origin_id: str,
    feature_id: str,
    geom: str = "geom",
    x: str = "centroid_x",
    y: str = "centroid_y",
    cell: float | None = None,
) -> DataFrame:
    """Nearest feature of any kind; an origin inside a polygon feature is at distance zero."""
    renamed = features.select(F.col(feature_id).alias("__feature"), F.col(geom).alias("__g"))
    best = nearest(
        origins, metre_segments(renamed, "__feature", "__g"), origin_id=origin_id, feature_id="__feature", x=x, y=y, cell=cell
    )
    areas = renamed.where(F.col("__g.type").isin("Polygon", "MultiPolygon"))
    if not areas.limit(1).count():
        return best.withColumnRenamed("__feature", feature_id)
    projected = areas.select("__feature", project_utm(F.col("__g")).alias("__g"))
    inside = assign_regions(
        origins.select(origin_id, F.col(x).alias("__x"), F.col(y).alias("__y")),
        point_id=origin_id,
        region_id="__inside",
        x="__x",
        y="__y",
        index=build_index(projected, "__feature", "__g", metric=True),
    ).select(origin_id, "__inside")
    return best.join(inside, origin_id, "left").select(
        origin_id,
        F.coalesce("__inside", "__feature").alias(feature_id),
        F.when(F.col("__inside").isNotNull(), 0.0).otherwise(F.col("distance_m")).alias("distance_m"),
    )
