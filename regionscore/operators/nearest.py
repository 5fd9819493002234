"""Nearest feature in metres, exact, without pairing everything with everything.

The features are cut into cells of a grid. A cell that holds too many of them is cut again, and again,
where it is crowded and nowhere else; so every leaf of this quadtree (sixteen children a node) has few
features, whatever places they crowd in. Most origins are settled by the nine cells around them, packed in one row.
A feature longer than a cell has a piece in every cell it passes, so cutting crowded cells multiplies long features;
cells are therefore cut no finer than the number of origins repays, and a bounded number of origins needs no cells at
all: they travel to the features, which are read in place.

The others descend the tree, all of them one level at a time: a node carries the tight box of its
features, which gives the least distance any of them can have and, since every side of a tight box
is touched by one, a distance that one of them does have at most. The smallest of the latter bounds the
answer and is tightened at every level; nodes farther than the bound are left behind. An origin
thus meets a few nodes a level, however far away or crowded the features are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionscore.functions.geometry import EDGE_FIELDS, finite, point_segment_distance
from regionscore.operators.region_index import cell_of, segment_pieces
from regionscore.storage import materialize

#: Children of a node along each axis.
STEP = 4
MAX_FEATURES_PER_LEAF = 64
#: Up to so many origins are broadcast and meet every feature.
FEW_ORIGINS = 64
SMALLEST_CELL_M = 1e-3
BOX = ("x0", "y0", "x1", "y1")


def suggest_cell(segments: DataFrame) -> float:
    """A cell holding one or two features on average, no shorter than the average feature.

    Nine such cells seldom leave an origin among the features open.
    """
    mid_x, mid_y = (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2
    w, h, n, longest = segments.agg(
        F.max(mid_x) - F.min(mid_x),
        F.max(mid_y) - F.min(mid_y),
        F.count("*"),
        F.avg(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))),
    ).first()
    if not n:
        return 1000.0
    return max(SMALLEST_CELL_M, 1.3 * math.sqrt(max(w, 1.0) * max(h, 1.0) / n), longest or 0.0)


@dataclass(frozen=True)
class Quadtree:
    """Leaves ``(level, px, py, feature, edge, box)``; a cell of ``level`` is ``cell * STEP ** level`` wide.

    Level 0 is the grid; crowded cells continue at negative levels, and ``crowded(px, py)`` lists those of level 0.
    """

    cell: float
    bottom: int
    leaves: DataFrame
    crowded: DataFrame | None
    most: int = MAX_FEATURES_PER_LEAF

    def size(self, level: int) -> float:
        return self.cell * STEP**level


def _pieces(segments: DataFrame, size: float, feature_id: str) -> DataFrame:
    """The features of each cell of one size, with the box of the part inside the cell."""

    def at(a: str, b: str, t: str) -> Column:
        return F.col(a) + F.col(t) * (F.col(b) - F.col(a))

    cut = segment_pieces(segments, size).where("t0 <= t1")
    xs, ys = [[at(a, b, t) for t in ("t0", "t1")] for a, b in (("ax", "bx"), ("ay", "by"))]
    box = (F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))
    return cut.select(
        F.col("cx").alias("px"), F.col("cy").alias("py"), feature_id, *EDGE_FIELDS, *[c.alias(n) for n, c in zip(BOX, box, strict=True)]
    )


def build_quadtree(segments: DataFrame, feature_id: str, cell: float, most: int = MAX_FEATURES_PER_LEAF) -> Quadtree:
    """Cut segments into cells, and crowded cells into smaller ones until none has more than ``most`` features.

    Each round reads the features of crowded cells alone. Distinct features in one place cannot be told apart by
    cells; there the smallest cell ends the division.
    """
    pieces = materialize(_pieces(segments, cell, feature_id), "pieces")
    leaves, first, level = [], None, 0
    while True:
        full = pieces.groupBy("px", "py").agg(F.count("*").alias("n")).where(F.col("n") > most).select("px", "py")
        finer = cell * STEP ** (level - 1)
        if finer < SMALLEST_CELL_M or not full.count():
            leaves.append(pieces.withColumn("level", F.lit(level)))
            break
        crowded = materialize(full, "crowded")
        first = crowded if first is None else first
        leaves.append(pieces.join(crowded, ["px", "py"], "left_anti").withColumn("level", F.lit(level)))
        parents = pieces.join(crowded, ["px", "py"], "left_semi")
        parents = parents.select(F.col("px").alias("ux"), F.col("py").alias("uy"), feature_id, *EDGE_FIELDS)
        # of the cells a feature passes, those inside the crowded one; its other cells have it too
        cut = _pieces_within(parents, finer, feature_id)
        pieces, level = materialize(cut, "pieces"), level - 1
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return Quadtree(cell, level, out, first, most)


def _pieces_within(parents: DataFrame, size: float, feature_id: str) -> DataFrame:
    tagged = parents.withColumn(feature_id, F.struct(F.col(feature_id).alias("f"), "ux", "uy"))
    cut = _pieces(tagged, size, feature_id)
    inside = (F.floor(F.col("px") / STEP) == F.col(f"{feature_id}.ux")) & (F.floor(F.col("py") / STEP) == F.col(f"{feature_id}.uy"))
    return cut.where(inside).withColumn(feature_id, F.col(f"{feature_id}.f"))


def _to_segment() -> Column:
    return point_segment_distance(F.col("x"), F.col("y"), *[F.col(f) for f in EDGE_FIELDS])


def _length(dx: Column, dy: Column) -> Column:
    """For bounds, which allow for rounding."""
    return F.sqrt(dx * dx + dy * dy)


def _least(box: Column) -> Column:
    """Distance from the origin to a box: nothing in it is nearer."""
    dx = F.greatest(box["x0"] - F.col("x"), F.col("x") - box["x1"], F.lit(0.0))
    dy = F.greatest(box["y0"] - F.col("y"), F.col("y") - box["y1"], F.lit(0.0))
    return _length(dx, dy)


def _most(box: Column) -> Column:
    """A distance that some feature in a tight box has at most.

    Each side is touched; the feature touching the nearer side of one axis is no farther than that side's far end.
    """
    to_x, to_y = F.abs(F.col("x") - (box["x0"] + box["x1"]) / 2), F.abs(F.col("y") - (box["y0"] + box["y1"]) / 2)
    half_x, half_y = (box["x1"] - box["x0"]) / 2, (box["y1"] - box["y0"]) / 2
    return F.least(_length(to_x - half_x, to_y + half_y), _length(to_x + half_x, to_y - half_y))


def _within(distance: Column, bound: Column) -> Column:
    return distance <= bound * (1 + 1e-9) + 1e-6


def nearest(
    origins: DataFrame,
    segments: DataFrame,
    *,
    origin_id: str,
    feature_id: str,
    x: str = "centroid_x",
    y: str = "centroid_y",
    cell: float | None = None,
) -> DataFrame:
    """``(origin, feature, distance_m)`` for every origin; both NULL when there is no feature.

    ``segments`` is ``(feature_id, ax, ay, bx, by)`` in metres. Features equally near are
    decided by the lowest id. Several features in one place are first reduced to that lowest id.
    """
    places = origins.select(F.col(origin_id), F.col(x).alias("x"), F.col(y).alias("y"))
    count = places.count()
    if count <= FEW_ORIGINS:
        return _of_few(places, segments, origin_id, feature_id)
    # Written once: read by the choice of the cell and by the division.
    segments = materialize(segments.groupBy(*EDGE_FIELDS).agg(F.min(feature_id).alias(feature_id)), "features")
    # An origin meets a few leaves: leaves of this size cost all origins together no more than reading the features a few times.
    most = max(MAX_FEATURES_PER_LEAF, segments.count() // count)
    tree = build_quadtree(segments, feature_id, cell or suggest_cell(segments), most)
    close = materialize(_in_block(places, tree, origin_id, feature_id), "nearest")
    open_ = F.col("distance_m").isNull() | (F.col("distance_m") > F.col("reach"))
    settled = close.where(~open_).drop("reach", "x", "y")
    rest = close.where(open_)
    if not rest.limit(1).count():
        return settled
    found = descend(rest.select(origin_id, "x", "y", F.col("distance_m").alias("bound")), tree, origin_id, feature_id)
    answers = rest.select(origin_id).join(found, origin_id, "left").select(*settled.columns)
    return settled.unionByName(answers)


def _of_few(places: DataFrame, segments: DataFrame, origin_id: str, feature_id: str) -> DataFrame:
    """The nearest feature of a bounded number of origins: the features stay where they are and meet all of them.

    One pass finds the distances, a second one the lowest id among the features at that distance.
    """
    segments = materialize(segments.select(feature_id, *EDGE_FIELDS), "features")
    usable = places.where(finite(F.col("x")) & finite(F.col("y")) & F.col(origin_id).isNotNull())
    met = segments.crossJoin(F.broadcast(usable)).select(origin_id, F.col(feature_id).alias("f"), _to_segment().alias("d"))
    least = materialize(met.groupBy(origin_id).agg(F.min("d").alias("distance_m")), "distances")
    first = met.join(F.broadcast(least), origin_id).where(F.col("d") == F.col("distance_m"))
    found = least.join(first.groupBy(origin_id).agg(F.min("f").alias(feature_id)), origin_id, "left")
    return places.select(origin_id).join(F.broadcast(found), origin_id, "left").select(origin_id, feature_id, "distance_m")


def _blocks(tree: Quadtree, feature_id: str) -> DataFrame:
    """Per cell the uncrowded features of the 3 x 3 cells around it; a row without a feature tells that one of these is crowded.

    Features are laid out for their neighbours, not origins, which are usually more.
    """
    here = tree.leaves.where("level = 0").select("px", "py", feature_id, *EDGE_FIELDS)
    if tree.crowded is not None:
        here = here.unionByName(tree.crowded, allowMissingColumns=True)
    for c in ("px", "py"):
        here = here.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    return here


def _least_of(places: DataFrame, features: DataFrame, on: list[str], *more: Column) -> DataFrame:
    """Places that meet features, with the least distance to one: numbers alone, so no pairs are sorted."""
    return places.join(features, on).groupBy(*places.columns).agg(F.min(_to_segment()).alias("distance_m"), *more)


def _lowest_of(places: DataFrame, features: DataFrame, on: list[str], feature_id: str) -> DataFrame:
    """The lowest id among the features at ``distance_m``."""
    at = places.join(features, on).where(_to_segment().eqNullSafe(F.col("distance_m")))
    return at.groupBy(*places.columns).agg(F.min(feature_id).alias(feature_id))


def _in_block(places: DataFrame, tree: Quadtree, origin_id: str, feature_id: str) -> DataFrame:
    """The nearest feature among the uncrowded ones of the 3 x 3 cells around each origin.

    It is the answer when it is no farther than ``reach``, the distance to the block's border; next to a
    crowded cell nothing is settled.
    """
    cell = tree.cell
    here = places.withColumns({"px": cell_of(F.col("x"), cell), "py": cell_of(F.col("y"), cell)})
    blocks = _blocks(tree, feature_id)
    least = _least_of(here, blocks, ["px", "py"], F.bool_or(F.col("ax").isNull()).alias("crowded"))
    found = F.when(F.col("distance_m").isNotNull(), F.struct(F.col("distance_m").alias("d"), F.col(feature_id).alias("f")))
    best = _lowest_of(least, blocks, ["px", "py"], feature_id).groupBy(origin_id).agg(F.min(found).alias("best"), F.max("crowded").alias("crowded"))

    def gap(value: str) -> Column:
        inner = F.col(value) - cell_of(F.col(value), cell) * F.lit(cell)
        return F.least(inner, F.lit(cell) - inner) + F.lit(cell)

    return places.join(best, origin_id, "left").select(
        origin_id,
        "x",
        "y",
        F.col("best.f").alias(feature_id),
        F.col("best.d").alias("distance_m"),
        F.when(F.coalesce("crowded", F.lit(False)), F.lit(-1.0)).otherwise(F.least(gap("x"), gap("y"))).alias("reach"),
    )


def _nodes(tree: Quadtree) -> tuple[DataFrame, int]:
    """All nodes with their tight boxes, and the level at which at most 5 x 5 of them hold everything."""
    leaf = tree.leaves.groupBy("level", "px", "py").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )
    leaf = materialize(leaf, "leaf_nodes")
    span = leaf.agg(F.greatest(F.max("x1") - F.min("x0"), F.max("y1") - F.min("y0"))).first()[0]
    top = 0
    while span is not None and span > tree.size(top) * STEP:
        top += 1
    up = F.pow(F.lit(float(STEP)), F.col("at") - F.col("level"))
    every = leaf.withColumn("at", F.explode(F.sequence(F.col("level"), F.lit(top)))).select(
        "at", (F.col("at") == F.col("level")).alias("leaf"), F.floor(F.col("px") / up).alias("px"), F.floor(F.col("py") / up).alias("py"), *BOX
    )
    nodes = every.groupBy(F.col("at").alias("level"), "px", "py").agg(
        F.bool_or("leaf").alias("leaf"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )
    return materialize(nodes, "nodes"), top


def descend(places: DataFrame, tree: Quadtree, origin_id: str, feature_id: str, *, visited: list | None = None) -> DataFrame:
    """The nearest feature of each of ``places(origin, x, y, bound)``; ``bound`` is a distance known to some feature, or NULL.

    ``visited`` receives the nodes met at each level (for tests).
    """
    nodes, top = _nodes(tree)
    node = F.struct("level", "px", "py", "leaf", *BOX)
    children = (
        nodes.where(F.col("level") < top)
        .groupBy((F.col("level") + 1).alias("kl"), F.floor(F.col("px") / STEP).alias("kx"), F.floor(F.col("py") / STEP).alias("ky"))
        .agg(F.collect_list(node).alias("kids"))
    )
    children = materialize(children, "children")
    roots = nodes.where(F.col("level") == top).agg(F.collect_list(node).alias("kids"))  # one row of at most 25 nodes
    known = places.withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    usable = known.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    frontier = _closer(usable.crossJoin(F.broadcast(roots)), origin_id)
    for level in range(top, tree.bottom, -1):
        if visited is not None:
            visited.append(frontier)
        below = children.where(F.col("kl") == level)
        # leaves met above stay as they are: they meet no children, and a key of their own spreads them
        leaf, own = F.col("leaf"), F.xxhash64(origin_id)
        keyed = frontier.withColumns({"kl": F.when(leaf, F.lit(tree.bottom - 1)).otherwise(F.col("level")), "kx": F.when(leaf, own).otherwise(F.col("px")), "ky": F.when(leaf, own).otherwise(F.col("py"))})
        met = keyed.join(below, ["kl", "kx", "ky"], "left").drop("kl", "kx", "ky")
        met = met.withColumn("kids", F.when(leaf, F.array(node)).otherwise(F.col("kids"))).drop("level", "px", "py", "leaf", *BOX)
        frontier = _closer(met, origin_id)
    if visited is not None:
        visited.append(frontier)
    leaf_key = ["level", "px", "py"]
    leaves = tree.leaves.select(*leaf_key, feature_id, *EDGE_FIELDS)
    least = materialize(_least_of(frontier.select(origin_id, "x", "y", *leaf_key).distinct(), leaves, leaf_key), "leaf_distances")
    # of the leaves met only the one with the least distance is read again
    best = least.groupBy(origin_id).agg(F.min("distance_m").alias("distance_m"))
    found = _lowest_of(least.join(best, [origin_id, "distance_m"]), leaves, leaf_key, feature_id)
    return found.groupBy(origin_id, "distance_m").agg(F.min(feature_id).alias(feature_id)).select(origin_id, feature_id, "distance_m")


def _closer(met: DataFrame, origin_id: str) -> DataFrame:
    """Nodes among ``kids`` that may hold the answer, one row each, with the bound they all give."""
    near = met.select(origin_id, "x", "y", "bound", F.explode("kids").alias("k")).select(origin_id, "x", "y", "bound", "k.*")
    box = F.struct(*BOX)
    near = near.withColumn("least", _least(box)).where(_within(F.col("least"), F.col("bound")))
    bound = F.least(F.col("bound"), F.min(_most(box)).over(Window.partitionBy(origin_id)))
    return near.withColumn("bound", bound).where(_within(F.col("least"), F.col("bound"))).drop("least")
