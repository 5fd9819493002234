"""A grid of region cells: the shared side of every spatial join.

Each region is cut into square cells. A cell no edge touches is wholly inside (``full``) and needs no
geometry test. A touched cell carries the edges that touch it, and whether a ray from its south-east corner
meets an odd number of all the region's edges (``odd``): the way from that corner to a point of the cell
crosses edges of the cell alone. The parities of a row of cells are running sums of the places where
edges cross its lower line, so no task ever holds an outline.

Cells follow the area of the regions and the density of their edges; where a cell still has many edges it is
split into smaller ones, all its regions alike. The other side finds the depth of its cell in the list of splits,
which most indexes do not need, and joins on the plain cell key: an equi-join whatever the shapes are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionscore.functions import geometry as G
from regionscore.storage import materialize

CELLS_PER_REGION = 256
#: A touched cell with more edges of one region is split, into 4 x 4 cells or finer.
MAX_EDGES_PER_CELL = 64
STEP = 4
MAX_DEPTH = 3
#: Up to so many regions of a cell are packed in one row; cells with more are matched region by region.
MAX_PACKED = 64
KEY = ("depth", "cx", "cy")


def _wide(cell: float | Column) -> Column:
    return cell if isinstance(cell, Column) else F.lit(cell)


def cell_of(value: Column, cell: float | Column) -> Column:
    return F.floor(value / _wide(cell)).cast("bigint")


@dataclass
class RegionIndex:
    """``cells(depth, cx, cy, region, full, edges, odd)`` and the base cells that are split ``(sx, sy, depth)``.

    ``anchors(region, x, y)`` has a position of each part of each region.
    """

    cells: DataFrame
    cell: float
    metric: bool
    anchors: DataFrame
    splits: DataFrame | None = None
    depths: tuple[int, ...] = ()
    most_packed: int = MAX_PACKED
    _packed: dict = field(default_factory=dict, repr=False)

    def packed(self) -> tuple[DataFrame, DataFrame]:
        """One row per cell with few regions, its only one spelled out or all as an array; and the rows of the other cells.

        Written once, when first asked for. Whether it is broadcast is left to Spark, which knows the size of the files.
        """
        if self.most_packed not in self._packed:
            known = self.cells.withColumn("n", F.count("*").over(Window.partitionBy(*KEY)))
            few = known.where(F.col("n") <= self.most_packed).groupBy(*KEY).agg(
                F.first("region").alias("region"),
                F.first("full").alias("full"),
                F.first("edges").alias("edges"),
                F.first("odd").alias("odd"),
                F.collect_list(F.struct("region", "full", "edges", "odd")).alias("candidates"),
            )
            alone = F.size("candidates") == 1
            few = few.select(
                *KEY, *[F.when(alone, F.col(c)).alias(c) for c in ("region", "full", "edges", "odd")], F.when(~alone, F.col("candidates")).alias("candidates")
            )
            many = known.where(F.col("n") > self.most_packed).drop("n")
            self._packed[self.most_packed] = (materialize(few, "packed_cells"), materialize(many, "crowded_cells"))
        return self._packed[self.most_packed]

    def located(self, points: DataFrame, x: str, y: str, where: Column | None = None) -> DataFrame:
        """``points`` with the key of their cell; no key where ``where`` does not hold."""
        where = F.lit(True) if where is None else where
        base = {k: F.when(where, cell_of(F.col(c), self.cell)) for k, c in (("cx", x), ("cy", y))}
        found = points.withColumns(base)
        if self.splits is None:
            return found.withColumn("depth", F.when(where, F.lit(0)))
        split = self.splits.withColumnRenamed("depth", "__depth")
        found = found.join(split, (F.col("cx") == F.col("sx")) & (F.col("cy") == F.col("sy")), "left").drop("sx", "sy")
        depth = F.when(where, F.coalesce("__depth", F.lit(0)))
        fine = {k: F.floor(F.col(c) / F.lit(self.cell) * F.pow(F.lit(float(STEP)), depth)).cast("bigint") for k, c in (("cx", x), ("cy", y))}
        return found.withColumns({**fine, "depth": depth}).drop("__depth")

    def cut(self, segments: DataFrame) -> DataFrame:
        """Segments cut by the grid: one row per cell passed, with its key and the parameter range inside it."""
        pieces = segment_pieces(segments, self.cell)
        if self.splits is None:
            return pieces.withColumn("depth", F.lit(0))
        on = (F.col("cx") == F.col("sx")) & (F.col("cy") == F.col("sy"))
        known = pieces.join(self.splits, on, "left")
        out = known.where(F.col("depth").isNull()).drop("sx", "sy").withColumn("depth", F.lit(0))
        for d in self.depths:
            again = known.where(F.col("depth") == d).drop("cx", "cy", "t0", "t1")
            fine = segment_pieces(again, self.cell / STEP**d)
            inside = (F.floor(F.col("cx") / STEP**d) == F.col("sx")) & (F.floor(F.col("cy") / STEP**d) == F.col("sy"))
            out = out.unionByName(fine.where(inside).drop("sx", "sy"))
        return out

    def covers(self, edges: Column, odd: Column, x: Column, y: Column) -> Column:
        """Whether a touched cell's region covers a point of the cell, borders included; reads the key columns."""
        size = F.lit(self.cell) / F.pow(F.lit(float(STEP)), F.col("depth"))
        return covers_in_cell(edges, odd, (F.col("cx") + 1) * size, F.col("cy") * size, x, y, metric=self.metric)


def covers_in_cell(edges: Column, odd: Column, east: Column, south: Column, x: Column, y: Column, *, metric: bool) -> Column:
    on = F.exists(edges, lambda e: G.on_edge(e, x, y, metric=metric))
    return on | G.odd_in_cell(edges, odd, east, south, x, y)


def edge_rows(df: DataFrame, keep: list[str], geom: str) -> DataFrame:
    """One row per edge of a geometry column, with the kept columns."""
    exploded = df.select(*keep, F.explode(G.edges(F.col(geom))).alias("__e"))
    return exploded.select(*keep, *[F.col(f"__e.{f}").alias(f) for f in G.EDGE_FIELDS])


def with_rows(edges: DataFrame, cell: float | Column, slack: float | Column) -> DataFrame:
    """One row per grid row an edge passes, with the edge's x range inside that row; the cell may differ from edge to edge."""
    ax, ay, bx, by = (F.col(f) for f in G.EDGE_FIELDS)
    low, high = F.least(ay, by), F.greatest(ay, by)
    rows = edges.withColumn("cy", F.explode(F.sequence(cell_of(low - slack, cell), cell_of(high + slack, cell))))

    def x_at(y: Column) -> Column:
        y = F.least(F.greatest(y, low), high)
        return F.coalesce(ax + (y - ay) * (bx - ax) / F.nullif(by - ay, F.lit(0.0)), ax)

    bottom = x_at(F.col("cy") * _wide(cell) - slack)
    top = x_at((F.col("cy") + 1) * _wide(cell) + slack)
    flat = by == ay
    return rows.withColumns(
        {
            "x0": F.when(flat, F.least(ax, bx)).otherwise(F.least(bottom, top)) - slack,
            "x1": F.when(flat, F.greatest(ax, bx)).otherwise(F.greatest(bottom, top)) + slack,
        }
    )


def _row_cells(rows: DataFrame, cell: float | Column) -> DataFrame:
    return rows.withColumn(
        "cx", F.explode(F.sequence(cell_of(F.col("x0"), cell), cell_of(F.col("x1"), cell)))
    ).drop("x0", "x1")


def edge_cells(edges: DataFrame, cell: float | Column, slack: float | Column) -> DataFrame:
    """One row per cell an edge passes."""
    return _row_cells(with_rows(edges, cell, slack), cell)


def _clip_range(cell: float) -> tuple[Column, Column]:
    """Parameter range of an edge inside the closed box of its cell (Liang-Barsky)."""
    lows, highs = [F.lit(0.0)], [F.lit(1.0)]
    for a, b, c in (("ax", "bx", "cx"), ("ay", "by", "cy")):
        start, step = F.col(a), F.nullif(F.col(b) - F.col(a), F.lit(0.0))
        enter = (F.col(c) * F.lit(cell) - start) / step
        leave = ((F.col(c) + 1) * F.lit(cell) - start) / step
        lows.append(F.least(enter, leave))
        highs.append(F.greatest(enter, leave))
    return F.greatest(*lows), F.least(*highs)


def segment_pieces(segments: DataFrame, cell: float) -> DataFrame:
    """Segments cut by the grid: one row per cell passed, with the parameter range inside it."""
    t0, t1 = _clip_range(cell)
    return edge_cells(segments, cell, cell * 1e-9).withColumns({"t0": t0, "t1": t1})


def suggest_cell(regions: DataFrame, geom: str) -> float:
    """About :data:`CELLS_PER_REGION` cells a region by area, or up to 64 times as many where outlines are detailed.

    A cell as long as sixteen average edges is touched by a few dozen of them.
    """
    shape = regions.select(G.bbox(F.col(geom)).alias("b"), F.size(G.edges(F.col(geom))).alias("edges"), G.length_m(F.col(geom)).alias("around"))
    area, n, edges, around = shape.agg(
        F.sum((F.col("b.xmax") - F.col("b.xmin")) * (F.col("b.ymax") - F.col("b.ymin"))), F.count("*"), F.sum("edges"), F.sum("around")
    ).first()
    if not n or not area:
        return 1.0
    by_area = (area / (n * CELLS_PER_REGION)) ** 0.5
    return max(min(by_area, MAX_EDGES_PER_CELL / 4 * around / edges), by_area / 8)


def _tolerance(metric: bool, cell: float) -> float:
    return (G.METRIC_TOLERANCE if metric else G.BORDER_TOLERANCE) + cell * 1e-9


def _crossings(rows: DataFrame, cell: float) -> DataFrame:
    """Where edges cross the lower line of a grid row: the last cell whose west side lies west of the place.

    The place is compared with cell sides as :func:`geometry.odd_in_cell` compares it, so that both agree.
    """
    e = F.struct(*G.EDGE_FIELDS)
    y = F.col("cy") * F.lit(cell)
    straddles = (F.col("ay") > y) != (F.col("by") > y)
    about = cell_of((F.col("bx") - F.col("ax")) * (y - F.col("ay")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0)) + F.col("ax"), cell)

    def west_of(column: Column) -> Column:
        return G.passes_east(e, column * F.lit(cell), y)

    place = F.when(west_of(about + 1), about + 1).when(west_of(about), about).otherwise(about - 1)
    return rows.where(straddles).select("region", "cy", place.alias("cx"))


def _explicit(touched: DataFrame, crossings: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Cells with an edge or a crossing, their edges, and the crossings from there on east (``beyond``: without the cell's own)."""
    none = F.lit(None).cast(f"struct<{', '.join(f'{f}: double' for f in G.EDGE_FIELDS)}>")
    edge = F.struct(*G.EDGE_FIELDS)
    if "split" in touched.columns:  # such a cell is known to be touched; its edges are left to the finer cells
        edge = F.when(~F.col("split"), edge)
    rows = touched.select("region", "cy", "cx", edge.alias("e"), F.lit(0).alias("n"), F.lit(True).alias("touched"))
    rows = rows.unionByName(crossings.select("region", "cy", "cx", none.alias("e"), F.lit(1).alias("n"), F.lit(False).alias("touched")))
    if extra is not None:
        rows = rows.unionByName(extra.select("region", "cy", "cx", none.alias("e"), F.lit(0).alias("n"), F.lit(False).alias("touched")))
    cells = rows.groupBy("region", "cy", "cx").agg(F.collect_list("e").alias("edges"), F.sum("n").alias("n"), F.bool_or("touched").alias("touched"))
    east = Window.partitionBy("region", "cy").orderBy(F.desc("cx"))
    return cells.withColumns(
        {"here": F.sum("n").over(east.rowsBetween(Window.unboundedPreceding, 0)), "west": F.lead("cx").over(east)}
    ).withColumn("odd", (F.col("here") - F.col("n")) % 2 == 1)


def _finished(explicit: DataFrame, depth: int) -> DataFrame:
    touched = F.col("touched")
    return explicit.where(touched | F.col("odd")).select(
        F.lit(depth).alias("depth"), "cx", "cy", "region", (~touched).alias("full"), F.when(touched, F.col("edges")).alias("edges"), "odd"
    )


def _gaps(explicit: DataFrame) -> DataFrame:
    """Cells between those of a row that lie inside: no edge touches them, and the ray from them meets an odd number."""
    between = F.sequence(F.col("west") + 1, F.col("cx") - 1)
    inside = explicit.where((F.col("here") % 2 == 1) & (F.col("west") + 1 <= F.col("cx") - 1))
    return inside.select("region", "cy", F.explode(between).alias("cx")).select(
        F.lit(0).alias("depth"), "cx", "cy", "region", F.lit(True).alias("full"), F.lit(None).cast(f"array<struct<{', '.join(f'{f}: double' for f in G.EDGE_FIELDS)}>>").alias("edges"), F.lit(True).alias("odd")
    )


def region_cells(regions: DataFrame, region_id: str, geom: str, cell: float, *, metric: bool, splits: DataFrame | None = None) -> DataFrame:
    """The cells of one size: ``(depth 0, cx, cy, region, full, edges, odd)``; cells in ``splits`` without their edges."""
    edges = edge_rows(regions.select(F.col(region_id).alias("region"), F.col(geom).alias("__g")), ["region"], "__g")
    rows = with_rows(edges, cell, _tolerance(metric, cell))
    touched = _row_cells(rows, cell)
    if splits is not None:
        marked = splits.select(F.col("sx").alias("__x"), F.col("sy").alias("__y"))
        touched = touched.join(marked, (F.col("cx") == F.col("__x")) & (F.col("cy") == F.col("__y")), "left").withColumn("split", F.col("__x").isNotNull())
    explicit = _explicit(touched, _crossings(rows, cell))
    return _finished(explicit, 0).unionByName(_gaps(explicit))


def _split(edges: DataFrame, base: DataFrame, splits: DataFrame, depth: int, cell: float, metric: bool) -> DataFrame:
    """The cells of one depth: every region's part of the base cells that are split so far."""
    k, fine = STEP**depth, cell / STEP**depth
    chosen = splits.where(F.col("depth") == depth).select("sx", "sy")
    mine = base.join(chosen, (F.col("cx") == F.col("sx")) & (F.col("cy") == F.col("sy"))).select("region", "sx", "sy", "full")
    part = F.sequence(F.lit(0), F.lit(k - 1))
    sub = mine.withColumn("i", F.explode(part)).withColumn("j", F.explode(part)).select(
        "region", "full", (F.col("sx") * k + F.col("i")).alias("cx"), (F.col("sy") * k + F.col("j")).alias("cy")
    )
    full = sub.where("full").select(F.lit(depth).alias("depth"), "cx", "cy", "region", F.lit(True).alias("full"), F.lit(None).cast(base.schema["edges"].dataType).alias("edges"), F.lit(True).alias("odd"))
    open_ = mine.where(~F.col("full")).drop("full")
    wanted_rows = open_.select("region", "sy").distinct()
    rows = with_rows(edges.join(open_.select("region").distinct(), "region", "left_semi"), fine, _tolerance(metric, fine))
    rows = rows.withColumn("by_", F.floor(F.col("cy") / k)).join(
        wanted_rows.withColumnsRenamed({"region": "__r", "sy": "__by"}), (F.col("region") == F.col("__r")) & (F.col("by_") == F.col("__by")), "left_semi"
    ).drop("by_")
    places = _row_cells(rows, fine).withColumns({"__bx": F.floor(F.col("cx") / k), "__by": F.floor(F.col("cy") / k)})
    touched = places.join(
        open_.withColumnsRenamed({"region": "__r", "sx": "__b", "sy": "__c"}),
        (F.col("region") == F.col("__r")) & (F.col("__bx") == F.col("__b")) & (F.col("__by") == F.col("__c")),
        "left_semi",
    ).drop("__bx", "__by")
    wanted = sub.where(~F.col("full")).select("region", "cx", "cy")
    explicit = _explicit(touched, _crossings(rows, fine), wanted)
    # crossings elsewhere in the row are only counted
    kept = explicit.join(wanted.withColumnsRenamed({"region": "__r", "cx": "__x", "cy": "__y"}), (F.col("region") == F.col("__r")) & (F.col("cx") == F.col("__x")) & (F.col("cy") == F.col("__y")), "left_semi")
    return _finished(kept, depth).unionByName(full)


def _anchors(regions: DataFrame, region_id: str, geom: str) -> DataFrame:
    part = regions.select(F.col(region_id).alias("region"), F.explode(F.col(f"{geom}.parts")).alias("part"))
    first = F.get(F.get("part", F.lit(0)), F.lit(0))
    return part.select("region", first["x"].alias("x"), first["y"].alias("y"))


def build_index(
    regions: DataFrame, region_id: str, geom: str, *, cell: float | None = None, metric: bool = False
) -> RegionIndex:
    """Cut regions into cells, split the cells that many edges touch, and store the result once."""
    cell = cell or suggest_cell(regions, geom)
    anchors = materialize(_anchors(regions, region_id, geom), "region_anchors")
    edges = edge_rows(regions.select(F.col(region_id).alias("region"), F.col(geom).alias("__g")), ["region"], "__g")
    counted = edge_cells(edges, cell, _tolerance(metric, cell)).groupBy("region", "cx", "cy").agg(F.count("*").alias("n")).where(F.col("n") > MAX_EDGES_PER_CELL)
    need = F.ceil(F.log(F.max("n") * 2.0 / MAX_EDGES_PER_CELL) / F.log(F.lit(float(STEP))))
    splits = counted.groupBy(F.col("cx").alias("sx"), F.col("cy").alias("sy")).agg(F.least(F.lit(MAX_DEPTH), need.cast("int")).alias("depth"))
    splits = materialize(splits, "region_splits")
    depths = tuple(sorted(r.depth for r in splits.select("depth").distinct().collect()))  # at most MAX_DEPTH rows
    if not depths:
        return RegionIndex(materialize(region_cells(regions, region_id, geom, cell, metric=metric), "region_cells"), cell, metric, anchors)
    base = materialize(region_cells(regions, region_id, geom, cell, metric=metric, splits=splits), "base_cells")
    whole = base.join(splits.select("sx", "sy"), (F.col("cx") == F.col("sx")) & (F.col("cy") == F.col("sy")), "left_anti")
    for d in depths:
        whole = whole.unionByName(_split(edges, base, splits, d, cell, metric))
    return RegionIndex(materialize(whole, "region_cells"), cell, metric, anchors, splits, depths)
