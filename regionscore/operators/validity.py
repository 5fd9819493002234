"""Outline checks: ring structure per row, topology within the row of a small outline, else as a join of edges that share a cell.

Nothing is ever repaired; a region with any reason here must not be used for assignment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionscore.functions import geometry as G
from regionscore.functions.geojson import geojson_is_valid
from regionscore.operators.region_index import cell_of, edge_cells, region_cells, suggest_cell
from regionscore.storage import materialize

#: Outlines with at most so many edges are compared edge by edge in their own row; nothing of them is shuffled.
SMALL_OUTLINE_EDGES = 128


def structure_report(regions: DataFrame, *, region_id: str = "nuts_code", geom: str = "geom") -> DataFrame:
    """``(region, reason)`` of outlines whose rings are not usable at all."""
    reason = G.structure_problem(F.col(geom))
    return regions.select(region_id, reason.alias("reason")).where(F.col("reason").isNotNull())


def _ring_rows(regions: DataFrame, region_id: str, geom: str) -> DataFrame:
    """One row per ring, consecutive repeated positions removed."""
    parts = regions.select(F.col(region_id).alias("region"), F.posexplode(F.col(f"{geom}.parts")).alias("part", "rings"))
    rings = parts.select("region", "part", F.posexplode("rings").alias("ring", "line"))
    return rings.withColumn("line", _without_repeats(F.col("line")))


def _without_repeats(line: Column) -> Column:
    return F.filter(line, lambda p, i: (i == 0) | (p != F.get(line, i - 1)))


def _by_size(regions: DataFrame, region_id: str, geom: str) -> tuple[DataFrame, DataFrame]:
    """Outlines small enough for their own row, and the others; rows that share an id, or have none, are among the others."""
    repeated = regions.groupBy(region_id).agg(F.count("*").alias("__n")).where("__n > 1").select(F.col(region_id).alias("__id"))
    few = F.coalesce(F.size(G.edges(F.col(geom))) <= SMALL_OUTLINE_EDGES, F.lit(False)) & F.col(region_id).isNotNull()
    marked = regions.select(region_id, geom, few.alias("__few")).join(repeated, F.col(region_id) == F.col("__id"), "left")
    alone = F.col("__few") & F.col("__id").isNull()
    return marked.where(alone).select(region_id, geom), marked.where(~alone).select(region_id, geom)


def _rings_in_row(regions: DataFrame, region_id: str, geom: str) -> DataFrame:
    """``(region, rings)``: the usable rings of an outline, in the order of parts and rings."""
    rings = F.flatten(
        F.transform(
            F.col(f"{geom}.parts"),
            lambda part, p: F.transform(part, lambda line, r: F.struct(p.alias("part"), r.alias("ring"), _without_repeats(line).alias("line"))),
        )
    )
    usable = F.filter(rings, lambda r: F.size(F.array_distinct(r["line"])) >= 3)
    return regions.select(F.col(region_id).alias("region"), usable.alias("rings"))


def _pairs_in_row(outlines: DataFrame) -> DataFrame:
    """Every two edges ``(region, a, b)`` of an outline once."""
    edges = F.flatten(
        F.transform(
            "rings",
            lambda r: F.transform(
                G.ring_edges(r["line"]),
                lambda e, i: F.struct(r["part"].alias("part"), r["ring"].alias("ring"), (F.size(r["line"]) - 1).alias("edges"), i.alias("i"), *[e[f].alias(f) for f in G.EDGE_FIELDS]),
            ),
        )
    )
    one = outlines.select("region", edges.alias("edges")).select("region", "edges", F.posexplode("edges").alias("k", "a"))
    return one.select("region", "a", F.explode(F.slice("edges", F.col("k") + 2, F.size("edges"))).alias("b"))


def _inside_in_row(outlines: DataFrame) -> DataFrame:
    """For every two rings of an outline how many vertices of the one lie in the other, and whether one does strictly."""
    pairs = outlines.select("region", "rings", F.explode("rings").alias("v")).select("region", "v", F.explode("rings").alias("o"))
    other = (F.col("v.part") != F.col("o.part")) | (F.col("v.ring") != F.col("o.ring"))
    edges = G.ring_edges(F.col("o.line"))

    def seen(p: Column) -> Column:
        x, y = p["x"], p["y"]
        east = F.filter("edges", lambda e: ((e["ay"] > y) != (e["by"] > y)) & G.passes_east(e, x, y))
        return F.struct((F.size(east) % 2 == 1).alias("odd"), F.exists("edges", lambda e: G.on_edge(e, x, y)).alias("on"))

    found = pairs.where(other).withColumn("edges", edges).withColumn("seen", F.transform(F.array_distinct("v.line"), seen))
    return found.select(
        "region", "v.part", "v.ring", F.col("o.part").alias("outer_part"), F.col("o.ring").alias("outer_ring"),
        F.exists("seen", lambda s: s["odd"] & ~s["on"]).alias("strict"),
        F.size(F.filter("seen", lambda s: s["odd"] | s["on"])).cast("bigint").alias("covered"),
    )


def _edges(rings: DataFrame) -> DataFrame:
    n = F.size("line") - 1
    return rings.select(
        "region", "part", "ring", n.alias("edges"), F.posexplode(G.ring_edges(F.col("line"))).alias("i", "e")
    ).select("region", "part", "ring", "edges", "i", *[F.col(f"e.{f}").alias(f) for f in G.EDGE_FIELDS])


def _edge_cells(edges: DataFrame) -> DataFrame:
    """Edges with the cells they pass of their own region's grid: cells as long as the average edge.

    With such cells an outline has a few edges per cell however many it has in total, and all its edges
    together pass about as many cells as there are edges, however long some of them are.
    """
    length = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))
    sizes = edges.groupBy("region").agg(F.greatest(F.avg(length), F.lit(1e-9)).alias("cell"))
    return edge_cells(edges.join(sizes, "region"), F.col("cell"), F.col("cell") * 1e-9)


def _contact(a: str, b: str) -> tuple[Column, Column, Column]:
    """For two edges: do they cross in their interiors, do they overlap along a line, do they touch."""
    ax, ay, bx, by = (F.col(f"{a}.{f}") for f in G.EDGE_FIELDS)
    cx, cy, dx, dy = (F.col(f"{b}.{f}") for f in G.EDGE_FIELDS)

    def side(px, py, qx, qy, rx, ry):
        return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))

    s1, s2 = side(ax, ay, bx, by, cx, cy), side(ax, ay, bx, by, dx, dy)
    s3, s4 = side(cx, cy, dx, dy, ax, ay), side(cx, cy, dx, dy, bx, by)
    crosses = (s1 * s2 < 0) & (s3 * s4 < 0)
    collinear = (s1 == 0) & (s2 == 0) & (s3 == 0) & (s4 == 0)
    along_x = F.least(F.greatest(ax, bx), F.greatest(cx, dx)) - F.greatest(F.least(ax, bx), F.least(cx, dx))
    along_y = F.least(F.greatest(ay, by), F.greatest(cy, dy)) - F.greatest(F.least(ay, by), F.least(cy, dy))
    boxes = (along_x >= 0) & (along_y >= 0)
    overlaps = collinear & boxes & ((along_x > 0) | (along_y > 0))
    touches = boxes & (s1 * s2 <= 0) & (s3 * s4 <= 0)
    return crosses, overlaps, touches


def _touch_point(a: str, b: str) -> Column:
    """The shared end point of two edges that touch (an end of one lies on the other)."""
    candidates = [(F.col(f"{e}.{x}"), F.col(f"{e}.{y}"), o) for e, o in ((a, b), (b, a)) for x, y in (("ax", "ay"), ("bx", "by"))]

    def lies_on(x: Column, y: Column, edge: str) -> Column:
        e = {f: F.col(f"{edge}.{f}") for f in G.EDGE_FIELDS}
        cross = (x - e["ax"]) * (e["by"] - e["ay"]) - (y - e["ay"]) * (e["bx"] - e["ax"])
        return (
            (cross == 0)
            & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"]))
            & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))
        )

    return F.coalesce(*[F.when(lies_on(x, y, o), F.struct(x.alias("x"), y.alias("y"))) for x, y, o in candidates])


def _pairs_in_cells(rings: DataFrame) -> DataFrame:
    """Two edges ``(region, a, b)`` of a region for each cell that both pass."""
    cells = _edge_cells(_edges(rings))
    a, b = cells.alias("a"), cells.alias("b")
    order = F.struct(F.col("a.part"), F.col("a.ring"), F.col("a.i")) < F.struct(F.col("b.part"), F.col("b.ring"), F.col("b.i"))
    crosses, overlaps, touches = _contact("a", "b")
    same = (F.col("a.region") == F.col("b.region")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy"))
    fields = ("part", "ring", "edges", "i", *G.EDGE_FIELDS)
    return a.join(b, same & order & (crosses | overlaps | touches)).select(
        F.col("a.region").alias("region"), *[F.struct(*[F.col(f"{e}.{f}").alias(f) for f in fields]).alias(e) for e in "ab"]
    )


def _met(pairs: DataFrame) -> DataFrame:
    """Pairs of edges that meet, other than neighbours at their common end; ``bad`` where an outline may not."""
    same_ring = (F.col("a.part") == F.col("b.part")) & (F.col("a.ring") == F.col("b.ring"))
    gap = F.col("b.i") - F.col("a.i")
    neighbours = same_ring & ((gap == 1) | (gap == F.col("a.edges") - 1))
    crosses, overlaps, touches = _contact("a", "b")
    # most pairs are apart, which their boxes tell
    near = F.lit(True)
    for p, q in (("ax", "bx"), ("ay", "by")):
        a, b = ([F.col(f"{e}.{p}"), F.col(f"{e}.{q}")] for e in "ab")
        near = near & (F.greatest(*a) >= F.least(*b)) & (F.greatest(*b) >= F.least(*a))
    return pairs.where(near).where(crosses | overlaps | (touches & ~neighbours)).select(
        "region",
        F.col("a.part").alias("pa"),
        F.col("a.ring").alias("ra"),
        F.col("b.part").alias("pb"),
        F.col("b.ring").alias("rb"),
        (crosses | overlaps | (same_ring & touches & ~neighbours)).alias("bad"),
        _touch_point("a", "b").alias("at"),
    )


def topology_report(regions: DataFrame, *, region_id: str = "nuts_code", geom: str = "geom") -> DataFrame:
    """``(region, reason)`` of structurally sound outlines that are not valid polygons.

    Reasons: too few points, self-intersection, disconnected interior (rings that touch one another in a cycle,
    two rings in several points among them), hole outside shell, nested holes, nested shells.
    """
    rings = _ring_rows(regions, region_id, geom)
    distinct_points = F.size(F.array_distinct("line"))
    few = rings.where(distinct_points < 3).select("region", F.lit("too few points").alias("reason"))

    small, large = _by_size(regions, region_id, geom)
    # the work of a row is large beside its bytes, by which files are split
    in_rows = _rings_in_row(small.repartition(region_id), region_id, geom)
    met, inside = _met(_pairs_in_row(in_rows)), _inside_in_row(in_rows)
    if large.limit(1).count():
        long = _ring_rows(large, region_id, geom).where(distinct_points >= 3)
        met = met.unionByName(_met(_pairs_in_cells(long)))
        inside = inside.unionByName(_inside_in_cells(long))
    met = materialize(met, "meeting_edges")
    crossing = met.where("bad").select("region", F.lit("self-intersection").alias("reason"))
    touching = materialize(met.where(~F.col("bad") & (F.col("pa") == F.col("pb"))).select("region", F.col("pa").alias("part"), "ra", "rb", "at"), "touching_rings")
    contacts = touching.select("region", "part", F.explode(F.array("ra", "rb")).alias("ring"), "at").distinct()
    split = with_contact_cycle(contacts).select("region", F.lit("disconnected interior").alias("reason"))

    nested = _nesting(rings.where(distinct_points >= 3), materialize(inside.where("covered > 0"), "rings_inside"))
    clean = nested.join(few.union(crossing).select("region").distinct(), "region", "left_anti")
    return few.union(crossing).union(split).union(clean).distinct().select(F.col("region").alias(region_id), "reason")


def with_contact_cycle(contacts: DataFrame) -> DataFrame:
    """``(region, part)`` whose rings touch one another in a cycle; ``contacts(region, part, ring, at)`` are distinct.

    Rings and the places where they touch are the nodes of a graph, a contact is an edge. A graph is a forest
    exactly if it has as many edges as nodes less the number of its trees; trees are counted by labels, the least
    node of each, which jump along until they stay: about the logarithm of the longest chain of rings in rounds.
    """
    contacts = materialize(contacts, "contacts")
    key = ["region", "part"]
    if not contacts.limit(1).count():
        return contacts.select(*key)
    ring = F.concat(F.lit("r"), F.col("ring").cast("string"))
    place = F.concat_ws(" ", F.lit("p"), F.col("at.x").cast("string"), F.col("at.y").cast("string"))
    pairs = contacts.select(*key, ring.alias("u"), place.alias("v"))
    pairs = materialize(pairs.unionByName(pairs.select(*key, F.col("v").alias("u"), F.col("u").alias("v"))), "contact_pairs")
    labels = materialize(pairs.groupBy(*key, "u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "contact_labels")
    while True:
        # the least label around a node, and the label of that label
        near = pairs.join(labels.withColumnsRenamed({"u": "v", "label": "near"}), [*key, "v"]).groupBy(*key, "u").agg(F.min("near").alias("near"))
        best = labels.join(near, [*key, "u"]).select(*key, "u", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = best.select(*key, F.col("u").alias("label"), F.col("label").alias("further"))
        new = best.join(jump, [*key, "label"], "left").select(*key, "u", "old", F.least("label", "further").alias("label"))
        new = materialize(new, "contact_labels")
        changed = new.where(F.col("label") != F.col("old")).limit(1).count()
        labels = new.drop("old")
        if not changed:
            break
    nodes = labels.groupBy(*key).agg(F.count("*").alias("nodes"), F.count_distinct("label").alias("trees"))
    edges = contacts.groupBy(*key).agg(F.count("*").alias("edges"))
    return edges.join(nodes, key).where(F.col("edges") > F.col("nodes") - F.col("trees")).select(*key)


def _inside_in_cells(rings: DataFrame) -> DataFrame:
    """As :func:`_inside_in_row`, by cells: every vertex meets the other rings of its region through the grid."""
    outlines = rings.select(
        F.struct("region", "part", "ring").alias("rid"),
        F.struct(F.lit("Polygon").alias("type"), F.array(F.array(F.col("line"))).alias("parts")).alias("outline"),
    )
    cell = suggest_cell(outlines, "outline")
    cells = region_cells(outlines, "rid", "outline", cell, metric=False).select(
        "cx",
        "cy",
        F.col("region.region").alias("region"),
        F.col("region.part").alias("outer_part"),
        F.col("region.ring").alias("outer_ring"),
        "full",
        "edges",
        "odd",
    )
    vertices = rings.select("region", "part", "ring", F.explode(F.array_distinct("line")).alias("p")).select(
        "region",
        "part",
        "ring",
        F.col("p.x").alias("x"),
        F.col("p.y").alias("y"),
        cell_of(F.col("p.x"), cell).alias("cx"),
        cell_of(F.col("p.y"), cell).alias("cy"),
    )
    x, y = F.col("x"), F.col("y")
    on = F.exists("edges", lambda e: G.on_edge(e, x, y))
    odd = G.odd_in_cell(F.col("edges"), F.col("odd"), (F.col("cx") + 1) * F.lit(cell), F.col("cy") * F.lit(cell), x, y)
    other = (F.col("part") != F.col("outer_part")) | (F.col("ring") != F.col("outer_ring"))
    return (
        vertices.join(cells, ["region", "cx", "cy"])
        .where(other)
        .groupBy("region", "part", "ring", "outer_part", "outer_ring")
        .agg(
            F.coalesce(F.bool_or(F.col("full") | (odd & ~on)), F.lit(False)).alias("strict"),
            F.count_if(F.col("full") | odd | on).alias("covered"),
        )
    )


def _nesting(rings: DataFrame, inside: DataFrame) -> DataFrame:
    """Holes outside their shell, holes in holes, shells in shells (rings here do not cross).

    Where rings do not cross, one vertex strictly inside another ring decides.
    """
    own_shell = inside.where((F.col("part") == F.col("outer_part")) & (F.col("outer_ring") == 0)).select(
        "region", "part", "ring", "covered"
    )
    outside = (
        rings.where("ring > 0")
        .select("region", "part", "ring", F.size(F.array_distinct("line")).alias("n"))
        .join(own_shell, ["region", "part", "ring"], "left")
        .where(F.coalesce("covered", F.lit(0)) < F.col("n"))
        .select("region", F.lit("hole outside shell").alias("reason"))
    )
    holes = inside.where("part = outer_part and ring > 0 and outer_ring > 0 and strict").select(
        "region", F.lit("nested holes").alias("reason")
    )
    shells = (
        inside.where("part <> outer_part and ring = 0")
        .groupBy("region", "part", "outer_part")
        .agg(
            F.bool_or(F.expr("strict and outer_ring = 0")).alias("in_shell"),
            F.bool_or(F.expr("strict and outer_ring > 0")).alias("in_hole"),
        )
        .where("in_shell and not in_hole")
        .select("region", F.lit("nested shells").alias("reason"))
    )
    return outside.union(holes).union(shells)


def geometry_report(regions: DataFrame, *, region_id: str = "nuts_code", geom: str = "geom") -> DataFrame:
    """Structure first; topology only for outlines whose rings are usable."""
    broken = structure_report(regions, region_id=region_id, geom=geom)
    sound = regions.join(broken, region_id, "left_anti")
    return broken.union(topology_report(sound, region_id=region_id, geom=geom))




def geometry_grammar(documents: DataFrame, key: str, document: str) -> DataFrame:
    """``(key, valid)`` of GeoJSON geometry texts of all seven kinds, collections nested to any depth.

    Collections are opened level by level, all documents together: every round turns the collections of one depth into
    their members, and a document is valid if every geometry met in it is. A collection needs a member.
    """
    level = documents.select(F.col(key), F.col(document).alias("text"))
    found = level.select(key, F.lit(True).alias("valid")).limit(0)
    while True:
        parsed = level.withColumn("v", F.try_parse_json("text"))
        kind = F.try_variant_get("v", "$.type", "string")
        coordinates = F.to_json(F.try_variant_get("v", "$.coordinates", "variant"))
        members = F.try_variant_get("v", "$.geometries", "array<variant>")
        is_collection = F.coalesce(kind == "GeometryCollection", F.lit(False))
        plain = F.coalesce(geojson_is_valid(kind, coordinates), F.lit(False))
        opened = parsed.select(
            key, is_collection.alias("collection"), F.when(is_collection, F.coalesce(F.size(members) > 0, F.lit(False))).otherwise(plain).alias("valid"),
            F.when(is_collection, F.transform(members, lambda m: F.to_json(m))).alias("members"),
        )
        opened = materialize(opened, "geometries")
        found = found.unionByName(opened.select(key, "valid"))
        if not opened.where("collection AND valid").limit(1).count():
            return found.groupBy(key).agg(F.bool_and("valid").alias("valid"))
        level = opened.where("collection AND valid").select(key, F.explode("members").alias("text"))
