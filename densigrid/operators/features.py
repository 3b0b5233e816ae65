"""Measures of masks and objects: areas, shapes, counts, tiles, hierarchy and overlap."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from densigrid.operators import masks as mask_operators
from densigrid.operators import shapes
from densigrid.operators.raster import PX, shuffled
from densigrid.sources.stage import staged


def tile(at: Column, size: int) -> Column:
    return (F.floor(at / size) * size).cast("int")


def bulk(mask: DataFrame) -> DataFrame:
    return mask.groupBy("fov").agg(F.count(F.lit(1)).alias("area"))


def objects(labelled: DataFrame, keys: tuple = ("fov", "label")) -> DataFrame:
    """Area, centre, half-open box and eccentricity of each object."""
    a, b, m = F.var_pop("r"), F.var_pop("c"), F.covar_pop("r", "c")
    out = labelled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("area"), F.avg("r").alias("centroid_y"), F.avg("c").alias("centroid_x"), F.min("r").alias("min_row"), F.min("c").alias("min_col"),
        (F.max("r") + 1).alias("max_row"), (F.max("c") + 1).alias("max_col"), a.alias("_a"), b.alias("_b"), m.alias("_m"))
    return out.withColumn("eccentricity", _eccentricity()).drop("_a", "_b", "_m")


def _eccentricity() -> Column:
    """From the variances _a and _b of rows and columns, and their covariance _m."""
    root = F.sqrt((F.col("_a") - F.col("_b")) * (F.col("_a") - F.col("_b")) + 4 * F.col("_m") * F.col("_m"))
    large, small = (F.col("_a") + F.col("_b") + root) / 2, (F.col("_a") + F.col("_b") - root) / 2
    return F.when(large > 0, F.sqrt(F.greatest(F.lit(0.0), 1 - small / large))).otherwise(0.0)


def counts(px: DataFrame, present: DataFrame, targets: list[str], keys: list[str], area: str | None = None) -> DataFrame:
    """Occupied pixels of each target within each group of ``px``, and with ``area`` the group's pixels; groups without any keep zeros."""
    has = lambda t: F.max(F.when(F.col("target") == t, 1)).alias(t)
    flags = present.where(F.col("target").isin(*targets)).groupBy(*PX).agg(*map(has, targets))  # one row a pixel, so that px is not repeated
    more = [F.count(F.lit(1)).alias(area)] if area else []
    return px.join(shuffled(flags), PX, "left").groupBy(*keys).agg(*(F.count(t).alias(t) for t in targets), *more)


def bulk_counts(mask: DataFrame, present: DataFrame, targets: list[str], ext: DataFrame) -> DataFrame:
    """(fov, area, targets) of whole masks: a row for every fov, zeros where the mask is empty."""
    found = ext.select("fov").join(counts(mask, present, targets, ["fov"], "area"), "fov", "left")
    return found.select("fov", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("area", *targets)))


def grid_tiles(labelled: DataFrame, size: int) -> DataFrame:
    """``labelled`` with the origin of its pixels' tiles."""
    return labelled.withColumn("tile_y", tile(F.col("r"), size)).withColumn("tile_x", tile(F.col("c"), size))


def hierarchy(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(fov, label, parent_ids): sorted distinct parents that share a pixel with each child; empty if none."""
    up = parents.where(F.col("label") != 0).select(*PX, F.col("label").alias("parent"))
    return children.where(F.col("label") != 0).join(shuffled(up), PX, "left").groupBy("fov", "label").agg(F.array_sort(F.collect_set("parent")).alias("parent_ids"))


def overlap(cells: DataFrame, masks: DataFrame) -> DataFrame:
    """(fov, cell, mask, n, percent): pixels of each named mask within each cell, zeros kept, and their share of the cell's sum."""
    names = masks.select("mask").distinct()
    frame = cells.select("fov", "cell").distinct().join(F.broadcast(names.agg(F.collect_set("mask").alias("names"))))  # one row: the names of masks
    frame = frame.select("fov", "cell", F.explode("names").alias("mask"))
    n = cells.join(shuffled(masks), PX).groupBy("fov", "cell", "mask").agg(F.count(F.lit(1)).alias("n"))
    out = frame.join(shuffled(n), ["fov", "cell", "mask"], "left").select("fov", "cell", "mask", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("fov", "cell"))  # one row a mask
    return out.select("fov", "cell", "mask", "n", F.when(total > 0, 100 * F.col("n") / total).otherwise(0.0).alias("percent"))


def merged(left: DataFrame, right: DataFrame, keys: list[str], last: str | None = None) -> DataFrame:
    """``left`` with the columns of ``right`` by the keys. The right side wins where names clash and a row is met; of its rows of one key that of the largest
    ``last`` counts. If one side has no rows at all, the other is the result."""
    if left.isEmpty():
        return right
    if right.isEmpty():
        return left
    other = [c for c in right.columns if c not in keys]
    if last is not None:
        right = right.groupBy(*keys).agg(F.max_by(F.struct(*other), last).alias("_s")).select(*keys, "_s.*")
    met = right.select(*keys, F.struct(*other).alias("_right"))
    rows = left.join(shuffled(met), keys, "left")
    own = [F.when(F.col("_right").isNotNull(), F.col(f"_right.{c}")).otherwise(F.col(c)).alias(c) if c in other else F.col(c) for c in left.columns if c not in keys]
    return rows.select(*keys, *own, *(F.col(f"_right.{c}").alias(c) for c in other if c not in left.columns))


def negative_counts(rows: DataFrame, targets: list[str]) -> DataFrame:
    """(the rows' other columns, target, count) for each count below 0: a check of the data, empty when all is well."""
    rest = [c for c in rows.columns if c not in targets]
    pairs = F.array(*(F.struct(F.lit(t).alias("target"), F.col(t).alias("count")) for t in targets))
    return rows.select(*rest, F.explode(F.filter(pairs, lambda p: p["count"] < 0)).alias("_p")).select(*rest, "_p.*")


@dataclass(frozen=True)
class MaskDefinition:
    """A mask to measure: all of it (bulk), its objects (per_object), or tiles of ``grid_size`` of its objects (grid)."""

    mask: DataFrame
    mask_name: str
    analysis_type: str
    grid_size: int | None = None


LEVELS = {"bulk": (), "per_object": ("label",), "grid": ("label", "grid_y", "grid_x")}  # what a measure's rows are told apart by, besides the mask


def _together(definitions: list[MaskDefinition]) -> DataFrame:
    """(fov, number, label, grid_y, grid_x, r, c): the pixels of all masks, each mask once for all definitions that ask for it with tiles of one size or without any.

    ``number`` is the place of the first such definition. Masks that are measured by object are labelled, once, and read again from where that was written.
    """
    parts, labels = [], {}
    for number, of in _shared(definitions).items():
        d = definitions[of[0]]
        if any(definitions[k].analysis_type != "bulk" for k in of):
            if id(d.mask) not in labels:
                labels[id(d.mask)] = staged(mask_operators.label(d.mask))
            px = labels[id(d.mask)]
        else:
            px = d.mask.select(*PX, F.lit(0).alias("label"))
        size = next((definitions[k].grid_size for k in of if definitions[k].analysis_type == "grid"), None)
        tiles = [tile(F.col(at), size) if size else F.lit(0) for at in ("r", "c")]
        parts.append(px.select("fov", F.lit(number).alias("number"), "label", tiles[0].alias("grid_y"), tiles[1].alias("grid_x"), "r", "c"))
    return reduce(DataFrame.unionByName, parts)


def _shared(definitions: list[MaskDefinition]) -> dict[int, list[int]]:
    """Places of the definitions by that of the first one with the same mask, and with tiles of the same size if both have some."""
    out: dict[int, list[int]] = {}
    for k, d in enumerate(definitions):
        size = lambda j: definitions[j].grid_size if definitions[j].analysis_type == "grid" else None
        first = next((n for n, of in out.items() if definitions[n].mask is d.mask and len({size(j) for j in (*of, k)} - {None}) < 2), k)
        out.setdefault(first, []).append(k)
    return out


def _sums(px: DataFrame, present: DataFrame, targets: list[str], levels: list[tuple]) -> DataFrame:
    """Areas, places and counts of (fov, number) and each of the ``levels``, by one aggregate over grouping sets; _level tells which of LEVELS a row is of."""
    has = lambda t: F.max(F.when(F.col("target") == t, 1)).alias(t)
    flags = present.where(F.col("target").isin(*targets)).groupBy(*PX).agg(*map(has, targets))  # one row a pixel, so that px is not repeated
    base, rest = ["fov", "number"], ["label", "grid_y", "grid_x"]
    sets = [[F.col(c) for c in (*base, *level)] for level in levels]
    found = px.join(shuffled(flags), PX, "left").groupingSets(sets, *map(F.col, (*base, *rest))).agg(
        *(F.count(t).alias(t) for t in targets), F.count(F.lit(1)).alias("area"), F.avg("r").alias("centroid_y"), F.avg("c").alias("centroid_x"),
        F.min("r").alias("min_row"), F.min("c").alias("min_col"), (F.max("r") + 1).alias("max_row"), (F.max("c") + 1).alias("max_col"),
        F.var_pop("r").alias("_a"), F.var_pop("c").alias("_b"), F.covar_pop("r", "c").alias("_m"), F.grouping_id().alias("_id"))
    of = {0b111: "bulk", 0b011: "per_object", 0b000: "grid"}  # a bit for each column that a set leaves out
    level = reduce(lambda out, x: out.when(F.col("_id") == x[0], x[1]), of.items(), F.when(F.lit(False), ""))
    return found.withColumns({"_level": level, "eccentricity": _eccentricity()}).drop("_a", "_b", "_m", "_id")


def analysed(definitions: list[MaskDefinition], present: DataFrame, targets: list[str], ext: DataFrame) -> DataFrame:
    """One table of all definitions' measures and counts, tagged with mask_name and analysis_type; what a type doesn't measure is null. Tiles keep their own counts.

    All masks meet the points in one join and are measured by one aggregate, whatever is asked of each. Masks as a whole have a row for every fov, zeros where they are
    empty. Perimeter and solidity, which need more than sums, are added for masks measured by object.
    """
    for d in definitions:
        if d.analysis_type not in LEVELS:
            raise ValueError(f"unknown analysis type {d.analysis_type!r}")
        if d.analysis_type == "grid" and d.grid_size is None:
            raise ValueError("an analysis by grid needs a grid size")
    px = _together(definitions)
    asked = sorted({LEVELS[d.analysis_type] for d in definitions}, key=len)
    sums = _sums(px, present, targets, asked)
    names = [(number, definitions[k].analysis_type, definitions[k].mask_name) for number, of in _shared(definitions).items() for k in of]
    each = F.array(*(F.struct(F.lit(n).alias("number"), F.lit(t).alias("analysis_type"), F.lit(m).alias("mask_name")) for n, t, m in names))
    wanted = F.filter(each, lambda x: (x["number"] == F.col("number")) & (x["analysis_type"] == F.col("_level")))
    rows = sums.withColumn("d", F.explode(wanted)).select("*", "d.mask_name", "d.analysis_type").drop("d", "_level")
    whole = [x for x in names if x[1] == "bulk"]
    if whole:  # fovs where the mask is empty
        bulk_ = F.array(*(F.struct(F.lit(n).alias("number"), F.lit(m).alias("mask_name")) for n, _, m in whole))
        frame = ext.select("fov", F.explode(bulk_).alias("d")).select("fov", F.col("d.number").alias("number"), F.col("d.mask_name").alias("mask_name"), F.lit("bulk").alias("analysis_type"))
        empty = frame.join(rows, ["fov", "number", "mask_name", "analysis_type"], "left_anti")
        rows = rows.unionByName(empty.withColumns({t: F.lit(0).cast("long") for t in (*targets, "area")}), allowMissingColumns=True)
    objects_ = {number for number, t, _ in names if t == "per_object"}
    only = lambda t, c: F.when(F.col("analysis_type") == t, F.col(c)).alias(c)
    object_id = F.when(F.col("analysis_type") == "bulk", "bulk").otherwise(F.col("label").cast("string"))
    shape = ["centroid_y", "centroid_x", "min_row", "min_col", "max_row", "max_col", "eccentricity"]
    out = rows.select("fov", "number", "mask_name", "analysis_type", "label", object_id.alias("object_id"), "area", *targets, "grid_y", "grid_x",
                      F.when(F.col("analysis_type") == "grid", F.col("centroid_x")).alias("x"), F.when(F.col("analysis_type") == "grid", F.col("centroid_y")).alias("y"), *(only("per_object", c) for c in shape))
    if objects_:
        # objects of several masks are told apart as objects of as many fovs
        apart = px.where(F.col("number").isin(*objects_)).select(F.struct("fov", "number").alias("fov"), "label", "r", "c")
        for more in (shapes.perimeters(apart), shapes.solidities(apart)):
            own = more.select(F.col("fov.fov").alias("fov"), F.col("fov.number").alias("number"), "label", F.lit("per_object").alias("analysis_type"), *[c for c in more.columns if c not in ("fov", "label")])
            out = out.join(shuffled(own), ["fov", "number", "label", "analysis_type"], "left")
    return out.drop("number", "label")


def hierarchies(definitions: dict[str, tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """(fov, mask_name, object_id, parent_mask, parent_ids) of {child mask's name: (child mask, parents' labels by pixel, parent mask's name)}; children are labelled here."""
    found = [
        hierarchy(mask_operators.label(child), parents).select("fov", F.lit(name).alias("mask_name"), F.col("label").alias("object_id"), F.lit(above).alias("parent_mask"), "parent_ids")
        for name, (child, parents, above) in definitions.items()
    ]
    return reduce(DataFrame.unionByName, found)


def with_parents(results: DataFrame, table: DataFrame, names: list[str]) -> DataFrame:
    """``results`` with parent_ids: those of the table for objects of the masks named, empty where it has none; null for other masks and ids that are no numbers."""
    up = table.select("fov", "mask_name", F.col("object_id").cast("string").alias("object_id"), "parent_ids")
    rows = results.join(shuffled(up), ["fov", "mask_name", "object_id"], "left")
    own = F.col("mask_name").isin(*names) & F.col("object_id").rlike("^-?[0-9]+$")
    return rows.withColumn("parent_ids", F.when(own, F.coalesce("parent_ids", F.array().cast("array<int>"))))
