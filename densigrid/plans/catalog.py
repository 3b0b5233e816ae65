"""All registered queries of the spatial operators over the driver's tables, and the SQL that each is held against."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densigrid.functions.columns import relabelled
from densigrid.operators import bins, contours, expand, features, inpaint, masks, nearest, neighbors, raster, regions, shapes
from densigrid.operators.raster import PX
from densigrid.sources import points as source
from densigrid.sources import segmentation, sinks
from densigrid.sources.stage import staged

TYPES = ["click", "view", "purchase", "signup", "error"]
MARKED = ["click", "view"]
UNITS = [[0.1] * 64, [-0.1] * 64, [0.1, -0.1] * 32]
BIN_UNITS = [[1.0, 0.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.5, 0.0, 0.0], [0.3, 0.3, 0.3, 0.3, 0.3]]
LEAST_AREA = 20


class Scene:
    """The inputs that queries share, as lazy DataFrames."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir
        self.pts = source.event_points(spark, sf_dir)
        self.ext = raster.extent(self.pts)
        self.pres = raster.presence(self.pts)
        self.chan = raster.target_sum(self.pts, MARKED)

    def of(self, *targets) -> DataFrame:
        return self.pres.where(F.col("target").isin(*targets)).select(*PX).distinct()

    def not_of(self, target) -> DataFrame:
        return self.pres.where(F.col("target") != target).select(*PX).distinct()

    def dense(self) -> DataFrame:
        return raster.box_sum(self.chan, self.ext, 10).where(F.col("v") > 4).select(*PX)

    def tiles(self) -> DataFrame:
        """Labels that SQL can repeat: occupied pixels by tiles of 50."""
        lab = (F.floor(F.col("r") / 50) * 1000 + F.floor(F.col("c") / 50) + 1).cast("int")
        return self.pres.select(*PX).distinct().withColumn("label", lab)

    def binned(self) -> DataFrame:
        return bins.bin_counts(self.pts, 10, TYPES)

    def vectors(self) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.sf_dir}/embeddings.parquet")
        return rows.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))

    def all_points(self) -> DataFrame:
        return self.pts.select("fov", F.col("event_id").alias("id"), "r", "c")

    def purchases(self) -> DataFrame:
        """All pixels of purchases, with labels by tile."""
        return self.of("purchase").join(raster.shuffled(self.tiles()), PX)

    def clusters(self) -> DataFrame:
        return neighbors.dbscan(self.all_points(), 3, 3)

    def units(self) -> DataFrame:
        """Normalised bins with their nearest unit."""
        rows = bins.normalised(self.binned(), TYPES, 2)
        return bins.assigned(rows.withColumn("e", F.array(*TYPES)), "e", BIN_UNITS).withColumnRenamed("unit", "cluster")

    def objects(self) -> DataFrame:
        """Purchases as objects by tile, of two classes."""
        return self.purchases().select(*PX, F.col("label").alias("parent"), F.when(F.col("label") % 2 == 0, "A").otherwise("B").alias("class"))

    def outlines(self) -> DataFrame:
        """Contours of the dense regions, holes filled before."""
        return contours.region_contours(masks.fill_holes(self.dense(), self.ext), self.chan, LEAST_AREA)

    def regions(self) -> DataFrame:
        """(fov, label, r, c): pixels of the contours, labelled with their first pixel."""
        return contours.fill(self.outlines().select("fov", _first().alias("label"), "ring"), "fov", "label")

    def patches(self) -> DataFrame:
        """(fov, label, ring): contours of wider regions, holes filled before, labelled with their first pixel."""
        wide = raster.box_sum(self.chan, self.ext, 10).where(F.col("v") > 2).select(*PX)
        return contours.region_contours(masks.fill_holes(wide, self.ext), self.chan, LEAST_AREA).select("fov", _first().alias("label"), "ring")

    def classed(self) -> DataFrame:
        """The patches as contours of two classes."""
        return self.patches().select("fov", F.when(F.col("label") % 2 == 0, "A").otherwise("B").alias("class"), F.col("label").alias("contour"), "ring")

    def seeds(self) -> DataFrame:
        """Seeds at the patches' centroids."""
        found = expand.seeds_of(self.classed(), ["A", "B"])
        return found.withColumns({c: F.round(c, 6) for c in ("cx", "cy")})

    def definitions(self) -> list:
        make = features.MaskDefinition
        return [make(self.dense(), "dense", "bulk"), make(self.of("click"), "click", "per_object"), make(self.dense(), "dense", "grid", 50)]


PTS = """pts AS (SELECT 'F' || CAST(CAST(floor((day(ts) - 1) / 10) AS INTEGER) AS VARCHAR) AS fov, CAST(floor(value) AS INTEGER) AS r, CAST(user_id AS INTEGER) AS c, event_type AS target, event_id FROM events),
ext AS (SELECT fov, max(r) + 1 AS h, max(c) + 1 AS w FROM pts GROUP BY fov),
pres AS (SELECT DISTINCT fov, r, c, target FROM pts),
chan AS (SELECT fov, r, c, count(*) AS v FROM pres WHERE target IN ('click', 'view') GROUP BY fov, r, c),
grid AS (SELECT fov, r, c FROM (SELECT fov, w, unnest(range(h))::INTEGER AS r FROM ext) g, LATERAL (SELECT unnest(range(g.w))::INTEGER AS c) x),
a AS (SELECT DISTINCT fov, r, c FROM pres WHERE target = 'click'),
b AS (SELECT DISTINCT fov, r, c FROM pres WHERE target <> 'click'),
occ AS (SELECT DISTINCT fov, r, c FROM pres),
tiles AS (SELECT fov, r, c, CAST(floor(r / 50) * 1000 + floor(c / 50) + 1 AS INTEGER) AS label FROM occ),
allpts AS (SELECT fov, event_id AS id, r, c FROM pts),
seed AS (SELECT DISTINCT fov, r, c, CAST(floor(r / 50) * 1000 + floor(c / 50) + 1 AS INTEGER) AS label FROM pts WHERE target = 'purchase')"""
MIRROR = """mr AS (SELECT c.fov, unnest(list_filter([r, CASE WHEN r > 0 AND r <= {k} THEN -r END, CASE WHEN r >= h - 1 - {k} AND r < h - 1 THEN 2 * (h - 1) - r END], lambda x: x IS NOT NULL)) AS r, c, v, h, w FROM chan c JOIN ext USING (fov)),
mir AS (SELECT fov, r, unnest(list_filter([c, CASE WHEN c > 0 AND c <= {k} THEN -c END, CASE WHEN c >= w - 1 - {k} AND c < w - 1 THEN 2 * (w - 1) - c END], lambda x: x IS NOT NULL)) AS c, v, h, w FROM mr)"""
CONV = MIRROR.format(k=10) + """,
conv AS (SELECT fov, r - dy AS r, c - dx AS c, sum(v) AS v FROM mir, (SELECT unnest(range(-5, 5))::INTEGER AS dy) y, (SELECT unnest(range(-5, 5))::INTEGER AS dx) x
  WHERE r - dy >= 0 AND r - dy < h AND c - dx >= 0 AND c - dx < w GROUP BY ALL),
dense AS (SELECT fov, r, c FROM conv WHERE v > 4)"""
NEAR = """off AS (SELECT dy, dx FROM (SELECT unnest(range(-{d}, {d} + 1))::INTEGER AS dy), (SELECT unnest(range(-{d}, {d} + 1))::INTEGER AS dx) WHERE dy * dy + dx * dx <= {d} * {d} AND dy * dy + dx * dx > 0),
near AS (SELECT s.fov, s.r + dy AS r, s.c + dx AS c, min(dy * dy + dx * dx) AS d2, arg_min(s.label, (dy * dy + dx * dx, s.r, s.c)) AS label
  FROM seed s, off JOIN ext e ON true WHERE s.fov = e.fov AND s.r + dy >= 0 AND s.r + dy < h AND s.c + dx >= 0 AND s.c + dx < w GROUP BY s.fov, s.r + dy, s.c + dx),
free AS (SELECT n.* FROM near n ANTI JOIN seed s ON n.fov = s.fov AND n.r = s.r AND n.c = s.c)"""
RING = "CASE WHEN d2 <= 4 THEN 2 WHEN d2 <= 16 THEN 4 ELSE 6 END"


def _components(name: str, source: str, eight: bool = True, value: str = "0") -> str:
    """CTEs that label the pixels of a relation (fov, r, c) by component, of equal values only: ``name`` (fov, r, c, value, lab, label), lab being its first pixel."""
    reach = 1 if eight else 0
    return f"""{name}_run AS (SELECT fov, value, r, min(c) AS c0, max(c) AS c1, min(CAST(r AS BIGINT) * 100000 + c) AS id FROM (
  SELECT fov, r, c, value, c - row_number() OVER (PARTITION BY fov, value, r ORDER BY c) AS g FROM (SELECT fov, r, c, {value} AS value FROM {source})) GROUP BY fov, value, r, g),
{name}_lab AS (SELECT fov, id, min(m) AS lab FROM (SELECT * FROM (WITH RECURSIVE cc(fov, id, value, r, c0, c1, lab) USING KEY (fov, id) AS (
  SELECT fov, id, value, r, c0, c1, id FROM {name}_run UNION
  SELECT p.fov, p.id, any_value(p.value), any_value(p.r), any_value(p.c0), any_value(p.c1), min(q.lab) FROM recurring.cc p JOIN (SELECT *, unnest([r - 1, r + 1]) AS by_ FROM cc) q
    ON p.fov = q.fov AND p.r = q.by_ AND p.value = q.value AND p.c0 <= q.c1 + {reach} AND p.c1 >= q.c0 - {reach} GROUP BY p.fov, p.id HAVING min(q.lab) < any_value(p.lab))
  SELECT fov, id, lab AS m FROM cc)) GROUP BY fov, id),
{name} AS (SELECT fov, r, unnest(range(c0, c1 + 1))::INTEGER AS c, value, lab, CAST(dense_rank() OVER (PARTITION BY fov ORDER BY lab) AS INTEGER) AS label FROM {name}_run JOIN {name}_lab USING (fov, id))"""


def _holes(source: str) -> str:
    """CTEs: gaps, the background of a mask in runs within a frame; holepx, what the frame isn't joined to; filled, the mask with it."""
    return f"""gaps AS (SELECT fov, r, before + 1 AS c0, c - 1 AS c1 FROM (SELECT *, lag(c) OVER (PARTITION BY fov, r ORDER BY c) AS before FROM (
  SELECT fov, r, c FROM {source} UNION ALL SELECT fov, r, unnest([-2, w + 1]) FROM (SELECT fov, w, unnest(range(-1, h + 1))::INTEGER AS r FROM ext))) WHERE c - before > 1),
outside(fov, r, c0, c1) AS (SELECT * FROM gaps WHERE r = -1 UNION
  SELECT g.fov, g.r, g.c0, g.c1 FROM (SELECT *, unnest([r - 1, r + 1]) AS by_ FROM outside) o JOIN gaps g ON g.fov = o.fov AND g.r = o.by_ AND g.c0 <= o.c1 AND g.c1 >= o.c0),
holepx AS (SELECT fov, r, unnest(range(c0, c1 + 1))::INTEGER AS c FROM (SELECT * FROM gaps EXCEPT SELECT * FROM outside)),
filled AS (SELECT fov, r, c FROM {source} UNION SELECT * FROM holepx)"""


# A traced ring runs through pixel centres: of a square of four centres it holds all if all are the region's, and half if three are.
def _block_areas(name: str, source: str, half: int) -> str:
    return f"""{name} AS (SELECT fov, lab, sum(CASE WHEN n = {half} THEN 0.5 WHEN n = 4 OR n > {half} THEN 1 ELSE 0 END) AS area FROM (
  SELECT fov, lab, r - dy AS r, c - dx AS c, count(*) AS n FROM {source}, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(dy, dx) GROUP BY ALL) GROUP BY fov, lab)"""


def _contours(source: str, signal: str) -> str:
    """CTEs for the rings of a mask: rings (fov, first, hole, area) with some of the signal inside; a hole's first pixel is the one above its own."""
    return ",\n".join([_components("body", source), _holes(source), _components("hole", "holepx", eight=False), _block_areas("net", "body", 3), _block_areas("hole_area", "hole", 1), f"""owner AS (
  SELECT a.fov, a.lab, a.area, b.lab AS body FROM hole_area a JOIN body b ON b.fov = a.fov AND b.r = a.lab // 100000 AND b.c = a.lab % 100000 - 1),
rings AS (
  SELECT n.fov, n.lab AS first, false AS hole, n.area + coalesce(sum(o.area), 0) AS area FROM net n LEFT JOIN owner o ON o.fov = n.fov AND o.body = n.lab
    WHERE (n.fov, n.lab) IN (SELECT (b.fov, b.lab) FROM body b JOIN {signal} s USING (fov, r, c) WHERE s.v > 0) GROUP BY n.fov, n.lab, n.area
  UNION ALL SELECT fov, lab - 100000, true, area FROM hole_area
    WHERE (fov, lab) IN (SELECT (h.fov, h.lab) FROM hole h JOIN {signal} s ON s.fov = h.fov AND abs(s.r - h.r) + abs(s.c - h.c) <= 1 WHERE s.v > 0))"""])


COMP = _components("labelled", "occ")
# Regions: components of the dense mask with its holes filled, of the least area
REGIONS = ",\n".join([_holes("dense"), _components("body", "filled"), _block_areas("body_area", "body", 3),
    f"regions AS (SELECT b.fov, b.lab, b.r, b.c, a.area FROM body b JOIN body_area a USING (fov, lab) WHERE a.area >= {LEAST_AREA} AND (b.fov, b.lab) IN (SELECT (x.fov, x.lab) FROM body x JOIN chan USING (fov, r, c)))"])
# Clusters by density: labels of cores fall along links of cores; other points go with the core of least id in reach
CLUSTERS = """near3 AS (SELECT p.fov, p.id, q.id AS id2 FROM allpts p JOIN allpts q ON p.fov = q.fov AND (p.r - q.r) * (p.r - q.r) + (p.c - q.c) * (p.c - q.c) <= {d2}),
core AS (SELECT fov, id FROM near3 GROUP BY fov, id HAVING count(*) >= {least}),
link AS (SELECT n.fov, n.id, n.id2 FROM near3 n SEMI JOIN core a ON a.fov = n.fov AND a.id = n.id SEMI JOIN core b ON b.fov = n.fov AND b.id = n.id2),
grp AS (SELECT fov, id, min(m) AS lab FROM (SELECT * FROM (WITH RECURSIVE cc(fov, id, lab) USING KEY (fov, id) AS (
  SELECT fov, id, id FROM core UNION
  SELECT l.fov, l.id, min(q.lab) FROM cc q JOIN link l ON l.fov = q.fov AND l.id2 = q.id JOIN recurring.cc p ON p.fov = l.fov AND p.id = l.id GROUP BY l.fov, l.id HAVING min(q.lab) < any_value(p.lab))
  SELECT fov, id, lab AS m FROM cc)) GROUP BY fov, id),
member AS (SELECT n.fov, n.id, g.lab FROM (SELECT n.fov, n.id, CASE WHEN bool_or(n.id = n.id2) THEN n.id ELSE min(n.id2) END AS core FROM near3 n JOIN core c ON c.fov = n.fov AND c.id = n.id2 GROUP BY n.fov, n.id) n
  JOIN grp g ON g.fov = n.fov AND g.id = n.core),
named AS (SELECT fov, lab, row_number() OVER (PARTITION BY fov ORDER BY min(id)) - 1 AS cluster FROM member GROUP BY fov, lab),
clustered AS (SELECT p.fov, p.id, p.r, p.c, CAST(coalesce(cluster, -1) AS INTEGER) AS cluster FROM allpts p LEFT JOIN (member JOIN named USING (fov, lab)) m ON m.fov = p.fov AND m.id = p.id)"""
PAIRS = """pairs AS (SELECT p.fov, p.id, p.r, p.c, q.id AS id2, q.r AS r2, q.c AS c2 FROM allpts p JOIN allpts q ON p.fov = q.fov AND (p.r - q.r) * (p.r - q.r) + (p.c - q.c) * (p.c - q.c) <= 25),
cnt AS (SELECT fov, id, r, c, count(*) AS n FROM pairs GROUP BY ALL)"""
# The patches, their centroids by the squares of four centres, and seeds there
WIDE = CONV.replace("v > 4", "v > 2")
CENTROIDS = """blk AS (SELECT fov, lab, r - dy AS r0, c - dx AS c0, count(*) AS n, sum(r) AS sr, sum(c) AS sc FROM (SELECT DISTINCT fov, lab, r, c FROM regions), (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(dy, dx) GROUP BY ALL),
cent AS (SELECT fov, lab, sum(w * sc / n) / sum(w) AS cx, sum(w * sr / n) / sum(w) AS cy FROM (SELECT *, CASE WHEN n = 4 THEN 1.0 WHEN n = 3 THEN 0.5 ELSE 0.0 END::DOUBLE AS w FROM blk) GROUP BY fov, lab)"""
SEEDS = CENTROIDS + """,
seeds AS (SELECT fov, CAST(row_number() OVER (PARTITION BY fov ORDER BY class, lab) - 1 AS INTEGER) AS idx, class, round(cx, 6) AS cx, round(cy, 6) AS cy FROM (SELECT *, CASE WHEN lab % 2 = 0 THEN 'A' ELSE 'B' END AS class FROM cent))"""
COUNTS = ", ".join(f"CAST(count(CASE WHEN target = '{t}' THEN 1 END) AS BIGINT) AS {t}" for t in TYPES)
OBJECT = """count(*) AS area, round(avg(r), 6) AS centroid_y, round(avg(c), 6) AS centroid_x, min(r) AS min_row, min(c) AS min_col, max(r) + 1 AS max_row, max(c) + 1 AS max_col"""


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _region_counts(s: Scene) -> DataFrame:
    return features.counts(s.dense(), s.pres, ["click", "view", "error"], ["fov"], "area")


def _objects(rows: DataFrame) -> DataFrame:
    return _rounded(features.objects(rows), "centroid_y", "centroid_x").drop("eccentricity")


def _lineitem(s: Scene) -> DataFrame:
    li = s.spark.read.parquet(f"{s.sf_dir}/lineitem.parquet")
    pts = li.select(F.col("l_suppkey").alias("fov"), F.col("l_quantity").cast("int").alias("r"), F.rint(F.col("l_discount") * 100).cast("int").alias("c"), F.concat("l_returnflag", "l_linestatus").alias("target"))
    return pts.dropDuplicates().groupBy("fov", "target").agg(F.count(F.lit(1)).alias("n"))


def _sql(tail: str, *parts: str, recursive: bool = False) -> str:
    return "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join([PTS, *parts]) + "\n" + tail


BIN_SQL = "b10 AS (SELECT fov, CAST(floor(r / 10) AS BIGINT) AS bx, CAST(floor(c / 10) AS BIGINT) AS by_, " + COUNTS + ", round(avg(r), 6) AS x_mean, round(avg(c), 6) AS y_mean FROM pts GROUP BY 1, 2, 3), bt AS (SELECT *, click + view + purchase + signup + error AS total FROM b10)"

UNIT_SQL = """norm AS (SELECT fov, bx, by_, """ + ", ".join(f"ln(1 + {t} * (SELECT median(total) FROM bt WHERE total >= 2) / total) AS {t}" for t in TYPES) + """ FROM bt WHERE total >= 2),
units AS (SELECT fov, bx, by_, click, view, purchase, signup, error, list_min(list_transform(""" + str(list(range(len(BIN_UNITS)))) + """, lambda i: {'d2': list_sum(list_transform(list_zip([click, view, purchase, signup, error], (""" + str(BIN_UNITS) + """)[i + 1]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'i': i}))['i'] AS cluster FROM norm)"""


def _first():
    """A ring's first pixel in raster order."""
    return F.array_min(F.transform("ring", lambda p: p["y"].cast("long") * 100000 + p["x"])).alias("first")


def _measured_sql(source: str, extra: str, keys: str) -> str:
    """Pixels and counts of a relation's groups, each measured by itself."""
    return f"SELECT {extra} FROM (SELECT {keys}, count(*) AS area, round(avg(r), 6) AS my, round(avg(c), 6) AS mx FROM {source} GROUP BY ALL) JOIN (SELECT {keys}, {COUNTS} FROM {source} LEFT JOIN pres USING (fov, r, c) GROUP BY ALL) USING ({keys})"


EPOCHS, PULL = 3, 0.5


def _normal(s: Scene) -> DataFrame:
    return staged(bins.normalised(s.binned(), TYPES, 2).withColumn("e", F.array(*TYPES)))


def _units(s: Scene) -> DataFrame:
    """The units of a map that is trained on all bins."""
    found = bins.som_batch(_normal(s), "e", (2, 1), EPOCHS, PULL)
    return s.spark.createDataFrame([(i, *(round(x, 6) for x in u)) for i, u in enumerate(found)], "unit int, " + ", ".join(f"{t} double" for t in TYPES))


def _mapped(s: Scene) -> DataFrame:
    """All bins with their unit of that map."""
    rows = _normal(s)
    return bins.assigned(rows, "e", bins.som_batch(rows, "e", (2, 1), EPOCHS, PULL)).withColumnRenamed("unit", "cluster")


def _map_sql() -> str:
    """CTEs that train the map: u0, u1, ... (unit, a column a target), one pair of relations an epoch; units, the bins with their unit at the end."""
    far = " + ".join(f"(n.{t} - u.{t}) * (n.{t} - u.{t})" for t in TYPES)
    parts = [UNIT_SQL.split(",\nunits AS")[0], "u0 AS (SELECT unit, " + ", ".join(f"avg({t}) + (unit - 0.5) * stddev_pop({t}) AS {t}" for t in TYPES) + " FROM norm, (VALUES (0), (1)) v(unit) GROUP BY unit)"]
    for e in range(EPOCHS):
        wide = PULL / (1 + 2 * e / EPOCHS)
        pull = f"(CASE WHEN v.unit = s.unit THEN 1.0 ELSE {math.exp(-1 / (2 * wide * wide))!r} END)::DOUBLE"
        parts.append(f"s{e} AS (SELECT unit, count(*) AS n, {', '.join(f'sum({t}) AS {t}' for t in TYPES)} FROM (SELECT any_value(n) AS x, arg_min(u.unit, ({far}, u.unit)) AS unit, {', '.join(f'n.{t}' for t in TYPES)} FROM norm n, u{e} u GROUP BY n.fov, n.bx, n.by_, {', '.join(f'n.{t}' for t in TYPES)}) GROUP BY unit)")
        parts.append(f"u{e + 1} AS (SELECT v.unit, {', '.join(f'sum({pull} * s.{t}) / sum({pull} * s.n) AS {t}' for t in TYPES)} FROM (VALUES (0), (1)) v(unit), s{e} s GROUP BY v.unit)")
    parts.append(f"units AS (SELECT n.fov, n.bx, n.by_, {', '.join(f'n.{t}' for t in TYPES)}, CAST(arg_min(u.unit, ({far}, u.unit)) AS INTEGER) AS cluster FROM norm n, u{EPOCHS} u GROUP BY n.fov, n.bx, n.by_, {', '.join(f'n.{t}' for t in TYPES)})")
    return ",\n".join(parts)


MAP_SQL = _map_sql()
LONG_SQL = "lng AS (UNPIVOT (SELECT cluster, click, view, purchase, signup, error FROM units) ON click, view, purchase, signup, error INTO NAME target VALUE v)"
MARKER_TAIL = """SELECT grp, target, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, target) AS rk FROM (
  SELECT grp, target, (s / n - (ts - s) / (tn - n)) / sqrt((q - s * s / n) / (n - 1) / n + ((tq - q) - (ts - s) * (ts - s) / (tn - n)) / (tn - n - 1) / (tn - n)) AS score
  FROM (SELECT cluster AS grp, target, count(*)::DOUBLE AS n, sum(v) AS s, sum(v * v) AS q FROM lng GROUP BY cluster, target) JOIN (SELECT target, count(*)::DOUBLE AS tn, sum(v) AS ts, sum(v * v) AS tq FROM lng GROUP BY target) USING (target)) WHERE score IS NOT NULL) WHERE rk <= 2"""


def _som(rows: DataFrame) -> DataFrame:
    return bins.assigned(rows, "e", bins.som_units(rows, "vec_id", "e", (2, 2))).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


# name: (query, SQL or None)
CATALOG = {
    "region_bulk_counts": (_region_counts, _sql("SELECT d.fov, CAST(count(CASE WHEN target = 'click' THEN 1 END) AS BIGINT) AS click, CAST(count(CASE WHEN target = 'view' THEN 1 END) AS BIGINT) AS view, CAST(count(CASE WHEN target = 'error' THEN 1 END) AS BIGINT) AS error, count(DISTINCT (d.r, d.c)) AS area FROM dense d LEFT JOIN pres p ON d.fov = p.fov AND d.r = p.r AND d.c = p.c GROUP BY d.fov", CONV)),
    "clean_points": (lambda s: source.clean(s.pts.select("fov", F.col("r").alias("x"), F.col("c").alias("y"), "target")).groupBy("fov", "target").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("sr"), F.sum("c").alias("sc")),
        _sql("SELECT fov, target, count(*) AS n, CAST(sum(r - r0) AS BIGINT) AS sr, CAST(sum(c - c0) AS BIGINT) AS sc FROM pts JOIN (SELECT fov, min(r) AS r0, min(c) AS c0 FROM pts WHERE NOT regexp_matches(target, 'System|egative') GROUP BY fov) USING (fov) WHERE NOT regexp_matches(target, 'System|egative') GROUP BY ALL")),
    "extent": (lambda s: s.ext, _sql("SELECT * FROM ext")),
    "presence_raster": (lambda s: s.pres, _sql("SELECT * FROM pres")),
    "presence_collapse": (_lineitem, "SELECT l_suppkey AS fov, l_returnflag || l_linestatus AS target, count(DISTINCT (CAST(trunc(l_quantity) AS INTEGER), CAST(round_even(l_discount * 100, 0) AS INTEGER))) AS n FROM lineitem GROUP BY ALL"),
    "gene_subset": (lambda s: raster.subset(s.pres, ["view", "click", "view", "none"]), _sql("SELECT fov, r, c, target, channel FROM pres JOIN (VALUES ('view', 0), ('click', 1), ('view', 2), ('none', 3)) t(target, channel) USING (target)")),
    "channel_sum": (lambda s: s.chan, _sql("SELECT * FROM chan")),
    "target_value_counts": (lambda s: s.pts.groupBy("target").agg(F.count(F.lit(1)).alias("n")), _sql("SELECT target, count(*) AS n FROM pts GROUP BY target")),
    "conv_square": (lambda s: raster.density(s.chan, s.ext, 10, "square"), _sql("SELECT fov, r, c, CAST(v AS BIGINT) AS v FROM conv", CONV)),
    "conv_circle": (lambda s: raster.density(s.chan, s.ext, 5, "circle"), _sql("SELECT fov, r - dy AS r, c - dx AS c, CAST(sum(v) AS BIGINT) AS v FROM mir, (VALUES " + ", ".join(map(str, raster.ellipse_offsets(5))) + ") o(dy, dx) WHERE r - dy >= 0 AND r - dy < h AND c - dx >= 0 AND c - dx < w GROUP BY ALL", MIRROR.format(k=5))),
    "density_high": (lambda s: s.dense(), _sql("SELECT * FROM dense", CONV)),
    "density_low": (lambda s: features.bulk(raster.threshold(raster.box_sum(s.chan, s.ext, 10), s.ext, 2, "lower")), _sql("SELECT fov, count(*) AS area FROM grid g LEFT JOIN conv v USING (fov, r, c) WHERE coalesce(v.v, 0) < 2 GROUP BY fov", CONV)),
    "mask_union": (lambda s: masks.union(s.of("click"), s.not_of("click")), _sql("SELECT * FROM a UNION SELECT * FROM b")),
    "mask_intersect": (lambda s: masks.intersect(s.of("click"), s.not_of("click")), _sql("SELECT * FROM a INTERSECT SELECT * FROM b")),
    "mask_subtract": (lambda s: masks.subtract(s.of("click"), s.not_of("click")), _sql("SELECT * FROM a EXCEPT SELECT * FROM b")),
    "mask_complement": (lambda s: features.bulk(masks.complement(s.of("click"), s.ext)), _sql("SELECT fov, count(*) AS area FROM (SELECT fov, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c FROM grid EXCEPT SELECT * FROM a) GROUP BY fov")),
    "mask_ones": (lambda s: features.bulk(raster.grid(s.ext)), _sql("SELECT fov, CAST(h AS BIGINT) * w AS area FROM ext")),
    "mask_transpose": (lambda s: masks.transpose(s.of("click")), _sql("SELECT fov, c AS r, r AS c FROM a")),
    "dilate": (lambda s: masks.dilate(s.of("click"), s.ext, 3), _sql("SELECT DISTINCT a.fov, a.r + dy AS r, a.c + dx AS c FROM a JOIN ext USING (fov), (SELECT unnest(range(-1, 2))::INTEGER AS dy), (SELECT unnest(range(-1, 2))::INTEGER AS dx) WHERE a.r + dy >= 0 AND a.r + dy < h AND a.c + dx >= 0 AND a.c + dx < w")),
    "erode": (lambda s: masks.erode(s.dense(), s.ext, 3), _sql("SELECT d.fov, d.r, d.c FROM dense d JOIN ext USING (fov) JOIN dense n ON n.fov = d.fov AND abs(n.r - d.r) <= 1 AND abs(n.c - d.c) <= 1 GROUP BY d.fov, d.r, d.c, h, w HAVING count(*) = (least(d.r + 1, h - 1) - greatest(d.r - 1, 0) + 1) * (least(d.c + 1, w - 1) - greatest(d.c - 1, 0) + 1)", CONV)),
    "mask_open": (lambda s: features.bulk(masks.morphology(s.dense(), s.ext, "open", 3)), _sql("SELECT fov, count(DISTINCT (e.r + dy, e.c + dx)) AS area FROM er e JOIN ext USING (fov), (SELECT unnest(range(-1, 2))::INTEGER AS dy), (SELECT unnest(range(-1, 2))::INTEGER AS dx) WHERE e.r + dy >= 0 AND e.r + dy < h AND e.c + dx >= 0 AND e.c + dx < w GROUP BY fov", CONV, "er AS (SELECT d.fov, d.r, d.c FROM dense d JOIN ext USING (fov) JOIN dense n ON n.fov = d.fov AND abs(n.r - d.r) <= 1 AND abs(n.c - d.c) <= 1 GROUP BY d.fov, d.r, d.c, h, w HAVING count(*) = (least(d.r + 1, h - 1) - greatest(d.r - 1, 0) + 1) * (least(d.c + 1, w - 1) - greatest(d.c - 1, 0) + 1))")),
    "mask_close": (lambda s: features.bulk(masks.morphology(s.of("click"), s.ext, "close", 3)),
        _sql("SELECT fov, count(*) AS area FROM (SELECT d.fov, d.r, d.c FROM dl d JOIN ext USING (fov) JOIN dl n ON n.fov = d.fov AND abs(n.r - d.r) <= 1 AND abs(n.c - d.c) <= 1 GROUP BY d.fov, d.r, d.c, h, w HAVING count(*) = (least(d.r + 1, h - 1) - greatest(d.r - 1, 0) + 1) * (least(d.c + 1, w - 1) - greatest(d.c - 1, 0) + 1)) GROUP BY fov",
             "dl AS (SELECT DISTINCT a.fov, a.r + dy AS r, a.c + dx AS c FROM a JOIN ext USING (fov), (SELECT unnest(range(-1, 2))::INTEGER AS dy), (SELECT unnest(range(-1, 2))::INTEGER AS dx) WHERE a.r + dy >= 0 AND a.r + dy < h AND a.c + dx >= 0 AND a.c + dx < w)")),
    "label_area_filter": (lambda s: masks.labelled_area_filter(s.tiles(), 150), _sql("SELECT * FROM tiles SEMI JOIN (SELECT fov, label FROM tiles GROUP BY ALL HAVING count(*) >= 150) USING (fov, label)")),
    "connected_components": (lambda s: masks.label(s.tiles()).groupBy("fov", "label").agg(F.count(F.lit(1)).alias("area"), F.sum("r").alias("sr")), _sql("SELECT fov, label, count(*) AS area, CAST(sum(r) AS BIGINT) AS sr FROM labelled GROUP BY fov, label", COMP, recursive=True)),
    "binary_area_filter": (lambda s: features.bulk(masks.area_filter(s.tiles(), 3)), _sql("SELECT fov, CAST(sum(n) AS BIGINT) AS area FROM (SELECT fov, label, count(*) AS n FROM labelled GROUP BY ALL HAVING count(*) >= 3) GROUP BY fov", COMP, recursive=True)),
    "fill_holes": (lambda s: features.bulk(masks.fill_holes(s.dense(), s.ext)), _sql("SELECT fov, count(*) AS area FROM filled GROUP BY fov", CONV, _holes("dense"), recursive=True)),
    "equal_components": (lambda s: masks.label(s.tiles(), value="label").groupBy("fov", "label").agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("area")),
        _sql("SELECT fov, label, min(value) AS value, count(*) AS area FROM same GROUP BY fov, label", _components("same", "tiles", value="label"))),
    "object_mask": (lambda s: masks.object_mask(s.regions().select(*PX), s.of("click"), least=50), _sql("SELECT fov, r, c FROM kept JOIN (SELECT fov, lab FROM kept GROUP BY ALL HAVING count(*) >= 50) USING (fov, lab)", CONV, REGIONS, "rest AS (SELECT fov, r, c FROM regions EXCEPT SELECT * FROM a)", _components("kept", "rest"), recursive=True)),
    "mask_padded": (lambda s: masks.padded(s.of("click"), s.ext, 700, 1700, "centred")[0], _sql("SELECT fov, CAST(r + (700 - h) // 2 AS INTEGER) AS r, CAST(c + (1700 - w) // 2 AS INTEGER) AS c FROM a JOIN ext USING (fov)")),
    "bulk_features": (lambda s: features.bulk(s.dense()), _sql("SELECT fov, count(*) AS area FROM dense GROUP BY fov", CONV)),
    "object_features": (lambda s: _objects(s.tiles()), _sql(f"SELECT fov, label, {OBJECT} FROM tiles GROUP BY fov, label")),
    "object_features_components": (lambda s: _objects(masks.label(s.tiles())), _sql(f"SELECT fov, label, {OBJECT} FROM labelled GROUP BY fov, label", COMP, recursive=True)),
    "object_eccentricity": (lambda s: features.objects(s.tiles()).select("fov", "label", F.round("eccentricity", 4).alias("eccentricity")),
        _sql("SELECT fov, label, CASE WHEN a + b + q > 0 THEN round(sqrt(greatest(0, 1 - (a + b - q) / (a + b + q))), 4) ELSE 0.0 END AS eccentricity FROM (SELECT *, sqrt((a - b) * (a - b) + 4 * m * m) AS q FROM (SELECT fov, label, var_pop(r) AS a, var_pop(c) AS b, covar_pop(r, c) AS m FROM tiles GROUP BY fov, label))")),
    "object_gene_counts": (lambda s: features.counts(s.tiles(), s.pres, TYPES, ["fov", "label"]), _sql(f"SELECT fov, label, {COUNTS} FROM tiles LEFT JOIN pres USING (fov, r, c) GROUP BY fov, label")),
    "grid_features": (lambda s: _rounded(features.grid_tiles(s.tiles(), 10).groupBy("fov", "label", "tile_y", "tile_x").agg(F.count(F.lit(1)).alias("area"), F.avg("c").alias("x"), F.avg("r").alias("y")), "x", "y"),
        _sql("SELECT fov, label, CAST(floor(r / 10) * 10 AS INTEGER) AS tile_y, CAST(floor(c / 10) * 10 AS INTEGER) AS tile_x, count(*) AS area, round(avg(c), 6) AS x, round(avg(r), 6) AS y FROM tiles GROUP BY 1, 2, 3, 4")),
    "grid_gene_counts": (lambda s: features.counts(features.grid_tiles(s.tiles(), 10), s.pres, TYPES, ["fov", "label", "tile_y", "tile_x"]),
        _sql(f"SELECT fov, label, CAST(floor(r / 10) * 10 AS INTEGER) AS tile_y, CAST(floor(c / 10) * 10 AS INTEGER) AS tile_x, {COUNTS} FROM tiles LEFT JOIN pres USING (fov, r, c) GROUP BY 1, 2, 3, 4")),
    "mask_analysis": (lambda s: _rounded(features.analysed(s.definitions(), s.pres, TYPES, s.ext), "centroid_y", "centroid_x", "x", "y", "perimeter").select("fov", "mask_name", "analysis_type", "object_id", "grid_y", "grid_x", "area", "centroid_y", "centroid_x", "x", "y", *TYPES),
        _sql(f"SELECT fov, 'dense' AS mask_name, 'bulk' AS analysis_type, 'bulk' AS object_id, NULL AS grid_y, NULL AS grid_x, (SELECT count(*) FROM dense d WHERE d.fov = ext.fov) AS area, NULL AS centroid_y, NULL AS centroid_x, NULL AS x, NULL AS y, {COUNTS} FROM ext LEFT JOIN (SELECT d.fov, p.target FROM dense d JOIN pres p USING (fov, r, c)) USING (fov) GROUP BY fov UNION ALL "
             + _measured_sql("clicks", "fov, 'click', 'per_object', CAST(label AS VARCHAR), NULL, NULL, area, my, mx, NULL, NULL, " + ", ".join(TYPES), "fov, label") + " UNION ALL "
             + _measured_sql("tiled", "fov, 'dense', 'grid', CAST(label AS VARCHAR), gy, gx, area, NULL, NULL, mx, my, " + ", ".join(TYPES), "fov, label, gy, gx"),
             CONV, _components("clicks", "a"), _components("denses", "dense"), "tiled AS (SELECT *, CAST(floor(r / 50) * 50 AS INTEGER) AS gy, CAST(floor(c / 50) * 50 AS INTEGER) AS gx FROM denses)")),
    "hierarchy_apply": (lambda s: features.with_parents(features.analysed(s.definitions()[:2], s.pres, MARKED, s.ext), features.hierarchies({"click": (s.of("click"), s.tiles(), "tiles")}), ["click"]).select("fov", "mask_name", "object_id", "area", "parent_ids"),
        _sql("SELECT fov, 'dense' AS mask_name, 'bulk' AS object_id, (SELECT count(*) FROM dense d WHERE d.fov = ext.fov) AS area, NULL AS parent_ids FROM ext UNION ALL SELECT k.fov, 'click', CAST(k.label AS VARCHAR), count(*), list_sort(list_distinct(list(t.label))) FROM clicks k JOIN tiles t USING (fov, r, c) GROUP BY k.fov, k.label", CONV, _components("clicks", "a"))),
    "hierarchy_table": (lambda s: features.hierarchies({"click": (s.of("click"), s.tiles(), "tiles")}), _sql("SELECT k.fov, 'click' AS mask_name, k.label AS object_id, 'tiles' AS parent_mask, list_sort(list_distinct(list(t.label))) AS parent_ids FROM clicks k JOIN tiles t USING (fov, r, c) GROUP BY k.fov, k.label", _components("clicks", "a"))),
    "merged_features": (lambda s: features.merged(features.objects(s.tiles()).select("fov", "label", "area", F.lit(0).cast("long").alias("click")), features.counts(s.tiles(), s.pres, ["click", "view"], ["fov", "label"]).where(F.col("click") > 20), ["fov", "label"]),
        _sql("SELECT fov, label, count(DISTINCT (r, c)) AS area, CASE WHEN count(CASE WHEN target = 'click' THEN 1 END) > 20 THEN count(CASE WHEN target = 'click' THEN 1 END) ELSE 0 END AS click, CASE WHEN count(CASE WHEN target = 'click' THEN 1 END) > 20 THEN count(CASE WHEN target = 'view' THEN 1 END) END AS view FROM tiles JOIN pres USING (fov, r, c) GROUP BY fov, label")),
    "negative_counts": (lambda s: features.negative_counts(s.binned().select("fov", "bx", F.col("by").alias("by_"), (F.col("click") - 1).alias("click"), "view"), MARKED).drop("view"), _sql("SELECT fov, bx, by_, 'click' AS target, CAST(-1 AS BIGINT) AS count FROM bt WHERE click = 0", BIN_SQL)),
    "relabelled_targets": (lambda s: s.pts.groupBy(relabelled(F.col("target"), {"click": "touch", "view": "look"}).alias("target")).agg(F.count(F.lit(1)).alias("n")).where(F.col("target").isin("touch", "look", "error")),
        _sql("SELECT CASE target WHEN 'click' THEN 'touch' WHEN 'view' THEN 'look' ELSE target END AS target, count(*) AS n FROM pts WHERE target IN ('click', 'view', 'error') GROUP BY 1")),
    "gene_reraster": (lambda s: raster.reraster(s.pts, ["view", "error", "none"], "event_id"), _sql("SELECT DISTINCT fov, r, c, target, CAST(channel AS INTEGER) AS channel FROM pts JOIN (SELECT target, row_number() OVER (ORDER BY min(event_id), target) - 1 AS channel FROM pts WHERE target IN ('view', 'error') GROUP BY target) USING (target)")),
    "ring_expansion": (lambda s: expand.rings(s.purchases(), s.ext, [6, 2, 4, 2]), _sql(f"SELECT fov, r, c, {RING} AS ring FROM free", NEAR.format(d=6))),
    "ring_far": (lambda s: expand.rings(s.purchases(), s.ext, [12, 40]).groupBy("fov", "ring").agg(F.count(F.lit(1)).alias("area"), F.sum("r").alias("sr"), F.sum("c").alias("sc")),
        _sql("SELECT fov, CASE WHEN d2 <= 144 THEN 12 ELSE 40 END AS ring, count(*) AS area, CAST(sum(r) AS BIGINT) AS sr, CAST(sum(c) AS BIGINT) AS sc FROM free GROUP BY ALL", NEAR.format(d=40))),
    "ring_constrained": (lambda s: expand.rings(s.purchases(), s.ext, [2, 4, 6], s.dense()), _sql(f"SELECT fov, r, c, {RING} AS ring FROM free SEMI JOIN dense USING (fov, r, c)", CONV, NEAR.format(d=6))),
    "ring_area_filtered": (lambda s: expand.rings(s.purchases(), s.ext, [2, 4], None, 30).groupBy("fov", "ring").agg(F.count(F.lit(1)).alias("area")),
        _sql("SELECT fov, ring, CAST(sum(n) AS BIGINT) AS area FROM (SELECT fov, value AS ring, label, count(*) AS n FROM kept GROUP BY ALL HAVING count(*) >= 30) GROUP BY fov, ring", NEAR.format(d=4), "banded AS (SELECT fov, r, c, CASE WHEN d2 <= 4 THEN 2 ELSE 4 END AS ring FROM free)", _components("kept", "banded", value="ring"))),
    "mask_expanded": (lambda s: expand.expanded(s.of("purchase"), s.ext, 5), _sql("SELECT fov, r, c FROM free", NEAR.format(d=5))),
    "constraint_remaining": (lambda s: expand.constraint_remaining(s.dense(), expand.rings(s.purchases(), s.ext, [2, 4, 6], s.dense())), _sql("SELECT * FROM dense ANTI JOIN free USING (fov, r, c)", CONV, NEAR.format(d=6))),
    "nearest_label": (lambda s: expand.nearest(s.purchases(), s.ext, 6).select(*PX, F.col("d2").cast("int").alias("d2"), "label"), _sql("SELECT fov, r, c, CAST(d2 AS INTEGER) AS d2, label FROM free", NEAR.format(d=6))),
    "label_propagation": (lambda s: expand.propagate(s.purchases(), s.ext, [2, 4]),
        _sql("SELECT fov, r, c, 2 AS ring, label FROM free WHERE d2 <= 4 UNION ALL SELECT k.fov, k.r + y AS r, k.c + x AS c, 4 AS ring, arg_min(k.label, (y * y + x * x, k.r, k.c)) AS label FROM known k, o3 SEMI JOIN far ON far.fov = k.fov AND far.r = k.r + y AND far.c = k.c + x GROUP BY k.fov, k.r + y, k.c + x",
             NEAR.format(d=4), "known AS (SELECT fov, r, c, label FROM seed UNION ALL SELECT fov, r, c, label FROM free WHERE d2 <= 4)", "far AS (SELECT fov, r, c FROM free WHERE d2 > 4)",
             "o3 AS (SELECT y, x FROM (SELECT unnest(range(-3, 4))::INTEGER AS y), (SELECT unnest(range(-3, 4))::INTEGER AS x) WHERE y * y + x * x <= 9)")),
    "hierarchy_map": (lambda s: features.hierarchy(s.purchases(), s.tiles()), _sql("SELECT s.fov, s.label, list_sort(list_distinct(list(t.label))) AS parent_ids FROM seed s LEFT JOIN tiles t USING (fov, r, c) GROUP BY s.fov, s.label")),
    "overlap_label_mask": (lambda s: _rounded(features.overlap(s.tiles().withColumnRenamed("label", "cell"), s.of("click").withColumn("mask", F.lit("a")).union(s.not_of("click").withColumn("mask", F.lit("b")))), "percent"),
        _sql("SELECT fov, cell, mask, coalesce(n, 0) AS n, round(coalesce(100.0 * n / sum(n) OVER (PARTITION BY fov, cell), 0), 6) AS percent FROM (SELECT DISTINCT fov, label AS cell, mask FROM tiles, (VALUES ('a'), ('b')) m(mask)) LEFT JOIN (SELECT fov, label AS cell, mask, count(*) AS n FROM tiles JOIN (SELECT *, 'a' AS mask FROM a UNION ALL SELECT *, 'b' FROM b) USING (fov, r, c) GROUP BY ALL) USING (fov, cell, mask)")),
    "radius_neighbor_count": (lambda s: neighbors.neighbor_count(s.all_points(), 5), _sql("SELECT * FROM cnt", PAIRS)),
    "neighbor_raster": (lambda s: neighbors.neighbor_raster(s.all_points(), 5), _sql("SELECT fov, r, c, arg_max(n, id) AS v FROM cnt GROUP BY fov, r, c", PAIRS)),
    "points_with_neighbors": (lambda s: neighbors.dense_points(s.all_points(), 5, 2), _sql("SELECT * FROM cnt WHERE n > 2", PAIRS)),
    "dbscan": (lambda s: neighbors.dbscan(s.all_points(), 5, 3), _sql("SELECT * FROM clustered", CLUSTERS.format(d2=25, least=3))),
    "cluster_circle": (lambda s: neighbors.cluster_circles(s.clusters(), 3).select("fov", "cluster", "n", F.round("cy", 4).alias("cy"), F.round("cx", 4).alias("cx"), F.round("radius", 4).alias("radius")),
        _sql("SELECT fov, cluster, n, round(cy, 4) AS cy, round(cx, 4) AS cx, round(greatest(max(sqrt((r - cy) * (r - cy) + (c - cx) * (c - cx))), 1.0), 4) AS radius FROM clustered JOIN (SELECT fov, cluster, avg(r) AS cy, avg(c) AS cx, count(*) AS n FROM clustered WHERE cluster >= 0 GROUP BY ALL) USING (fov, cluster) GROUP BY fov, cluster, n, cy, cx", CLUSTERS.format(d2=9, least=3))),
    "circle_masks": (lambda s: neighbors.circle_runs(neighbors.cluster_circles(s.clusters(), 3), s.ext).groupBy("fov", "cluster").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("area")),
        _sql("SELECT d.fov, cluster, count(*) AS area FROM disc d JOIN ext USING (fov), (SELECT unnest(range(-2000, 2001))::INTEGER AS dy) WHERE abs(dy) <= k AND y + dy BETWEEN 0 AND h - 1 GROUP BY ALL".replace("count(*)", "CAST(sum(least(x + CAST(floor(sqrt(k * k - dy * dy)) AS INTEGER), w - 1) - greatest(x - CAST(floor(sqrt(k * k - dy * dy)) AS INTEGER), 0) + 1) AS BIGINT)"), CLUSTERS.format(d2=9, least=3),
             "mid AS (SELECT fov, cluster, avg(r) AS cy, avg(c) AS cx FROM clustered WHERE cluster >= 0 GROUP BY ALL)",
             "disc AS (SELECT fov, cluster, CAST(trunc(cy) AS INTEGER) AS y, CAST(trunc(cx) AS INTEGER) AS x, CAST(trunc(greatest(max(sqrt((r - cy) * (r - cy) + (c - cx) * (c - cx))), 1.0)) AS INTEGER) AS k FROM clustered JOIN mid USING (fov, cluster) GROUP BY fov, cluster, cy, cx)")),
    "circle_contours": (lambda s: neighbors.cluster_contours(s.clusters(), s.ext, "simple_circle", 3).select("fov", "cluster", contours.ring_area(F.col("ring")).alias("area")),
        _sql("SELECT fov, lab AS cluster, CAST(area AS DOUBLE) AS area FROM ring_area", CLUSTERS.format(d2=9, least=3), "mid AS (SELECT fov, cluster, avg(r) AS cy, avg(c) AS cx FROM clustered WHERE cluster >= 0 GROUP BY ALL)",
             "disc AS (SELECT fov, cluster, CAST(trunc(cy) AS INTEGER) AS y, CAST(trunc(cx) AS INTEGER) AS x, CAST(trunc(greatest(max(sqrt((r - cy) * (r - cy) + (c - cx) * (c - cx))), 1.0)) AS INTEGER) AS k FROM clustered JOIN mid USING (fov, cluster) GROUP BY fov, cluster, cy, cx)",
             "rowed AS (SELECT d.fov, cluster AS lab, y + dy AS r, greatest(x - CAST(floor(sqrt(k * k - dy * dy)) AS INTEGER), 0) AS c0, least(x + CAST(floor(sqrt(k * k - dy * dy)) AS INTEGER), w - 1) AS c1 FROM (SELECT *, unnest(range(-k, k + 1))::INTEGER AS dy FROM disc) d JOIN ext USING (fov) WHERE y + dy BETWEEN 0 AND h - 1)",
             "round AS (SELECT fov, lab, r, unnest(range(c0, c1 + 1))::INTEGER AS c FROM rowed)", _block_areas("ring_area", "round", 3))),
    "concave_hull": (lambda s: neighbors.cluster_contours(s.clusters(), s.ext, "concave_hull", 3, 0.25).select("fov", "cluster", contours.ring_area(F.col("ring")).alias("area")), None),
    "convex_hull": (lambda s: neighbors.cluster_contours(s.clusters(), s.ext, "complex_hull", 3).select("fov", "cluster", F.explode(F.slice("ring", 2, 100000)).alias("p")).select("fov", "cluster", "p.x", "p.y"),
        _sql("SELECT fov, cluster, x, y FROM (SELECT fov, cluster, x, y, angle, lead(angle) OVER w AS next, first_value(angle) OVER w AS least, count(*) OVER (PARTITION BY fov, cluster, x, y) AS n FROM turn WINDOW w AS (PARTITION BY fov, cluster, x, y ORDER BY angle)) GROUP BY fov, cluster, x, y HAVING max(coalesce(next, least + 2 * pi()) - angle) > pi() + 1e-9 AND (fov, cluster) IN (SELECT (fov, cluster) FROM flat)",
             CLUSTERS.format(d2=9, least=3), "ends AS (SELECT DISTINCT fov, cluster, r AS y, unnest([min(c), max(c)]) AS x FROM clustered WHERE cluster >= 0 GROUP BY fov, cluster, r)",
             "turn AS (SELECT DISTINCT a.fov, a.cluster, a.x, a.y, atan2(b.y - a.y, b.x - a.x) AS angle FROM ends a JOIN ends b ON a.fov = b.fov AND a.cluster = b.cluster AND (a.x <> b.x OR a.y <> b.y))",
             "flat AS (SELECT DISTINCT a.fov, a.cluster FROM turn a JOIN turn b ON a.fov = b.fov AND a.cluster = b.cluster AND a.x = b.x AND a.y = b.y WHERE b.angle - a.angle > 1e-9 AND abs(b.angle - a.angle - pi()) > 1e-9)")),
    "bin_pivot": (lambda s: _rounded(bins.bin_counts(s.pts, 10, TYPES), "x_mean", "y_mean").select("fov", "bx", F.col("by").alias("by_"), *TYPES, "x_mean", "y_mean", "total"), _sql("SELECT * FROM bt", BIN_SQL)),
    "bin_preprocess": (lambda s: bins.normalised(bins.bin_counts(s.pts, 10, TYPES), TYPES, 2).select("fov", "bx", F.col("by").alias("by_"), "total", *(F.round(t, 6).alias(t) for t in TYPES), F.col("n_targets").cast("bigint").alias("n_targets")),
        _sql("SELECT fov, bx, by_, total, " + ", ".join(f"round(ln(1 + {t} * (SELECT median(total) FROM bt WHERE total >= 2) / total), 6) AS {t}" for t in TYPES) + ", CAST(" + " + ".join(f"({t} > 0)::INT" for t in TYPES) + " AS BIGINT) AS n_targets FROM bt WHERE total >= 2", BIN_SQL)),
    "som_assign": (lambda s: bins.assigned(s.spark.read.parquet(f"{s.sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e")), "e", UNITS).select("vec_id", "unit"),
        "WITH u AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {u}::DOUBLE[])" for i, u in enumerate(UNITS)) + ") t(unit, w)) SELECT vec_id, CAST(arg_min(unit, (list_sum(list_transform(list_zip(embedding, w), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2]))), unit)) AS INTEGER) AS unit FROM embeddings, u GROUP BY vec_id"),
    "cluster_sizes": (lambda s: s.units().groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), _sql("SELECT cluster, count(*) AS n FROM units GROUP BY cluster", BIN_SQL, UNIT_SQL)),
    "cluster_markers": (lambda s: bins.markers(s.units(), "cluster", TYPES, 4).select("grp", "target", F.round("score", 4).alias("score"), F.round("logfoldchange", 4).alias("logfoldchange")),
        _sql("SELECT grp, target, round(score, 4) AS score, round(logfoldchange, 4) AS logfoldchange FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, target) AS rk FROM (SELECT grp, target, (s / n - (ts - s) / (tn - n)) / sqrt((q - s * s / n) / (n - 1) / n + ((tq - q) - (ts - s) * (ts - s) / (tn - n)) / (tn - n - 1) / (tn - n)) AS score, log2((exp(s / n) - 1 + 1e-9) / (exp((ts - s) / (tn - n)) - 1 + 1e-9)) AS logfoldchange FROM (SELECT cluster AS grp, target, count(*)::DOUBLE AS n, sum(v) AS s, sum(v * v) AS q FROM lng GROUP BY cluster, target) JOIN (SELECT target, count(*)::DOUBLE AS tn, sum(v) AS ts, sum(v * v) AS tq FROM lng GROUP BY target) USING (target)) WHERE score IS NOT NULL) WHERE rk <= 4",
             BIN_SQL, UNIT_SQL, "lng AS (UNPIVOT (SELECT cluster, click, view, purchase, signup, error FROM units) ON click, view, purchase, signup, error INTO NAME target VALUE v)")),
    "marker_pvalues": (lambda s: bins.markers(s.units(), "cluster", TYPES, 5), None),
    "cluster_mask": (lambda s: features.bulk(masks.of_label(bins.cluster_image(s.units(), 10), 3)), _sql("SELECT fov, CAST(count(*) * 100 AS BIGINT) AS area FROM units WHERE cluster = 2 GROUP BY fov", BIN_SQL, UNIT_SQL)),
    "cluster_extent": (lambda s: bins.cluster_extent(s.units(), 10), _sql("SELECT fov, CAST((max(bx) + 1) * 10 AS INTEGER) AS h, CAST((max(by_) + 1) * 10 AS INTEGER) AS w FROM units GROUP BY fov", BIN_SQL, UNIT_SQL)),
    "bins_scaled": (lambda s: bins.scaled(s.binned(), TYPES, 3.0).select("fov", "bx", F.col("by").alias("by_"), *(F.round(t, 6).alias(t) for t in TYPES)),
        _sql("SELECT fov, bx, by_, " + ", ".join(f"round(greatest(least(({t} - (SELECT avg({t}) FROM bt)) / (SELECT stddev_samp({t}) FROM bt), 3.0), -3.0), 6) AS {t}" for t in TYPES) + " FROM bt", BIN_SQL)),
    "bin_coordinates": (lambda s: _rounded(bins.bin_counts(s.pts, 10, TYPES, "event_id"), "x_centroid", "y_centroid").select("fov", "bx", F.col("by").alias("by_"), "x_centroid", "y_centroid", "x_coord", "y_coord"),
        _sql("SELECT fov, CAST(floor(r / 10) AS BIGINT) AS bx, CAST(floor(c / 10) AS BIGINT) AS by_, round(avg(r) * 10, 6) AS x_centroid, round(avg(c) * 10, 6) AS y_centroid, arg_min(r, event_id) * 10 AS x_coord, arg_min(c, event_id) * 10 AS y_coord FROM pts GROUP BY 1, 2, 3")),
    "bin_cohort": (lambda s: bins.grouped_cohort(s.binned(), {"F0": TYPES, "F1": MARKED}, "all", TYPES).groupBy("name", "cohort").agg(*(F.sum(t).alias(t) for t in TYPES)),
        _sql("SELECT fov AS name, 'all' AS cohort, " + ", ".join(f"CAST(count(CASE WHEN target = '{t}'" + ("" if t in MARKED else " AND fov = 'F0'") + f" THEN 1 END) AS BIGINT) AS {t}" for t in TYPES) + " FROM pts WHERE fov IN ('F0', 'F1') GROUP BY fov")),
    "area_quartiles": (lambda s: bins.quartiles(features.objects(s.tiles()), "fov", "area"), _sql("SELECT fov, count(*) AS n, " + ", ".join(f"quantile_cont(area::DOUBLE, {q}) AS {k}" for k, q in (("least", 0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("most", 1))) + " FROM (SELECT fov, label, count(*) AS area FROM tiles GROUP BY ALL) GROUP BY fov")),
    "knn_graph": (lambda s: _rounded(nearest.nearest_neighbors(s.vectors(), "vec_id", "e", 5, 1.3), "distance"),
        "WITH p AS (SELECT a.vec_id, b.vec_id AS neighbor, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2])))) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) SELECT vec_id, neighbor, round(distance, 6) AS distance, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor) AS INTEGER) AS rank FROM p WHERE distance <= 1.3 QUALIFY rank <= 5"),
    "map_sizes": (lambda s: _mapped(s).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), _sql("SELECT cluster, count(*) AS n FROM units GROUP BY cluster", BIN_SQL, MAP_SQL)),
    "map_units": (lambda s: _units(s), _sql(f"SELECT unit, {', '.join(f'round({t}, 6) AS {t}' for t in TYPES)} FROM u{EPOCHS}", BIN_SQL, MAP_SQL)),
    "map_markers": (lambda s: bins.markers(_mapped(s), "cluster", TYPES, 2).select("grp", "target", F.round("score", 4).alias("score")), _sql(MARKER_TAIL, BIN_SQL, MAP_SQL, LONG_SQL)),
    "map_image": (lambda s: bins.cluster_image(_mapped(s), 10).groupBy("fov", "label").agg(F.count(F.lit(1)).alias("area"), F.sum("c").alias("sc")),
        _sql("SELECT fov, CAST(cluster + 1 AS INTEGER) AS label, CAST(count(*) * 100 AS BIGINT) AS area, CAST(sum(10 * (10 * (10 * by_) + 45)) AS BIGINT) AS sc FROM units GROUP BY fov, cluster", BIN_SQL, MAP_SQL)),
    "pca_elbow": (lambda s: s.spark.createDataFrame([(bins.elbow(bins.principal_axes(s.vectors(), "e", 20)[1]),)], "axes int"), None),
    "marker_ttest": (lambda s: bins.markers(bins.bin_counts(s.pts, 10, TYPES), "fov", TYPES, 3).select("grp", "target", F.round("score", 4).alias("score")),
        _sql("SELECT grp, target, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, target) AS rk FROM (SELECT grp, target, (s / n - (ts - s) / (tn - n)) / sqrt((q - s * s / n) / (n - 1) / n + ((tq - q) - (ts - s) * (ts - s) / (tn - n)) / (tn - n - 1) / (tn - n)) AS score FROM (SELECT fov AS grp, target, count(*)::DOUBLE AS n, sum(v)::DOUBLE AS s, sum(v * v)::DOUBLE AS q FROM lng GROUP BY fov, target) JOIN (SELECT target, count(*)::DOUBLE AS tn, sum(v)::DOUBLE AS ts, sum(v * v)::DOUBLE AS tq FROM lng GROUP BY target) USING (target))) WHERE rk <= 3",
             BIN_SQL, "lng AS (UNPIVOT (SELECT fov, click, view, purchase, signup, error FROM bt) ON click, view, purchase, signup, error INTO NAME target VALUE v)")),
    "cluster_image": (lambda s: bins.cluster_image(s.units(), 10).groupBy("fov", "label").agg(F.count(F.lit(1)).alias("area"), F.sum("c").alias("sc")),
        _sql("SELECT fov, CAST(cluster + 1 AS INTEGER) AS label, CAST(count(*) * 100 AS BIGINT) AS area, CAST(sum(10 * (10 * (10 * by_) + 45)) AS BIGINT) AS sc FROM units GROUP BY fov, cluster", BIN_SQL, UNIT_SQL)),
    "class_regions": (lambda s: regions.class_regions(s.pres.select(*PX).distinct(), s.seeds(), s.ext),
        _sql("SELECT o.fov, o.r, o.c, arg_min(class, ((o.c - cx) * (o.c - cx) + (o.r - cy) * (o.r - cy), idx)) AS class FROM occ o JOIN seeds USING (fov) GROUP BY o.fov, o.r, o.c", WIDE, REGIONS, SEEDS, recursive=True)),
    "class_cells": (lambda s: regions.clamped_regions(s.seeds(), s.ext).groupBy("fov", "class").agg(F.count(F.lit(1)).alias("area"), F.sum("r").alias("sr"), F.sum("c").alias("sc")), None),
    "class_limited_rings": (lambda s: expand.class_limited_rings(s.objects(), s.ext, s.seeds(), [3, 5, 2]),
        _sql("SELECT fov, class, ring, r, c, max(parent) AS label, any_value(referenced) AS referenced FROM (SELECT *, coalesce(max(CASE WHEN ring > 0 THEN parent END) OVER w, max(parent) OVER w) AS referenced FROM grown WINDOW w AS (PARTITION BY fov, r, c)) GROUP BY fov, class, ring, r, c", WIDE, REGIONS, SEEDS,
             "own AS (SELECT fov, r, c, label AS parent, CASE WHEN label % 2 = 0 THEN 'A' ELSE 'B' END AS class FROM seed)",
             "many AS (SELECT fov FROM seeds GROUP BY fov HAVING count(*) >= 4)",
             "o5 AS (SELECT y, x FROM (SELECT unnest(range(-5, 6))::INTEGER AS y), (SELECT unnest(range(-5, 6))::INTEGER AS x) WHERE y * y + x * x <= 25)",
             "reach AS (SELECT o.fov, o.class, o.parent, o.r + y AS r, o.c + x AS c, min(y * y + x * x) AS d2 FROM own o JOIN ext USING (fov), o5 WHERE o.r + y BETWEEN 0 AND h - 1 AND o.c + x BETWEEN 0 AND w - 1 GROUP BY ALL HAVING min(y * y + x * x) > 0)",
             "region AS (SELECT n.fov, n.r, n.c, arg_min(s.class, ((n.c - cx) * (n.c - cx) + (n.r - cy) * (n.r - cy), idx)) AS class FROM (SELECT DISTINCT fov, r, c FROM reach SEMI JOIN many USING (fov)) n JOIN seeds s USING (fov) GROUP BY n.fov, n.r, n.c)",
             "grown AS (SELECT r.fov, r.class, r.parent, r.r, r.c, CASE WHEN d2 <= 9 THEN 3 ELSE 5 END AS ring FROM reach r LEFT JOIN region g ON g.fov = r.fov AND g.r = r.r AND g.c = r.c WHERE g.class IS NULL OR g.class = r.class UNION ALL SELECT fov, class, parent, r, c, 0 FROM own)", recursive=True)),
    "class_seeds": (lambda s: _rounded(expand.seeds_of(s.classed(), ["A", "B"]), "cx", "cy"), _sql("SELECT * FROM seeds", WIDE, REGIONS, SEEDS, recursive=True)),
    "contour_area": (lambda s: s.patches().select("fov", "label", contours.ring_area(F.col("ring")).alias("area")), _sql("SELECT DISTINCT fov, lab AS label, CAST(area AS DOUBLE) AS area FROM regions", WIDE, REGIONS, recursive=True)),
    "contour_area_filter": (lambda s: contours.area_at_least(s.patches(), 500).select("fov", "label"), _sql("SELECT DISTINCT fov, lab AS label FROM regions WHERE area >= 500", WIDE, REGIONS, recursive=True)),
    "contour_fill": (lambda s: contours.fill(s.patches(), "fov", "label").groupBy("fov", "label").agg(F.count(F.lit(1)).alias("area"), F.sum("r").alias("sr"), F.sum("c").alias("sc")),
        _sql("SELECT fov, lab AS label, count(*) AS area, CAST(sum(r) AS BIGINT) AS sr, CAST(sum(c) AS BIGINT) AS sc FROM (SELECT DISTINCT fov, lab, r, c FROM regions) GROUP BY fov, lab", WIDE, REGIONS, recursive=True)),
    "seed_centroids": (lambda s: _rounded(contours.seed_centroids(s.patches(), "fov", "label"), "cx", "cy"),
        _sql("SELECT fov, lab AS label, round(cx, 6) AS cx, round(cy, 6) AS cy FROM cent", WIDE, REGIONS, CENTROIDS, recursive=True)),
    "polygon_shift": (lambda s: contours.to_origin(s.patches(), "fov").select("fov", "label", F.col("ring")[0]["x"].alias("x"), F.col("ring")[0]["y"].alias("y")),
        _sql("SELECT DISTINCT fov, lab AS label, CAST(lab % 100000 - x0 AS INTEGER) AS x, CAST(lab // 100000 - y0 AS INTEGER) AS y FROM regions JOIN (SELECT fov, min(c) AS x0, min(r) AS y0 FROM regions GROUP BY fov) USING (fov)", WIDE, REGIONS, recursive=True)),
    "polygon_overlap": (lambda s: features.overlap(segmentation.cell_pixels(s.patches().withColumnRenamed("label", "cell")), s.of("click").withColumn("mask", F.lit("a"))).select("fov", "cell", "mask", "n"),
        _sql("SELECT b.fov, lab AS cell, 'a' AS mask, count(a.r) AS n FROM (SELECT DISTINCT fov, lab, r, c FROM regions) b LEFT JOIN a USING (fov, r, c) GROUP BY b.fov, lab", WIDE, REGIONS, recursive=True)),
    "trace_contours": (lambda s: contours.trace(s.dense()).where(contours.ring_area(F.col("ring")) > 0).select("fov", _first(), "hole", contours.ring_area(F.col("ring")).alias("area")),
        _sql("SELECT fov, first, hole, CAST(area AS DOUBLE) AS area FROM rings WHERE area > 0", CONV, _contours("dense", "(SELECT fov, r, c, 1 AS v FROM grid)"), recursive=True)),
    "contours_from_sum": (lambda s: contours.contours_from_sum(s.chan, s.ext, 10, 4, LEAST_AREA).select("fov", _first(), "hole", contours.ring_area(F.col("ring")).alias("area")),
        _sql(f"SELECT fov, first, hole, CAST(area AS DOUBLE) AS area FROM rings WHERE area >= {LEAST_AREA}", CONV, _contours("dense", "chan"), recursive=True)),
    "contours_filled": (lambda s: s.outlines().select("fov", _first(), contours.ring_area(F.col("ring")).alias("area")), _sql("SELECT DISTINCT fov, lab AS first, CAST(area AS DOUBLE) AS area FROM regions", CONV, REGIONS, recursive=True)),
    "contours_from_neighbors": (lambda s: neighbors.contours_from_neighbors(s.all_points(), s.ext, 5, 6, 1).select("fov", _first(), "hole", contours.ring_area(F.col("ring")).alias("area")),
        _sql("SELECT fov, first, hole, CAST(area AS DOUBLE) AS area FROM rings WHERE area >= 1", PAIRS, "crowd AS (SELECT fov, r, c, arg_max(n, id) AS v FROM cnt GROUP BY fov, r, c)", "crowded AS (SELECT fov, r, c FROM crowd WHERE v > 6)", _contours("crowded", "crowd"), recursive=True)),
    "contour_polygons": (lambda s: contours.polygons(s.patches()).select("fov", "label", contours.ring_area(F.col("ring")).alias("area")), None),
    "inpainted_neighbors": (lambda s: inpaint.inpainted(neighbors.neighbor_raster(s.all_points(), 5), s.ext), None),
    "contours_to_mask": (lambda s: features.bulk(s.regions().select(*PX).distinct()), _sql("SELECT fov, count(*) AS area FROM regions GROUP BY fov", CONV, REGIONS, recursive=True)),
    "gene_threshold_filter": (lambda s: contours.by_target_threshold(s.regions(), s.pres, MARKED, 40).withColumnRenamed("label", "first"),
        _sql("SELECT fov, lab AS first, count(*) AS n FROM regions JOIN pres USING (fov, r, c) WHERE target IN ('click', 'view') GROUP BY ALL HAVING count(*) >= 40", CONV, REGIONS, recursive=True)),
    "gene_comparison_filter": (lambda s: contours.by_target_comparison(s.regions(), s.pres, ["click"], ["view"]).withColumnRenamed("label", "first"),
        _sql("SELECT fov, lab AS first, count(CASE WHEN target = 'click' THEN 1 END) AS n_more, count(CASE WHEN target = 'view' THEN 1 END) AS n_fewer FROM regions JOIN pres USING (fov, r, c) GROUP BY fov, lab HAVING n_more > n_fewer", CONV, REGIONS, recursive=True)),
    "object_perimeter": (lambda s: _rounded(shapes.perimeters(s.tiles()), "perimeter"),
        _sql("SELECT fov, label, round(sum(CASE WHEN code IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN code IN (21, 33) THEN sqrt(2) WHEN code IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END), 6) AS perimeter FROM code GROUP BY fov, label",
             "edge AS (SELECT t.fov, t.label, t.r, t.c FROM tiles t LEFT JOIN tiles n ON n.fov = t.fov AND n.label = t.label AND abs(n.r - t.r) + abs(n.c - t.c) = 1 GROUP BY ALL HAVING count(n.r) < 4)",
             "code AS (SELECT p.fov, p.label, p.r, p.c, sum(CASE WHEN p.r = q.r AND p.c = q.c THEN 1 WHEN p.r = q.r OR p.c = q.c THEN 2 ELSE 10 END) AS code FROM edge p JOIN edge q ON p.fov = q.fov AND p.label = q.label AND abs(p.r - q.r) <= 1 AND abs(p.c - q.c) <= 1 GROUP BY ALL)")),
    "object_solidity": (lambda s: _rounded(shapes.solidities(s.tiles()), "solidity"), None),
    "area_normalise": (lambda s: bins.area_normalised(features.counts(s.tiles(), s.pres, TYPES, ["fov", "label"]).join(features.objects(s.tiles()).select("fov", "label", "area"), ["fov", "label"]), "area", TYPES).select("fov", "label", *(F.round(t, 6).alias(t) for t in TYPES)),
        _sql("SELECT fov, label, " + ", ".join(f"round(ln(1 + {t} * 10000.0 / (click + view + purchase + signup + error)), 6) AS {t}" for t in TYPES) + f" FROM (SELECT fov, label, {COUNTS} FROM tiles LEFT JOIN pres USING (fov, r, c) GROUP BY fov, label)")),
    "marker_wilcoxon": (lambda s: bins.rank_sums(s.binned(), "fov", TYPES).select("grp", "target", F.round("score", 4).alias("score")),
        _sql("SELECT fov AS grp, target, round((sum(mid) - count(*) * (total + 1) / 2) / sqrt(count(*) * (total - count(*)) * (total + 1.0) / 12), 4) AS score FROM mids GROUP BY fov, target, total",
             BIN_SQL, "lng AS (UNPIVOT (SELECT fov, click, view, purchase, signup, error FROM bt) ON click, view, purchase, signup, error INTO NAME target VALUE v)",
             "mids AS (SELECT fov, target, rank() OVER (PARTITION BY target ORDER BY v) + (count(*) OVER (PARTITION BY target, v) - 1) / 2.0 AS mid, count(*) OVER (PARTITION BY target) AS total FROM lng)")),
    "som_train": (lambda s: _som(s.vectors()), None),
    "pca_projection": (lambda s: bins.projected(s.vectors(), "e", bins.principal_axes(s.vectors(), "e", 3)[0]).select("vec_id", *(F.round(F.col("pc")[i], 6).alias(f"pc{i + 1}") for i in range(3))), None),
    "mask_files": (lambda s: sinks.mask_files(s.of("click"), s.ext).select("fov", F.octet_length("data").alias("n_bytes"), F.md5(F.expr("substring(data, 129)")).alias("pixels")),
        _sql("SELECT fov, CAST(128 + count(*) AS INTEGER) AS n_bytes, md5(from_hex(string_agg(CASE WHEN a.r IS NULL THEN '00' ELSE '01' END, '' ORDER BY g.r, g.c))) AS pixels FROM grid g LEFT JOIN a USING (fov, r, c) GROUP BY fov")),
}


def _query(make):
    return lambda spark, sf_dir: make(Scene(spark, sf_dir))


def queries() -> dict:
    return {name: _query(make) for name, (make, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOG.items() if sql}
