"""Square bins of points: counts by target, normalisation, unit assignment and marker statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from densigrid.functions.statistics import t_two_sided
from densigrid.sources.stage import staged


def bin_counts(points: DataFrame, size: int, targets: list[str], order: str | None = None) -> DataFrame:
    """(fov, bx, by, one column a target, total, places): bins whose points have other targets only stay, with zeros.

    x_centroid and y_centroid are the mean places times ``size``, and x_coord and y_coord, if the points have a column of row ids named by ``order``, the
    first point's; x_mean and y_mean are the means themselves.
    """
    keyed = points.withColumn("bx", F.floor(F.col("r") / size).cast("long")).withColumn("by", F.floor(F.col("c") / size).cast("long"))
    each = [F.count(F.when(F.col("target") == t, 1)).alias(t) for t in targets]
    first = [(F.min_by(x, order) * size).alias(name) for x, name in (("r", "x_coord"), ("c", "y_coord"))] if order else []
    out = keyed.groupBy("fov", "bx", "by").agg(*each, F.avg("r").alias("x_mean"), F.avg("c").alias("y_mean"), *first)
    return out.withColumns({"total": sum((F.col(t) for t in targets), F.lit(0)), "x_centroid": F.col("x_mean") * size, "y_centroid": F.col("y_mean") * size})


def cohort(samples: dict[str, DataFrame], name: str, targets: list[str]) -> DataFrame:
    """Bins of several tables as one, tagged with name and cohort; targets that a sample lacks are 0 in its bins. A scan a sample: see grouped_cohort() for one table."""
    tagged = [rows.withColumns({"name": F.lit(k), "cohort": F.lit(name)}) for k, rows in samples.items()]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return out.na.fill(0, [t for t in targets if t in out.columns])


def grouped_cohort(bins: DataFrame, samples: dict[str, list[str]], name: str, targets: list[str], sample: str = "fov") -> DataFrame:
    """Bins of several samples as one table, tagged with name and cohort: of each sample those targets count that it has, others are 0 in its bins.

    ``bins`` holds the bins of all samples, told apart by the column ``sample`` and counted in one go; those of other samples are left out.
    """
    own = lambda t: F.col(sample).isin(*(k for k, held in samples.items() if t in held))
    kept = bins.where(F.col(sample).isin(*samples))
    return kept.withColumns({**{t: F.when(own(t), F.col(t)).otherwise(F.lit(0)) for t in targets}, "name": F.col(sample), "cohort": F.lit(name)})


def cluster_image(clustered: DataFrame, size: int) -> DataFrame:
    """(fov, r, c, label): the pixels of bins (fov, bx, by, cluster), labelled with the cluster + 1; 0 is background and has no rows."""
    side = lambda at: F.explode(F.sequence((F.col(at) * size).cast("int"), (F.col(at) * size + size - 1).cast("int")))
    rows = clustered.select("fov", side("bx").alias("r"), "by", (F.col("cluster") + 1).cast("int").alias("label"))
    return rows.select("fov", "r", side("by").alias("c"), "label")


def cluster_extent(clustered: DataFrame, size: int) -> DataFrame:
    """(fov, h, w) of the cluster image: up to the last bin of each axis."""
    return clustered.groupBy("fov").agg(((F.max("bx") + 1) * size).cast("int").alias("h"), ((F.max("by") + 1) * size).cast("int").alias("w"))


def normalised(bins: DataFrame, targets: list[str], least: int) -> DataFrame:
    """Bins of ``least`` points or more, each target as ln(1 + count * median total / total); the median is over all bins kept."""
    kept = bins.where(F.col("total") >= least)
    middle = kept.agg(F.median("total").alias("middle"))
    rows = kept.join(F.broadcast(middle))  # a single row
    return rows.select("fov", "bx", "by", "total", *(F.log1p(F.col(t) * F.col("middle") / F.col("total")).alias(t) for t in targets), sum((F.when(F.col(t) > 0, 1).otherwise(0) for t in targets), F.lit(0)).alias("n_targets"))


def assigned(rows: DataFrame, vector: str, units: list[list[float]]) -> DataFrame:
    """``rows`` with the nearest unit of a codebook (a small list), ties to the first."""
    far = lambda u: F.aggregate(F.zip_with(vector, F.array(*(F.lit(float(x)) for x in u)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.array(*(F.struct(far(u).alias("d2"), F.lit(i).alias("unit")) for i, u in enumerate(units))))
    return rows.withColumn("unit", best["unit"])


def _long(rows: DataFrame, group: str, targets: list[str]) -> DataFrame:
    pairs = F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("v")) for t in targets)))
    return rows.select(F.col(group).alias("grp"), pairs.alias("p")).select("grp", "p.target", "p.v")


def markers(rows: DataFrame, group: str, targets: list[str], top: int) -> DataFrame:
    """(grp, target, score, logfoldchange, pval, pval_adj, rank): Welch's t of every target in each group against the rest, the ``top`` of largest score a group.

    Rows hold one column a target, of values ln(1 + x). pval is two-sided, pval_adj by Benjamini and Hochberg over a group's targets; both are worked out on
    one row a group and target.
    """
    long = _long(rows, group, targets)
    own = long.groupBy("grp", "target").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    whole = long.groupBy("target").agg(F.count(F.lit(1)).alias("tn"), F.sum("v").alias("ts"), F.sum(F.col("v") * F.col("v")).alias("tq"))
    j = own.join(whole, "target")
    var = lambda n, s, q: (q - s * s / n) / (n - 1)
    rn, rs, rq = F.col("tn") - F.col("n"), F.col("ts") - F.col("s"), F.col("tq") - F.col("q")
    j = j.where((F.col("n") > 1) & (rn > 1)).select(
        "grp", "target", (F.col("s") / F.col("n")).alias("m"), (rs / rn).alias("rm"), "n", rn.alias("rn"),
        (var(F.col("n"), F.col("s"), F.col("q")) / F.col("n")).alias("a"), (var(rn, rs, rq) / rn).alias("b"))
    a, b, near = F.col("a"), F.col("b"), F.lit(1e-9)
    free = (a + b) * (a + b) / (a * a / (F.col("n") - 1) + b * b / (F.col("rn") - 1))
    change = F.log2((F.expm1("m") + near) / (F.expm1("rm") + near))
    scored = j.select("grp", "target", ((F.col("m") - F.col("rm")) / F.sqrt(a + b)).alias("score"), change.alias("logfoldchange"), free.alias("df")).where(F.col("score").isNotNull())
    tail = F.pandas_udf(t_two_sided, "double")
    scored = scored.select("grp", "target", "score", "logfoldchange", tail("score", "df").alias("pval"))
    by_p = Window.partitionBy("grp").orderBy("pval", "target")
    stepped = scored.withColumn("_k", F.row_number().over(by_p)).withColumn("_q", F.col("pval") * F.count(F.lit(1)).over(Window.partitionBy("grp")) / F.col("_k"))
    least = F.min("_q").over(Window.partitionBy("grp").orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0))
    ranked = stepped.withColumn("pval_adj", F.least(least, F.lit(1.0))).withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), "target")))
    return ranked.drop("_k", "_q").where(F.col("rank") <= top)


def mid_ranks(counts: DataFrame) -> DataFrame:
    """(target, v, mid): the mid-rank of each value among its target's, of (target, v, same), how often each occurs.

    Values are dealt by ranges of (target, v), so a target lies on as many tasks as it needs. Each range starts from what the ranges before it hold of the target, one
    number a range; within a range counts run on.
    """
    ranged = staged(counts.repartitionByRange("target", "v").withColumn("part", F.spark_partition_id()))
    held = ranged.groupBy("target", "part").agg(F.sum("same").alias("n"))
    lists = held.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("parts"))  # one entry a range
    before = F.aggregate(F.filter("parts", lambda p: p["part"] < F.col("part")), F.lit(0).cast("long"), lambda s, p: s + p["n"])
    carried = held.join(lists, "target").select("target", "part", before.alias("before"))
    own = Window.partitionBy("target", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("same").over(own)
    return ranged.join(carried, ["target", "part"]).select("target", "v", (upto - (F.col("same") - 1) / 2).alias("mid"))


def rank_sums(rows: DataFrame, group: str, targets: list[str]) -> DataFrame:
    """(grp, target, score): z of the rank sum of each group against the rest, mid-ranks for ties, no tie correction; rows hold one column a target.

    Ranks come from counts of equal values, which are sorted by ranges: no task holds a target.
    """
    own = _long(rows, group, targets).groupBy("grp", "target", "v").agg(F.count(F.lit(1)).alias("n"))
    ranked = mid_ranks(own.groupBy("target", "v").agg(F.sum("n").alias("same")))
    sums = own.join(ranked, ["target", "v"]).groupBy("grp", "target").agg(F.sum("n").alias("n1"), F.sum(F.col("n") * F.col("mid")).alias("ranks"))
    met = sums.join(own.groupBy("target").agg(F.sum("n").alias("total")), "target").where(F.col("n1") < F.col("total"))
    n1, n = F.col("n1").cast("double"), F.col("total").cast("double")
    return met.select("grp", "target", ((F.col("ranks") - n1 * (n + 1) / 2) / F.sqrt(n1 * (n - n1) * (n + 1) / 12)).alias("score"))


def area_normalised(rows: DataFrame, area: str, targets: list[str], total: float = 1e4) -> DataFrame:
    """Counts for each 100 pixels (0 where there is no area), scaled so that each row sums to ``total``, then ln(1 + x)."""
    share = {t: F.when(F.col(area) > 0, F.col(t) / F.col(area) * 100).otherwise(0.0) for t in targets}
    out = rows.withColumns(share)
    whole = sum((F.col(t) for t in targets), F.lit(0.0))
    return out.withColumns({t: F.log1p(F.when(whole > 0, F.col(t) * total / whole).otherwise(0.0)) for t in targets})


def som_units(rows: DataFrame, key: str, vector: str, shape: tuple[int, int] = (2, 1), steps: int = 5000, sigma: float = 0.5, rate: float = 0.5, seed: int = 42) -> list[list[float]]:
    """Codebook of a self-organising map, trained online on ``steps`` rows drawn from the whole table.

    The rows of least hashed key are a draw without repeats, and training takes one a step, so what the driver gathers is what training uses, whatever the
    table's size. A table of fewer rows than steps is drawn from with repeats. The draw depends on keys alone, not on partitions. Unit i stands at row
    i // columns, column i % columns. An empty table gives no units.
    """
    import numpy as np

    n = shape[0] * shape[1]
    held = rows.where(F.col(vector).isNotNull()).select(F.xxhash64(key).alias("h"), key, vector).orderBy("h", key).limit(steps + n).collect()
    if not held:
        return []
    data = np.array([r[vector] for r in held], dtype=float)
    rng = np.random.default_rng(seed)
    units = data[rng.integers(0, len(data), n)].copy()
    place = np.array([(i, j) for i in range(shape[0]) for j in range(shape[1])], dtype=float)
    for step, pick in enumerate(range(steps) if len(data) >= steps else rng.integers(0, len(data), steps)):
        slow = 1 + 2 * step / steps
        won = np.argmin(((units - data[pick]) ** 2).sum(axis=1))
        pull = rate / slow * np.exp(-((place - place[won]) ** 2).sum(axis=1) / (2 * (sigma / slow) ** 2))
        units += pull[:, None] * (data[pick] - units)
    return units.tolist()


def principal_axes(rows: DataFrame, vector: str, k: int) -> tuple[list[list[float]], list[float]]:
    """The first ``k`` principal axes (largest entry positive) and their shares of the variance. Only the d x d moments reach the driver."""
    import numpy as np
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(rows.select(array_to_vector(F.col(vector)).alias("_v")))
    axes = model.pc.toArray().T
    signs = np.sign(axes[np.arange(k), np.abs(axes).argmax(axis=1)])
    return (axes * signs[:, None]).tolist(), model.explainedVariance.toArray().tolist()


def projected(rows: DataFrame, vector: str, axes: list[list[float]]) -> DataFrame:
    """``rows`` with the array pc: the vector on each axis."""
    on = lambda a: F.aggregate(F.zip_with(vector, F.array(*(F.lit(float(x)) for x in a)), lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn("pc", F.array(*(on(a) for a in axes)))


def elbow(shares: list[float]) -> int:
    """How many axes to keep, from their shares of the variance: the first beyond 90 percent that adds under 5, or the last after a fall of over 0.1, whichever is less."""
    whole = sum(shares)
    pct = [100 * x / whole for x in shares] if whole else []
    upto = [sum(pct[: i + 1]) for i in range(len(pct))]
    beyond = next((i for i, (c, p) in enumerate(zip(upto, pct)) if c > 90 and p < 5), len(pct))
    fall = max((i + 1 for i in range(len(pct) - 1) if pct[i] - pct[i + 1] > 0.1), default=len(pct))
    return min(beyond + 1, fall + 1, len(pct))


def scaled(rows: DataFrame, targets: list[str], most: float | None = None) -> DataFrame:
    """Each target less its mean, over its sample deviation (1 where that is 0 or unknown), cut at ``most`` on either side if given."""
    stats = rows.agg(*(F.struct(F.avg(t).alias("m"), F.stddev_samp(t).alias("s")).alias(f"_{t}") for t in targets))
    unit = lambda t: F.when(F.col(f"_{t}.s") > 0, F.col(f"_{t}.s")).otherwise(1.0)
    out = rows.join(F.broadcast(stats))  # a single row
    z = {t: (F.col(t) - F.col(f"_{t}.m")) / unit(t) for t in targets}
    if most is not None:
        z = {t: F.greatest(F.least(v, F.lit(float(most))), F.lit(-float(most))) for t, v in z.items()}
    return out.withColumns(z).drop(*(f"_{t}" for t in targets))


def nearest_bins(rows: DataFrame, key: str, vector: str, k: int, within: float, width: float, tables: int = 4, seed: int = 42) -> DataFrame:
    """(key, neighbor, distance, rank): the k nearest rows to each row no farther than ``within``, among those that share one of the projection buckets of that width.

    Rows are joined by bucket; neighbours that no table brings into the row's bucket are missed, the fewer the wider the buckets and the more the tables.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    own = rows.select(F.col(key).alias("key"), array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=width, numHashTables=tables, seed=seed).fit(own)
    met = model.approxSimilarityJoin(own, own, within, "distance").where(F.col("datasetA.key") != F.col("datasetB.key"))
    pairs = met.select(F.col("datasetA.key").alias(key), F.col("datasetB.key").alias("neighbor"), "distance")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("distance", "neighbor"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def quartiles(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, least, q1, median, q3, most): exact, values between two rows interpolated."""
    found = rows.groupBy(group).agg(F.count(value).alias("n"), F.percentile(value, [0.0, 0.25, 0.5, 0.75, 1.0]).alias("_q"))
    return found.select(group, "n", *(F.col("_q")[i].alias(name) for i, name in enumerate(("least", "q1", "median", "q3", "most"))))


def som_batch(rows: DataFrame, vector: str, shape: tuple[int, int] = (2, 1), epochs: int = 10, sigma: float = 0.5) -> list[list[float]]:
    """Codebook of a self-organising map, trained in batches on all rows: each epoch is one aggregate, of the sums and the number of the rows nearest to each unit.

    Units start on the line through the means that goes a standard deviation up in every component, one deviation apart. After an epoch unit j is the mean of all rows,
    each weighted by exp(-d^2 / (2 s^2)) for the distance d on the map between j and the row's nearest unit; s falls from ``sigma`` to a third of it. The driver holds the
    units and their sums. Rows without a vector are left out; an empty table gives no units. Write ``rows`` before if they are costly: every epoch reads them.
    """
    import math

    held = rows.where(F.col(vector).isNotNull())
    first = held.select(F.size(vector).alias("n")).first()
    if first is None:
        return []
    width, n = first["n"], shape[0] * shape[1]
    at = [F.get(vector, F.lit(i)).cast("double") for i in range(width)]
    start = held.agg(*(F.avg(x) for x in at), *(F.stddev_pop(x) for x in at)).first()
    units = [[start[i] + (j - (n - 1) / 2) * start[width + i] for i in range(width)] for j in range(n)]
    place = [divmod(j, shape[1]) for j in range(n)]
    for epoch in range(epochs):
        wide = sigma / (1 + 2 * epoch / epochs)
        won = assigned(held.select(vector), vector, units).groupBy("unit").agg(F.count(F.lit(1)).alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(at))).collect()
        moved = []
        for j in range(n):
            pull = {w["unit"]: math.exp(-((place[j][0] - place[w["unit"]][0]) ** 2 + (place[j][1] - place[w["unit"]][1]) ** 2) / (2 * wide * wide)) for w in won}
            weight = sum(pull[w["unit"]] * w["n"] for w in won)
            moved.append([sum(pull[w["unit"]] * w[f"s{i}"] for w in won) / weight for i in range(width)] if weight > 0 else units[j])
        units = moved
    return units
