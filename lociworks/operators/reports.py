"""Summaries that are reported: labelings compared, spectra, sweeps, manifests and catalogues."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .compare import agreement
from .ranks import quantiles

#: Terms of the expected information that are worked out at a time, and how many deviations from the mean they go.
TERMS, REACH = 1 << 20, 40.0


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for values of 1 or more: Stirling's series eight places further on."""
    y = x + 8.0
    r = 1 / (y * y)
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y
    return series - sum(np.log(x + k) for k in range(8))


def expected_term(a: int, b: int, n: int) -> float:
    """What clusters of a and b of n rows share by chance, in nats: the mean over hypergeometric overlaps.

    Overlaps further than REACH deviations from the mean have no weight that a double can hold beside 1.
    """
    mean, deviation = a * b / n, np.sqrt(max(a * b * (n - a) * (n - b), 0) / n / n / max(n - 1, 1))
    lo = max(1, a + b - n, int(mean - REACH * deviation) - 1)
    hi = min(a, b, int(mean + REACH * deviation) + 2)
    fixed = sum(log_gamma(np.array([float(v + 1)]))[0] for v in (a, b, n - a, n - b)) - log_gamma(np.array([n + 1.0]))[0]
    total = 0.0
    for at in range(lo, hi + 1, TERMS):
        m = np.arange(at, min(hi + 1, at + TERMS), dtype=np.float64)
        weight = np.exp(fixed - log_gamma(m + 1) - log_gamma(a - m + 1) - log_gamma(b - m + 1) - log_gamma(n - a - b + m + 1))
        total += float((m / n * (np.log(m) + np.log(n) - np.log(a) - np.log(b)) * weight).sum())
    return total


def adjusted_information(table: DataFrame) -> DataFrame:
    """One row (ami, expected) over a contingency table (a, b, n): information less that of chance. One task a label of a, labels of b broadcast."""
    of_b = [r["n"] for r in table.groupBy("b").agg(F.sum("n").alias("n")).select("n").collect()]  # one number a label
    sent, total = table.sparkSession.sparkContext.broadcast(of_b), sum(of_b)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([sum(expected_term(a, b, total) for b in sent.value) for a in batch.column(0).to_pylist()], pa.float64())],
                ["e"],
            )

    expected = table.groupBy("a").agg(F.sum("n").alias("n")).select("n").mapInArrow(run, "e double").agg(F.sum("e").alias("expected"))
    one = agreement(table).select("mi", "h_a", "h_b").join(expected, how="cross")  # one row each
    top = (F.col("h_a") + F.col("h_b")) / 2
    return one.select(
        F.when(F.abs(top - F.col("expected")) < 1e-15, 1.0).otherwise((F.col("mi") - F.col("expected")) / (top - F.col("expected"))).alias("ami"),
        "expected",
    )


def labeling_record(table: DataFrame) -> DataFrame:
    """One row over a contingency table (a, b, n): agreement with noise as a label and without, and how noise is shared."""
    a, b, n = F.col("a") >= 0, F.col("b") >= 0, F.col("n")
    when = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    clusters = lambda c: F.count_distinct(F.when(F.col(c) >= 0, F.col(c)))
    counts = table.agg(
        F.sum("n").alias("rows"), clusters("a").alias("clusters_a"), clusters("b").alias("clusters_b"), (when(a & b) / F.sum("n")).alias("both_clustered"),
        when(~a & ~b).alias("noise_both"), when(~a & b).alias("noise_a_only"), when(a & ~b).alias("noise_b_only"),
    )
    kept = ("ari", "nmi", "vi", "purity")
    whole, inner = agreement(table).select(*kept), agreement(table.where(a & b)).select(*[F.col(c).alias(f"{c}_clustered") for c in kept])
    return counts.join(whole, how="cross").join(inner, how="cross")  # one row each


def concentration_summary(top: DataFrame) -> DataFrame:
    """One row over spectra.top_channel(): how concentrated spectra are, and which channels dominate them."""
    x = F.col("share")
    one = top.agg(
        F.count("*").alias("clusters"),
        F.avg(x).alias("mean"),
        F.count_distinct("top_channel").alias("dominants"),
        F.avg((x > 0.5).cast("double")).alias("over_50"),
        F.avg((x > 0.8).cast("double")).alias("over_80"),
    )
    by = top.groupBy("top_channel").agg(F.count("*").alias("n"))
    three = by.orderBy(F.desc("n"), "top_channel").limit(3)
    listed = three.agg(F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "top_channel"))),
            lambda s: F.concat(s["top_channel"], F.lit(":"), (-s["m"]).cast("string")),
        ),
        ",",
    ).alias("top_three"))
    median = quantiles(top, [], "share", {"median": 0.5}).drop("n")
    return one.join(median, how="cross").join(listed, how="cross").withColumn("clusters_per_dominant", F.col("clusters") / F.col("dominants"))  # one row each


def pairwise_means(pairs: DataFrame) -> DataFrame:
    """One row over spectra.pairwise()."""
    return pairs.agg(F.count("*").alias("pairs"), *[F.avg(c).alias(f"mean_{c}") for c in ("cosine", "l1", "l2")])


def reconstruction_error(df: DataFrame, features: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(feature, n, mse) of each feature's (value, reconstruction), null and NaN values masked, and "pooled" over all."""
    sums = []
    for name, (x, y) in features.items():
        ok = x.isNotNull() & ~F.isnan(x)
        sums += [F.count_if(ok).alias(f"n_{name}"), F.coalesce(F.sum(F.when(ok, (x - y) * (x - y))), F.lit(0.0)).alias(f"s_{name}")]
    one = df.agg(*sums)
    each = one.select(F.explode(F.array(*[F.struct(
        F.lit(f).alias("feature"),
        F.col(f"n_{f}").alias("n"),
        F.col(f"s_{f}").alias("s"),
    ) for f in features])).alias("r")).select("r.*")
    pooled = each.agg(F.lit("pooled").alias("feature"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    return each.unionByName(pooled).select("feature", "n", (F.col("s") / F.greatest(F.col("n"), F.lit(1))).alias("mse"))


def collapsed(activation: DataFrame, divergence: str, variance: str, least_divergence: float, least_variance: float) -> DataFrame:
    """activation with collapsed: a dimension whose divergence or variance is below its least."""
    return activation.withColumn("collapsed", (F.col(divergence) < least_divergence) | (F.col(variance) < least_variance))


def power_law(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, n, exponent, factor, r2) of y = factor * x ** exponent, by least squares of logarithms of positive values."""
    ok = df.where((F.col(x) > 0) & (F.col(y) > 0)).withColumns({"_x": F.ln(x), "_y": F.ln(y)})
    return ok.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.regr_slope("_y", "_x").alias("exponent"),
        F.exp(F.regr_intercept("_y", "_x")).alias("factor"),
        F.regr_r2("_y", "_x").alias("r2"),
    )


def log_interpolate(df: DataFrame, x: str, y: str, at: Column, by: list[str]) -> DataFrame:
    """(by, value): y at a place between the two nearest known points, on logarithmic scales."""
    near = df.withColumn("_at", at).groupBy(*by).agg(
        F.max_by(
            F.struct(x, y),
            F.when(F.col(x) <= F.col("_at"), F.col(x)),
        ).alias("lo"), F.min_by(F.struct(x, y), F.when(F.col(x) >= F.col("_at"), F.col(x))).alias("hi"), F.first("_at").alias("_at")
    )
    share = (F.ln("_at") - F.ln(f"lo.{x}")) / F.nullif(F.ln(f"hi.{x}") - F.ln(f"lo.{x}"), F.lit(0.0))
    return near.select(*by, F.exp(F.ln(f"lo.{y}") + F.coalesce(share, F.lit(0.0)) * (F.ln(f"hi.{y}") - F.ln(f"lo.{y}"))).alias("value"))


def config_label(parts: list[tuple[str, Column, object]]) -> Column:
    """Short names and values of a configuration, those at their default left out. parts: name, value, default or None to always show."""
    shown = [F.when(F.lit(default is None) | ~value.eqNullSafe(F.lit(default)), F.concat(F.lit(name), value.cast("string"))) for name, value, default in parts]
    return F.concat_ws("_", *shown)


def ranking(cells: DataFrame, order: list[Column]) -> DataFrame:
    """cells with their place in a report's order. A sweep's cells are few; they are ranked together."""
    return cells.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def best_cell(cells: DataFrame, score: str, failed: Column, ties: list[str]) -> DataFrame:
    """The cell of the highest score that didn't fail; none if all did."""
    return cells.where(~F.coalesce(failed, F.lit(False)) & F.col(score).isNotNull() & ~F.isnan(score)).orderBy(F.desc(score), *ties).limit(1)


def reproducibility(df: DataFrame, cell: str, replicate: str, key: str, label: str) -> DataFrame:
    """(cell, pairs, same): over pairs of replicates of a cell, the mean share of keys with the same label."""
    a, b = (df.select(cell, F.col(key).alias("_k"), F.col(replicate).alias(f"_r{s}"), F.col(label).alias(f"_l{s}")) for s in "ab")
    met = a.join(b, [cell, "_k"]).where("_ra < _rb").groupBy(cell, "_ra", "_rb").agg(F.avg((F.col("_la") == F.col("_lb")).cast("double")).alias("s"))
    return met.groupBy(cell).agg(F.count("*").alias("pairs"), F.avg("s").alias("same"))


def model_check(cells: DataFrame, held: DataFrame, reproduced: DataFrame, cell: str, key: str, label: str) -> DataFrame:
    """(cell, n_held, n_wrong, status): INCOMPLETE without metrics, INCONSISTENT if a held row isn't reproduced, else OK."""
    met = held.join(reproduced.select(cell, key, F.col(label).alias("_again")), [cell, key], "left")
    wrong = met.groupBy(cell).agg(F.count("*").alias("n_held"), F.count_if(~F.col(label).eqNullSafe(F.col("_again"))).alias("n_wrong"))
    status = F.when(~F.col("has_metrics"), "INCOMPLETE").when(F.coalesce("n_wrong", F.lit(0)) > 0, "INCONSISTENT").otherwise("OK")
    return cells.join(wrong, cell, "left").select(
        cell,
        F.coalesce("n_held", F.lit(0)).alias("n_held"),
        F.coalesce("n_wrong", F.lit(0)).alias("n_wrong"),
        status.alias("status"),
    )


def manifest_totals(manifest: DataFrame) -> DataFrame:
    """(status, files, rows, noise): one row for each status."""
    return manifest.groupBy("status").agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("noise").alias("noise"))


def silhouette(sample: DataFrame, vector: str, label: str) -> DataFrame:
    """One row (n, silhouette): exact over a bounded sample, which is broadcast; a label of one row counts 0, noise is a label."""
    got = sample.select(F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("long").alias("k")).toArrow()
    if not got.num_rows:
        raise ValueError("the sample is empty")
    points = np.array(got.column("v").to_pylist(), dtype=np.float64)
    kinds, at = np.unique(got.column("k").to_numpy(), return_inverse=True)
    sent = sample.sparkSession.sparkContext.broadcast((points, at, np.bincount(at)))
    places = sample.sparkSession.range(len(points))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, own, sizes = sent.value
        for batch in batches:
            for i in np.array_split(batch.column(0).to_numpy(), max(1, batch.num_rows // 64)):
                d = np.sqrt(((p[i][:, None] - p[None]) ** 2).sum(2))
                sums = np.stack([np.bincount(own, weights=row, minlength=len(sizes)) for row in d]) if len(i) else np.zeros((0, len(sizes)))
                mine = own[i]
                rows = np.arange(len(i))
                inner = sums[rows, mine] / np.maximum(sizes[mine] - 1, 1)
                means = sums / sizes
                means[rows, mine] = np.inf
                outer = means.min(1, initial=np.inf)
                s = np.where((sizes[mine] > 1) & np.isfinite(outer), (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-300), 0.0)
                yield pa.RecordBatch.from_arrays([pa.array(s)], ["s"])

    return places.mapInArrow(run, "s double").agg(F.count("*").alias("n"), F.avg("s").alias("silhouette"))
