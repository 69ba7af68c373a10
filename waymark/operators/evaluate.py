"""Reports on answers: errors, calibration, parity, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import game_score
from waymark.operators.ranks import medians, ranked
from waymark.scratch import written

#: Bounds of the calibration bins and of the three bands, fixed values.
BINS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.01]
BANDS = [("high", 0.75, 1.01), ("medium", 0.45, 0.75), ("low", 0.0, 0.45)]


def share(condition: Column) -> Column:
    """Of the rows, in percent."""
    return F.avg(condition.cast("double")) * 100


def with_medians(groups: DataFrame, rows: DataFrame, keys: list[str], value: str, into: str) -> DataFrame:
    """groups with the median of each, null where there is no value."""
    found = medians(rows, keys, value, into)
    if keys:
        return groups.join(found, keys, "left")
    return groups.withColumn("k", F.lit(1)).join(found.withColumn("k", F.lit(1)), "k", "left").drop("k")


def error_report(errors: DataFrame) -> DataFrame:
    """One row on km: count, median, mean, shares within 1, 25 and 200, game score."""
    km = F.col("km")
    errors = written(errors.select("km"), "errors")
    one = errors.agg(F.count("*").alias("n"), F.avg(km).alias("mean_km"), share(km <= 1).alias("at1"), share(km <= 25).alias("at25"), share(km <= 200).alias("at200"), F.avg(game_score(km)).alias("score"))
    return with_medians(one, errors, [], "km", "median_km")


def brier_auc(rows: DataFrame) -> DataFrame:
    """One row on (p, y): the Brier score, that of the base rate, and the share of
    pairs of a hit and a miss in which the hit has the strictly larger p.

    The pairs are counted by ranks: p is counted up first, so the misses below
    each distinct p are a running sum, which runs by ranges of p: many answers
    near 0 or 1 are several ranges. Rows without a p are in no pair."""
    y = F.col("y").cast("double")
    base = rows.agg(F.avg(y).alias("rate"), F.count("*").alias("n"), F.sum(y).alias("hits"), F.avg(F.pow(F.col("p") - y, 2.0)).alias("brier"))
    by_p = rows.where("p is not null").groupBy("p").agg(F.sum(y).alias("hits_here"), F.sum(1 - y).alias("misses_here"))
    won = ranked(by_p, [], [F.asc("p")], "misses_here", "below").agg(F.sum(F.col("hits_here") * F.col("below")).alias("won"))
    one = base.withColumn("k", F.lit(1)).join(won.withColumn("k", F.lit(1)), "k")
    return one.select("n", "brier", (F.col("rate") * (1 - F.col("rate"))).alias("base_brier"), F.try_divide("won", F.col("hits") * (F.col("n") - F.col("hits"))).alias("auc"))


def calibration(rows: DataFrame, least: int = 20) -> DataFrame:
    """(low, n, actual, median_km) of (p, y, km): half-open bins of at least so many rows."""
    low = None
    for a, b in zip(BINS, BINS[1:]):
        here = (F.col("p") >= a) & (F.col("p") < b)
        low = F.when(here, a) if low is None else low.when(here, a)
    binned = rows.withColumn("low", low).where("low is not null")
    found = binned.groupBy("low").agg(F.count("*").alias("n"), share(F.col("y") == 1).alias("actual")).where(F.col("n") >= least)
    return with_medians(found, binned, ["low"], "km", "median_km").select("low", "n", "actual", "median_km")


def bands(rows: DataFrame) -> DataFrame:
    """(band, n, median_km, at25, beyond1000) of (p, km)."""
    band = None
    for name, a, b in BANDS:
        here = (F.col("p") >= a) & (F.col("p") < b)
        band = F.when(here, name) if band is None else band.when(here, name)
    return _errors_by(rows.withColumn("band", band).where("band is not null"), "band")


def _errors_by(rows: DataFrame, key: str) -> DataFrame:
    km = F.col("km")
    found = rows.groupBy(key).agg(F.count("*").alias("n"), share(km <= 25).alias("at25"), share(km > 1000).alias("beyond1000"))
    return with_medians(found, rows, [key], "km", "median_km").select(key, "n", "median_km", "at25", "beyond1000")


def tiers(rows: DataFrame, signal: str, high_is_good: bool = True) -> DataFrame:
    """(tier, n, median_km, at25, beyond1000) of (qid, <signal>, km): the best
    quarter by the signal, the middle half, the worst quarter. The cuts are at n
    div 4 and 3 n div 4; of equal signals the lower qid comes first."""
    n = rows.count()
    order = [F.desc(signal) if high_is_good else F.asc(signal), F.asc("qid")]
    placed = ranked(rows.select("qid", signal, "km"), [], order, into="i")
    tier = F.when(F.col("i") < n // 4, "best").when(F.col("i") < 3 * n // 4, "mid").otherwise("worst")
    return _errors_by(placed.withColumn("tier", tier), "tier")


def parity(desktop: DataFrame, device: DataFrame) -> DataFrame:
    """One row: how far two runs (file, lat, lon, top_row; device also ms) agree on
    the files that both have."""
    from waymark.functions.geo import haversine_km

    b = device.select("file", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("top_row").alias("top2"), "ms")
    rows = desktop.join(b, "file", "left").withColumn("gap", haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")))
    one = rows.agg(F.count("*").alias("n_files"), F.count("gap").alias("n_both"), F.sum((F.col("top_row") == F.col("top2")).cast("long")).alias("same"), F.max("gap").alias("max_gap"), F.avg("gap").alias("mean_gap"))
    one = with_medians(one, rows, [], "ms", "median_ms")
    verdict = F.when(F.col("same") == F.col("n_both"), "same").when(F.col("max_gap") < 1.0, "near").otherwise("mismatch")
    return one.withColumn("verdict", verdict)


def latency(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, median, least) of each group: the element in the middle of the sorted
    values, the upper one of two, and the smallest."""
    found = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias("least"))
    return found.join(medians(rows, [key], value, upper=True), key, "left").select(key, "n", "median", "least")
