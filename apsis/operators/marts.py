"""Daily tables over the position archive. Each is one partial aggregation and one shuffle on its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from . import tracks

#: Length of the chunks into which a satellite's track is cut.
CHUNK_SECONDS = 86_400


def one_day(archive: DataFrame, day: str) -> DataFrame:
    """One day by partition pruning; the date column stays."""
    return archive.where(F.col("date") == F.lit(day).cast("date"))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole) * 100, F.lit(0.0))


def satellite_stats(positions: DataFrame, approximate: bool = False, land_only: bool = False) -> DataFrame:
    """Per satellite and orbit type: counts, altitudes, distinct countries, light. primary_source is that of the first
    position by time. The code of the open sea counts as a country unless land_only."""
    code = F.col("geo.country_code")
    code = F.when(~F.col("geo.over_ocean"), code) if land_only else code
    lit = F.col("lighting.in_sunlight")
    sunlit, dark = F.count_if(lit), F.count_if(~lit)
    return positions.groupBy("satellite_id", "satellite_name", F.col("orbit.type").alias("orbit_type")).agg(
        F.count("*").alias("position_count"),
        F.avg("altitude_km").alias("avg_altitude_km"),
        F.min("altitude_km").alias("min_altitude_km"),
        F.max("altitude_km").alias("max_altitude_km"),
        (F.approx_count_distinct(code) if approximate else F.count_distinct(code)).alias("countries_overflown"),
        sunlit.alias("sunlight_samples"),
        dark.alias("eclipse_samples"),
        F.min_by("source", F.struct("timestamp", "source")).alias("primary_source"),
        _share(sunlit, F.count("*")).alias("sunlight_pct"),
    )


def country_stats(positions: DataFrame) -> DataFrame:
    """Per satellite and country, over land only: samples, first and last time, name, region."""
    land = positions.where(~F.col("geo.over_ocean"))
    first = F.struct("timestamp", "geo.country_name", "geo.region")
    return land.groupBy("satellite_id", "satellite_name", F.col("geo.country_code").alias("country_code")).agg(
        F.count("*").alias("samples"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.min_by("geo.country_name", first).alias("country_name"), F.min_by("geo.region", first).alias("region"),
        (F.max("timestamp") - F.min("timestamp")).alias("seconds_between"),
    )


def distinct_sketches(positions: DataFrame, what: Column, precision: int = 12) -> DataFrame:
    """Per satellite and date a sketch of the distinct values of an expression (null: none): a binary of 2 ** precision registers
    at most that later days are united with, where an exact count would read all days again."""
    return positions.groupBy("date", "satellite_id").agg(F.hll_sketch_agg(what, precision).alias("sketch"))


def united_counts(sketches: DataFrame, *by: Column | str) -> DataFrame:
    """Distinct values over the days of a group, from their sketches. The relative standard error is about
    1.04 / sqrt(2 ** precision): 1.6 % with the default."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


def altitude_deltas(positions: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """Adds prev_altitude and altitude_delta along each satellite's track; its first position is dropped. tie: columns
    that order equal times."""
    met = tracks.with_previous(positions, "satellite_id", ["timestamp", *(tie or ["altitude_km"])], ["altitude_km"], F.floor(F.col("timestamp") / CHUNK_SECONDS), "_p")
    out = met.withColumn("prev_altitude", F.col("_p.altitude_km")).drop("_p").where(F.col("prev_altitude").isNotNull())
    return out.withColumn("altitude_delta", F.col("altitude_km") - F.col("prev_altitude"))


def orbit_health(positions: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """Per satellite: mean and spread of altitude steps, descents and ascents, and the trend in km per day (the slope
    of altitude over time)."""
    step = F.col("altitude_delta")
    return altitude_deltas(positions, tie).groupBy("satellite_id", "satellite_name").agg(
        F.count("*").alias("delta_count"), F.avg(step).alias("mean_altitude_delta"), F.stddev(step).alias("stddev_altitude_delta"),
        F.count_if(step < -S.DESCENT_KM).alias("descents"), F.count_if(step > S.DESCENT_KM).alias("ascents"),
        (F.regr_slope(F.col("altitude_km"), F.col("timestamp")) * 86400).alias("trend_km_per_day"),
    )


def daily_summary(stats: DataFrame) -> DataFrame:
    """One row over satellite_stats: satellites, positions, mean altitude, mean altitude per orbit type as JSON."""
    both = stats.rollup("orbit_type").agg(
        F.grouping("orbit_type").alias("all"), F.count_distinct("satellite_id").alias("n"), F.sum("position_count").alias("positions"),
        F.avg("avg_altitude_km").alias("mean"),
    )
    # A handful of orbit types and their total, so the second step is over a handful of rows.
    total = lambda c: F.max(F.when(F.col("all") == 1, F.col(c)))
    orbits = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("all") == 0, F.struct("orbit_type", F.round("mean", 1))))))
    return both.agg(
        total("positions").alias("total_positions"), F.round(total("mean"), 1).alias("avg_altitude_km"), F.to_json(orbits).alias("orbit_altitudes"),
        F.coalesce(total("n"), F.lit(0)).alias("satellites_tracked"),
    )


def summary_document(stats: DataFrame, day: str) -> DataFrame:
    """The satellites of a day as JSON rows keyed by satellite: one row each, none gathered."""
    return stats.select(F.lit(day).alias("date"), F.col("satellite_id").cast("string").alias("key"), F.to_json(F.struct(*stats.columns)).alias("value"))
