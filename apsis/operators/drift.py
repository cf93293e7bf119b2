"""Two-line elements: decode, consecutive drift per satellite, flags, weekly report.

Drift reads its elements twice (for the rows, and for the last row of every week of a satellite): where they are decoded from
text, write them first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import calendar, tle
from . import tracks

#: Elements that drift, with the digits of their daily rates.
RATES = {"mean_motion": 6, "inclination": 6, "eccentricity": 8, "raan": 6, "arg_perigee": 6, "bstar": 10}
ANGLES = ("raan", "arg_perigee")


def parse_tle(rows: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(element rows, rejects). A line must have 69 characters after trimming; strict also wants right checksums."""
    named = rows.withColumns({"_one": F.trim("tle_line1"), "_two": F.trim("tle_line2")})
    one, two = F.col("_one"), F.col("_two")
    empty = F.col("satellite_id").isNull() | (F.coalesce(one, F.lit("")) == "") | (F.coalesce(two, F.lit("")) == "")
    short = (F.length(one) != S.TLE_LENGTH) | (F.length(two) != S.TLE_LENGTH)
    fault = F.when(empty, "incomplete").when(short, "length").when(~one.startswith("1") | ~two.startswith("2"), "line number")
    if strict:
        fault = fault.when(~tle.right_checksum(one) | ~tle.right_checksum(two), "checksum")
    fields = tle.elements(one, two)
    fields["tle_epoch"] = fields.pop("epoch")
    worked = named.select("satellite_id", "satellite_name", "tle_line1", "tle_line2", fault.alias("_fault"), *[c.alias(k) for k, c in fields.items()])
    # A generator of one row: what comes after uses the decoded fields instead of decoding the lines again.
    lines = ["satellite_id", "satellite_name", "tle_line1", "tle_line2"]
    decoded = worked.select(*lines, F.inline(F.array(F.struct("_fault", *fields))))
    no_number = F.col("epoch_time").isNull() | F.col("mean_motion").isNull() | F.col("inclination").isNull() | F.col("eccentricity").isNull()
    decoded = decoded.withColumn("_fault", F.coalesce("_fault", F.when(no_number, "number")))
    rejects = decoded.where("_fault is not null").select(F.lit("tle").alias("source"), F.col("_fault").alias("reason"), F.concat_ws("\n", "tle_line1", "tle_line2").alias("raw"))
    good = decoded.where("_fault is null")
    return good.select(
        "satellite_id", "satellite_name", "tle_epoch", "epoch_time", "norad_id", "classification", "intl_designator", "bstar", "mean_motion_dot",
        "inclination", "raan", "eccentricity", "arg_perigee", "mean_anomaly", "mean_motion", "rev_number",
    ), rejects


def in_week(elements: DataFrame, label: str | None) -> DataFrame:
    """Elements of one ISO week (`YYYY-WW`), or of all."""
    return elements if label is None else elements.where(calendar.iso_week(F.to_date("epoch_time"))["label"] == label)


def _shortest(angle: Column) -> Column:
    """An angle difference within -180 .. 180."""
    return F.pmod(angle + 180, F.lit(360.0)) - 180


def _week(at: str) -> Column:
    """A chunk of a track."""
    return F.floor(F.unix_seconds(at) / 604_800)


def _beside(elements: DataFrame) -> DataFrame:
    """elements with _p, the satellite's element set before."""
    order = ["epoch_time", "mean_motion", "eccentricity", "inclination", "raan", "arg_perigee", "bstar"]
    return tracks.with_previous(elements, "satellite_id", order, ["epoch_time", *RATES], _week("epoch_time"), "_p")


def _pair(wrap: bool) -> tuple[Column, Column]:
    """(days between the two sets of a row, the drift between them as a struct)."""
    days = (F.unix_micros("epoch_time") - F.unix_micros("_p.epoch_time")) / 86_400_000_000

    def rate(name: str, digits: int) -> Column:
        change = F.col(name) - F.col(f"_p.{name}")
        change = _shortest(change) if wrap and name in ANGLES else change
        return F.round(change / days, digits).alias(f"{name}_drift")

    return days, F.struct(F.col("_p.epoch_time").alias("from_epoch"), F.col("epoch_time").alias("to_epoch"), F.round(days, 4).alias("dt_days"), *[rate(n, d) for n, d in RATES.items()])


def tle_drift(elements: DataFrame, wrap: bool = False) -> DataFrame:
    """Daily rates between consecutive elements of a satellite; pairs that are not apart in time give no row. wrap:
    take the shorter way round for angles."""
    days, pair = _pair(wrap)
    return _beside(elements).where(days > 0).select("satellite_id", pair.alias("d")).select("satellite_id", "d.*")


def drift_flags(drift: Column | None = None) -> Column:
    """Flags of one drift row (columns, or a struct), from its rounded rates, in fixed order."""
    of = F.col if drift is None else lambda c: drift[c]
    at = calendar.utc_iso(of("to_epoch"))
    rules = [("mean_motion_drift", S.MEAN_MOTION_LIMIT, "MEAN_MOTION_MANEUVER"), ("inclination_drift", S.INCLINATION_LIMIT, "INCLINATION_CHANGE"), ("eccentricity_drift", S.ECCENTRICITY_LIMIT, "ECCENTRICITY_CHANGE")]
    return F.array_compact(F.array(*[F.when(F.abs(of(c)) > limit, F.concat(F.lit(f"{name} at "), at)) for c, limit, name in rules]))


def drift_report(elements: DataFrame, wrap: bool = False) -> DataFrame:
    """Per satellite: period, count, ordered drift rows, flags and means. A single element gives an empty drift list. One
    aggregation gives the totals and the list."""
    days, pair = _pair(wrap)
    rows = _beside(elements).withColumn("_d", F.when(days > 0, pair))
    report = rows.groupBy("satellite_id").agg(
        F.struct(F.min("epoch_time").alias("start"), F.max("epoch_time").alias("end")).alias("analysis_period"), F.count("*").alias("tle_count"),
        F.array_sort(F.collect_list("_d")).alias("drift_analysis"),
        F.struct(F.round(F.avg("mean_motion"), 6).alias("mean_mean_motion"), F.round(F.avg("eccentricity"), 8).alias("mean_eccentricity"), F.round(F.avg("inclination"), 4).alias("mean_inclination")).alias("summary"),
    )
    flagged = report.withColumn("anomaly_flags", F.flatten(F.transform("drift_analysis", drift_flags)))
    return flagged.select("satellite_id", "analysis_period", "tle_count", "drift_analysis", (F.size("anomaly_flags") > 0).alias("anomaly_detected"), "anomaly_flags", "summary")


def drift_partials(elements: DataFrame, wrap: bool = False) -> DataFrame:
    """Reports of a satellite's ISO weeks (by their Monday) that add up: period, count, sums, number of drift rows and of flags, and
    the week's own drift rows and flags in order. A pair of elements belongs to the week of its second one, so that weeks can be
    computed, stored and replaced one by one (given the last element before); no row grows with the track."""
    days, pair = _pair(wrap)
    rows = _beside(elements).withColumn("_d", F.when(days > 0, pair)).withColumn("_week", F.date_trunc("week", "epoch_time").cast("date"))
    weeks = rows.groupBy("satellite_id", F.col("_week").alias("week")).agg(
        F.min("epoch_time").alias("start"), F.max("epoch_time").alias("end"), F.count("*").alias("tle_count"),
        F.sum("mean_motion").alias("sum_mean_motion"), F.sum("eccentricity").alias("sum_eccentricity"), F.sum("inclination").alias("sum_inclination"), F.count("_d").alias("drifts"), F.array_sort(F.collect_list("_d")).alias("drift_analysis"),
    )
    flagged = weeks.withColumn("anomaly_flags", F.flatten(F.transform("drift_analysis", drift_flags)))
    return flagged.withColumn("flags", F.size("anomaly_flags").cast("bigint"))


def merged_report(partials: DataFrame) -> DataFrame:
    """The figures of drift_report per satellite from the weeks' sums; the rows and flags themselves stay with their weeks."""
    mean = lambda c, digits: F.round(F.sum(f"sum_{c}") / F.sum("tle_count"), digits).alias(f"mean_{c}")
    return partials.groupBy("satellite_id").agg(
        F.struct(F.min("start").alias("start"), F.max("end").alias("end")).alias("analysis_period"), F.sum("tle_count").alias("tle_count"), F.sum("drifts").alias("drifts"), F.sum("flags").alias("flags"),
        (F.sum("flags") > 0).alias("anomaly_detected"), F.struct(mean("mean_motion", 6), mean("eccentricity", 8), mean("inclination", 4)).alias("summary"),
    )


def changed_tles(rows: DataFrame, order: str = "ingestion_time") -> DataFrame:
    """Rows whose first line differs from the satellite's one before: A, A, B, A gives A, B, A. order: a text that begins
    with the date, whose days are the chunks of the track."""
    met = tracks.with_previous(rows, "satellite_id", [order, "tle_line1", "tle_line2"], ["tle_line1"], F.substring(order, 1, 10), "_b")
    return met.where(F.col("_b").isNull() | ~F.col("_b.tle_line1").eqNullSafe(F.col("tle_line1"))).drop("_b")
