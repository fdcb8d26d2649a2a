import datetime as dt
import math
import random
from fractions import Fraction

import pytest
from conftest import utc
from pyspark.sql import functions as F

from loamline.functions import calibration, numbers, texts, times


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def at(text):
    return F.lit(utc(text)).cast("timestamp")


def test_boundaries_are_counted_not_elapsed_units(spark):
    a, b = at("2026-01-01T00:00:59"), at("2026-01-01T00:01:01")
    assert one(spark, times.boundaries_crossed("minute", a, b)) == 1
    assert one(spark, times.boundaries_crossed("hour", a, b)) == 0
    assert one(spark, times.boundaries_crossed("hour", at("2026-01-01T01:59:00"), at("2026-01-01T04:00:00"))) == 3


@pytest.mark.parametrize(("seconds", "want"), [(900, 15.0), (902, 15.0), (906, 15.1), (903, 15.0), (909, 15.2)])
def test_age_is_rounded_to_a_tenth(spark, seconds, want):
    # 15.05 and 15.15 lie exactly between two tenths and go to the even one.
    seen = utc("2026-01-01T00:00:00")
    now = F.lit(seen + dt.timedelta(seconds=seconds)).cast("timestamp")
    assert one(spark, times.age_minutes(F.lit(seen).cast("timestamp"), now)) == want


def test_hours_lie_on_a_circle(spark):
    def point(h):
        s, c = times.on_day_circle(F.lit(h))
        return one(spark, s), one(spark, c)
    assert math.dist(point(23), point(0)) < 0.3
    assert math.dist(point(12), point(0)) == pytest.approx(2.0)
    assert point(6) == pytest.approx((1.0, 0.0))


def test_version_stamp(spark):
    assert one(spark, times.version_stamp(at("2031-03-05T01:02:03"))) == "20310305T010203Z"


def test_rounding_follows_the_decimal_reading(spark):
    assert one(spark, numbers.round_exact(F.lit(0.285), 2)) == 0.29
    assert one(spark, numbers.round_exact(F.lit(-0.285), 2)) == -0.29
    assert one(spark, numbers.round_exact(F.lit(0.0049999996), 2)) == 0.0
    assert one(spark, numbers.round_exact(F.lit(12.3449999996), 2)) == 12.34
    assert one(spark, numbers.round_exact(F.lit(1e13), 2)) == 1e13
    assert math.isnan(one(spark, numbers.round_exact(F.lit(float("nan")), 2)))


def mean(df, digits=2):
    return df.agg(numbers.exact_sum("v").alias("s")).select(numbers.mean_of("s", digits).alias("m")).first()["m"]


def test_mean_is_exact_and_skips_null(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (None,)], "v double")
    assert mean(df) == 0.15
    assert mean(df.filter("v > 5")) is None
    for value, rounded in ((0.0049999996, 0.0), (1e13, 1e13), (2.0 ** 82, 2.0 ** 82), (3e300, 3e300), (-7e-12, 0.0)):
        assert mean(spark.createDataFrame([(value,)] * 3, "v double")) == rounded
    assert math.isnan(mean(spark.createDataFrame([(1.0,), (float("nan"),)], "v double")))
    assert mean(spark.createDataFrame([(1.0,), (float("inf"),)], "v double")) == float("inf")


def totals(df):
    return df.groupBy("g").agg(numbers.exact_sum("v").alias("s")).select("g", F.expr(numbers.total_text("s")).alias("t"))


def test_sums_are_exact_in_any_order(spark):
    """Against rationals: nine decimals, sizes far apart, and terms that cancel."""
    rng = random.Random(3)
    values = [(g, v) for g in range(6) for v in
              [round(rng.uniform(-100, 100), 9) for _ in range(300)] + [1e13 * rng.random(), -3.3e20, 3.3e20, 1e-6 * rng.random()]]
    want = {g: float(sum(Fraction(v) for k, v in values if k == g)) for g in range(6)}
    seen = set()
    for parts in (1, 5, 13):
        rng.shuffle(values)
        got = {r["g"]: r["t"] for r in totals(spark.createDataFrame(values, "g int, v double").repartition(parts)).collect()}
        seen.add(tuple(sorted(got.items())))
        assert all(abs(got[g] - want[g]) <= math.ulp(want[g]) for g in want)
    assert len(seen) == 1


def test_states_merge(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), (F.rand(5) * 1e6 - 4e5).alias("v"))
    halves = df.groupBy("g", (F.col("g") + F.spark_partition_id()).alias("h")).agg(numbers.exact_sum("v").alias("s"))
    kept = halves.select("g", numbers.carried("s").alias("s"))
    merged = kept.groupBy("g").agg(numbers.merged_sum("s").alias("s")).select("g", F.expr(numbers.total_text("s")).alias("t"))
    assert sorted(merged.collect()) == sorted(totals(df).collect())
    largest = kept.select(F.max(F.greatest(*[F.abs(f"s.l{i}") for i in range(numbers.LIMBS - 1)]))).first()[0]
    assert largest <= 1 << (numbers.LIMB - 1)


def test_ratio_and_clamp(spark):
    assert one(spark, numbers.ratio(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, numbers.ratio(F.lit(1), F.lit(3))) == 0.3333
    assert one(spark, numbers.clamp(F.lit(7.0), 0.0, 5.0)) == 5.0
    assert one(spark, numbers.clamp(F.lit(0.0), low=0.0001)) == 0.0001


@pytest.mark.parametrize(("value", "inclusive", "want"), [
    (0.0, True, False), (0.0, False, True), (100.1, True, True), (50.0, False, False), (None, True, False)])
def test_outside(spark, value, inclusive, want):
    assert one(spark, numbers.outside(F.lit(value).cast("double"), 0, 100, inclusive)) is want


def test_texts(spark):
    assert one(spark, texts.reason_family(F.lit("range:a,b"))) == "range"
    assert one(spark, texts.reason_family(F.lit("unparseable_payload"))) == "unparseable_payload"
    assert one(spark, texts.topic_segment(F.lit("farm/orchard/probe-7/status"), -2)) == "probe-7"
    assert one(spark, texts.topic_segment(F.lit("status"), -2)) is None
    assert one(spark, texts.flagged({"a": F.lit(True), "b": F.lit(False), "c": F.lit(True)})) == "a,c"


@pytest.mark.parametrize("pct", [0.0, 12.5, 33.3, 50.0, 78.9, 100.0])
def test_calibration_round_trips(spark, pct):
    back = calibration.raw_to_moisture(calibration.moisture_to_raw(F.lit(pct)))
    assert one(spark, back) == pytest.approx(pct, abs=0.1)


def test_calibration_ends_and_direction(spark):
    df = spark.range(0, 101, 10).select("id", calibration.moisture_to_raw(F.col("id").cast("double")).alias("raw"))
    raws = [r["raw"] for r in df.orderBy("id").collect()]
    assert (raws[0], raws[-1]) == (3200, 1200)
    assert all(a > b for a, b in zip(raws, raws[1:]))
    assert one(spark, calibration.moisture_to_raw(F.lit(33.33))) == int(3200 - 33.33 / 100 * 2000)
    assert one(spark, calibration.raw_to_moisture(F.lit(5), F.lit(9), F.lit(9))) is None
