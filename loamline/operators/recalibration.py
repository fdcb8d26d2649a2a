"""Moisture recomputed from raw readings with corrected probe endpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.functions.calibration import ADC_DRY, ADC_WET, raw_to_moisture
from loamline.functions.numbers import round_exact


def recalibrate(readings: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Add ``recalibrated_pct``; devices without own endpoints (device_id, adc_dry, adc_wet) keep the defaults.

    One endpoint row per device: Spark broadcasts them where statistics show that they fit, and
    otherwise shuffles both sides. The rebalance hint keeps the endpoints from bringing along the
    partitioning of an aggregate; AQE splits a hot device only between two plain exchanges.
    """
    joined = readings.join(endpoints.hint("rebalance"), "device_id", "left")
    dry = F.coalesce("adc_dry", F.lit(ADC_DRY))
    wet = F.coalesce("adc_wet", F.lit(ADC_WET))
    pct = round_exact(raw_to_moisture(F.col("soil_raw"), dry, wet), 2)
    return joined.withColumn("recalibrated_pct", pct).drop("adc_dry", "adc_wet")
