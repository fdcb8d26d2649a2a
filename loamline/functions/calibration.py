"""The straight line between a probe's raw reading and soil moisture."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed endpoints of the probe: raw reading in dry air and in water.
ADC_DRY = 3200
ADC_WET = 1200


def moisture_to_raw(pct: Column, dry: Column | int = ADC_DRY, wet: Column | int = ADC_WET) -> Column:
    """Raw reading for a moisture percentage, fraction cut off. Wetter soil reads lower."""
    dry, wet = _col(dry), _col(wet)
    return (dry - pct / F.lit(100.0) * (dry - wet)).cast("int")


def raw_to_moisture(raw: Column, dry: Column | int = ADC_DRY, wet: Column | int = ADC_WET) -> Column:
    """Moisture percentage for a raw reading; NULL where the endpoints coincide."""
    dry, wet = _col(dry), _col(wet)
    return F.try_divide((dry - raw).cast("double"), dry - wet) * F.lit(100.0)


def _col(value: Column | int) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
