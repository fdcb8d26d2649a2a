"""What one record looks like and when it counts as good.

Every operator takes a ``Contract``; ``TELEMETRY`` is the instance for soil sensors.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Contract:
    """Declared columns, rules and time tolerances of a message stream."""

    columns: dict[str, str]
    required: tuple[str, ...]
    structural: tuple[str, ...]
    ranges: dict[str, tuple[float, float]]
    entity: str = "device_id"
    site: str = "site_id"
    event_time: str = "ts"
    max_ahead: str = "5 minutes"
    max_age: str = "24 hours"
    watermark: str = "10 minutes"
    identity: tuple[str, ...] = field(default=("device_id", "site_id", "ts"))

    @property
    def payload_schema(self) -> str:
        """The JSON schema; the event time stays text so that a bad one can be told from a missing one."""
        return ", ".join(f"{n} {t}" for n, t in self.columns.items())

    @property
    def key(self) -> tuple[str, str]:
        return self.entity, self.event_time

    @property
    def measures(self) -> list[str]:
        """Payload columns other than the identity columns."""
        return [c for c in self.columns if c not in self.identity]


# Fixed values of the data contract: columns, required fields, hardware bounds.
TELEMETRY = Contract(
    columns={
        "device_id": "string",
        "site_id": "string",
        "ts": "string",
        "soil_moisture_pct": "double",
        "soil_raw": "int",
        "air_temp_c": "double",
        "air_humidity_pct": "double",
        "battery_v": "double",
        "fw_version": "string",
    },
    required=("device_id", "site_id", "ts", "soil_moisture_pct"),
    structural=("device_id", "site_id", "ts"),
    ranges={
        "soil_moisture_pct": (0.0, 100.0),
        "air_temp_c": (-40.0, 80.0),
        "air_humidity_pct": (0.0, 100.0),
        "soil_raw": (0, 4095),
        "battery_v": (2.5, 5.0),
    },
)

# Table layouts, partition columns last.
CLEAN_SCHEMA = (
    "device_id string, ts timestamp, soil_moisture_pct double, soil_raw int, air_temp_c double, "
    "air_humidity_pct double, battery_v double, fw_version string, kafka_partition int, "
    "kafka_offset bigint, site_id string, date date"
)
QUARANTINE_SCHEMA = (
    "quality_reason string, device_id string, site_id string, ts timestamp, kafka_ts timestamp, "
    "kafka_partition int, kafka_offset bigint, raw_value string, quality_rule string, date date"
)
CLEAN_PARTITIONS = ["site_id", "date"]
QUARANTINE_PARTITIONS = ["quality_rule", "date"]
DEAD_LETTER_SCHEMA = "key string, value string, family string"
DEAD_LETTER_PARTITIONS = ["family"]

# Fixed thresholds shared by reports and models.
DRY_THRESHOLD_PCT = 32.0
BASELINE_MARGIN_PCT = 2.0
SILENCE_MINUTES = 15
MAX_MART_LAG_HOURS = 26
TRAIN_FRACTION = 0.7
MIN_TRAINING_ROWS = 500
