"""Sensor telemetry on Spark: ingest checks, quality gates, marts, state, features, monitoring."""

from loamline.contract import TELEMETRY, Contract

__all__ = ["TELEMETRY", "Contract"]
