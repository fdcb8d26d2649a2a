"""Records that the watermark of the clean stream dropped, found again.

The clean stream forgets keys ten minutes after their event time and drops what comes later, although
records up to a day old pass the gates. All accepted messages are still there, so what was lost is the
difference between them and the clean table, taken per day of ingestion once the stream is past it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.contract import CLEAN_PARTITIONS, CLEAN_SCHEMA, TELEMETRY, Contract
from loamline.operators.gates import clean_records
from loamline.sources.lake import read_lake, write_partitioned
from loamline.streaming.job import Paths, judged

# Days on either side of the ingestion day that an accepted record's event time may lie in.
_REACH = dt.timedelta(days=1)


def missing_records(accepted: DataFrame, kept: DataFrame, contract: Contract = TELEMETRY) -> DataFrame:
    """Passing records, one per key, whose key ``kept`` does not hold. Both sides meet by (device, time), so a
    busy device spreads."""
    keys = kept.select(*contract.key)
    return clean_records(judged(accepted, contract), contract).join(keys, list(contract.key), "left_anti")


def recover_late(spark: SparkSession, accepted: DataFrame, paths: Paths, first: dt.date, last: dt.date | None = None,
                 contract: Contract = TELEMETRY) -> DataFrame:
    """Append what the clean stream lost of the messages ingested from ``first`` to ``last`` to the table of late
    records, and return that table.

    Only days that the stream has left behind are closed; an open day would have records still on their way
    taken for lost. What is already in the table is not lost, so a second run adds nothing.
    """
    last = last or first
    days = accepted.filter(F.to_date("timestamp").between(F.lit(first), F.lit(last)))
    near = F.col("date").between(F.lit(first - _REACH), F.lit(last + _REACH))
    kept = read_lake(spark, paths.clean, CLEAN_SCHEMA).unionByName(read_lake(spark, paths.late, CLEAN_SCHEMA))
    lost = missing_records(days, kept.filter(near), contract)
    write_partitioned(lost, paths.late, CLEAN_PARTITIONS)
    return read_lake(spark, paths.late, CLEAN_SCHEMA)
