"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

# Settings the operators rely on; all can be set on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Device and site names such as "01" must stay text when read from directory names.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    # Devices a task keeps in a hash table before it sorts; a row of state is a few hundred bytes.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "16384",
    # A message that repeats a JSON key is still readable; the last value counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Deduplication state lives in RocksDB, outside the executor heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A micro-batch uploads what changed in the state, not a snapshot of all of it.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@dataclass(frozen=True)
class ObjectStore:
    """An S3-compatible endpoint with path-style addressing and static credentials."""

    endpoint: str
    access_key: str
    secret_key: str
    tls: bool = False

    def conf(self) -> dict[str, str]:
        s3a = {
            "endpoint": self.endpoint,
            "access.key": self.access_key,
            "secret.key": self.secret_key,
            "path.style.access": "true",
            "connection.ssl.enabled": str(self.tls).lower(),
            "aws.credentials.provider": "org.apache.hadoop.fs.s3a.SimpleAWSCredentialsProvider",
        }
        return {f"spark.hadoop.fs.s3a.{k}": v for k, v in s3a.items()}


def build_session(app_name: str = "loamline", store: ObjectStore | None = None,
                  **extra: str) -> SparkSession:
    """A UTC session; master and sizes come from spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**RUNTIME_CONF, **(store.conf() if store else {}), **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Put the settings of ``RUNTIME_CONF`` on a session somebody else built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor can reach.

    A machine-local folder is used only by a local session that names none.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="loamline-")
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
