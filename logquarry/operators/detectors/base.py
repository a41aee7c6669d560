"""The detector interface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions.timerange import Instant
from logquarry.schema import SYSTEM_LOG_ID


class Detector:
    """Turns logs into anomalies (log_id, anomaly_type, severity, message, details).

    Subclass it, give it a name and implement ``detect`` as a DataFrame transformation.
    """

    def __init__(self, name: str, enabled: bool = True) -> None:
        self.name = name
        self.enabled = enabled

    def detect(self, logs: DataFrame, as_of: Instant = None) -> DataFrame:
        raise NotImplementedError

    def train(self, logs: DataFrame) -> bool:
        """Detectors without a model have nothing to train."""
        return False

    def describe(self) -> dict[str, object]:
        """Settings worth reporting beside the run counts."""
        return {}


def system_anomaly(df: DataFrame, kind: str, severity: str, message: Column, details: list[str]) -> DataFrame:
    """Anomaly about the system as a whole, with the named columns as JSON details."""
    return df.select(
        F.lit(SYSTEM_LOG_ID).alias("log_id"),
        F.lit(kind).alias("anomaly_type"),
        F.lit(severity).alias("severity"),
        message.alias("message"),
        F.to_json(F.struct(*details)).alias("details"),
    )
