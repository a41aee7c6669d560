"""Running detectors side by side, and reporting on their runs."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from logquarry.functions.timerange import Instant
from logquarry.operators import alerts as alert_ops
from logquarry.operators.dedup import DedupKey, beginning, deduplicate
from logquarry.operators.detectors.base import Detector
from logquarry.operators.detectors.cells import ALL, CellDetector, cells_in, count_cells
from logquarry.operators.detectors.rules import DEDUP_HOURS
from logquarry.schema import ANOMALY, DETECTOR_RUN, SEVERITIES
from logquarry.session import materialise

logger = logging.getLogger(__name__)


@dataclass
class Findings:
    """Anomalies of all detectors in detector order, and one run record per detector."""

    anomalies: DataFrame
    runs: list[tuple] = field(default_factory=list)
    # Number of the logs, where a detector had them counted.
    logs: int | None = None

    def runs_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.runs, DETECTOR_RUN)


class _SharedCells:
    """Cells of the detectors that look at the same logs, counted when the first of them asks."""

    def __init__(self, logs: DataFrame, detectors: list[Detector], as_of: Instant) -> None:
        self.logs, self.as_of = logs, as_of
        self.groups: dict[int, list[CellDetector]] = {}
        for detector in detectors:
            if isinstance(detector, CellDetector):
                self.groups.setdefault(self._source(detector), []).append(detector)
        self.counted: dict[int, DataFrame] = {}

    @staticmethod
    def _source(detector: CellDetector) -> int:
        return id(detector.history) if detector.history else 0

    def of(self, detector: CellDetector) -> DataFrame:
        source = self._source(detector)
        group = self.groups[source]
        if source not in self.counted:
            logs = detector.history() if detector.history else self.logs
            intervals = [d.interval(self.as_of) for d in group]
            if not source:
                intervals.append(ALL)  # and the number of logs comes with it
            self.counted[source] = materialise(count_cells(logs, intervals))
        return cells_in(self.counted[source], next(i for i, d in enumerate(group) if d is detector))

    def total(self) -> int | None:
        """Number of the given logs, when they were counted."""
        if 0 not in self.counted:
            return None
        return self.counted[0].agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]


def run_detectors(logs: DataFrame, detectors: list[Detector], as_of: Instant = None) -> Findings:
    """Run every enabled detector; a failing one is recorded and does not stop the others.

    A lazy plan fails only when it runs, so each detector's anomalies are written out (reliable
    checkpoint) on their own before they are put together, and counted by the same write. Detectors
    that need counts only share one aggregation of the logs.
    """
    spark = logs.sparkSession
    found = [spark.createDataFrame([], ANOMALY).withColumn("detector_seq", F.lit(0))]
    runs = []
    shared = _SharedCells(logs, [d for d in detectors if d.enabled], as_of)
    for seq, detector in enumerate(detectors):
        if not detector.enabled:
            continue
        started = datetime.now(timezone.utc)
        count, error = 0, None
        try:
            if isinstance(detector, CellDetector):
                part = detector.detect_cells(shared.of(detector), as_of)
            else:
                part = detector.detect(logs, as_of)
            written = Observation()
            part = part.select(*ANOMALY.fieldNames()).withColumn("detector_seq", F.lit(seq))
            part = materialise(part.observe(written, F.count(F.lit(1)).alias("rows")))
            count = written.get["rows"]
            found.append(part)
        except Exception as failure:  # whatever a user-written detector raises
            logger.exception("detector %s failed", detector.name)
            error = f"{type(failure).__name__}: {failure}"
        runs.append((detector.name, True, started, count, error))
    return Findings(reduce(DataFrame.unionByName, found), runs, shared.total())


def analyze(
    logs: DataFrame,
    statistical: list[Detector],
    ml: Detector | None = None,
    include_statistical: bool = True,
    include_ml: bool = True,
    as_of: Instant = None,
) -> tuple[Findings, int]:
    """Run the chosen detectors on the given logs: findings and the number of logs."""
    chosen = list(statistical) if include_statistical else []
    if include_ml and ml is not None and getattr(ml, "model", None) is not None:
        chosen.append(ml)
    findings = run_detectors(logs, chosen, as_of)
    return findings, logs.count() if findings.logs is None else findings.logs


def alerts_from(
    findings: Findings,
    alerts: DataFrame,
    dedup_hours: float = DEDUP_HOURS,
    as_of: Instant = None,
    dedup_key: DedupKey = beginning,
) -> DataFrame:
    """New alerts for the findings, given the current alerts. Unknown severities create nothing."""
    valid = findings.anomalies.filter(F.col("severity").isin(*SEVERITIES))
    kept = deduplicate(valid, alert_ops.open_since(alerts, dedup_hours, as_of), dedup_key=dedup_key)
    return alert_ops.new_alerts(kept, as_of)


def detector_stats(runs: DataFrame, detectors: list[Detector] | None = None) -> DataFrame:
    """Per detector: whether it is enabled, when it last ran, how often, and what it found.

    With ``detectors`` there is a row for each of them, run or not, and ``settings`` holds what
    they say of themselves as JSON.
    """
    ran = runs.groupBy("name").agg(
        F.max_by("enabled", "run_at").alias("enabled"),
        F.max("run_at").alias("last_run"),
        F.count(F.lit(1)).alias("runs_count"),
        F.sum("anomalies").alias("alerts_created"),
    )
    if detectors is None:
        return ran
    rows = [(d.name, d.enabled, json.dumps(d.describe(), sort_keys=True, default=str)) for d in detectors]
    known = runs.sparkSession.createDataFrame(rows, "name string, enabled boolean, settings string")
    return known.join(ran.drop("enabled"), "name", "left").select(
        "name",
        "enabled",
        "settings",
        "last_run",
        F.coalesce("runs_count", F.lit(0)).alias("runs_count"),
        F.coalesce("alerts_created", F.lit(0)).alias("alerts_created"),
    )


def poll_stats(polls: DataFrame) -> DataFrame:
    """Totals over all polls."""
    return polls.agg(
        F.count(F.lit(1)).alias("polls_count"),
        F.coalesce(F.sum("logs_processed"), F.lit(0)).alias("logs_processed"),
        F.coalesce(F.sum("alerts_created"), F.lit(0)).alias("alerts_created"),
        F.max("polled_at").alias("last_poll"),
    )
