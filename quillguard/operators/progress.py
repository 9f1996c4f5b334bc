"""How far a job is: from Spark's own counts of tasks."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Progress:
    done: int
    failed: int
    total: int
    elapsed: float

    @property
    def percentage(self) -> float:
        return 100.0 * self.done / self.total if self.total else 0.0

    @property
    def complete(self) -> bool:
        return 0 < self.total <= self.done

    @property
    def eta(self) -> float | None:
        """Seconds, if the rest goes as fast."""
        return self.elapsed / self.done * (self.total - self.done) if self.done else None


class Tracker:
    """Of the jobs of a group: with tracker: runs what is inside as its jobs; snapshot() can be called from another thread."""

    def __init__(self, spark: SparkSession, group: str):
        self.sc, self.group, self.began = spark.sparkContext, group, time.time()

    def __enter__(self) -> "Tracker":
        self.sc.setJobGroup(self.group, self.group)
        self.began = time.time()
        return self

    def __exit__(self, *_) -> None:
        self.sc.setLocalProperty("spark.jobGroup.id", None)

    def snapshot(self) -> Progress:
        status, done, failed, total = self.sc.statusTracker(), 0, 0, 0
        for job in status.getJobIdsForGroup(self.group):
            info = status.getJobInfo(job)
            for stage in info.stageIds if info else ():
                if s := status.getStageInfo(stage):
                    done, failed, total = done + s.numCompletedTasks, failed + s.numFailedTasks, total + s.numTasks
        return Progress(done, failed, total, time.time() - self.began)
