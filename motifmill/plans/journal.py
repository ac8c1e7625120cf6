"""The log of a fit: after each pass its parameters, history and the path of its samples' state, in the shared folder.

A fit that is given the same name again goes on from the last pass that was logged, also in another application. A record is written
before the state it replaces is dropped, so there is always one whole record. Records stay until forget().
"""

from __future__ import annotations

import io
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .schedule import Stopper
from .written import drop, keep, shared_dir


class Journal:
    def __init__(self, spark: SparkSession, name: str | None, **fixed: object):
        """fixed: what has to be the same for a fit to go on (data sizes, options). Without a name nothing is logged."""
        self.spark, self.name, self.fixed = spark, name, repr(sorted(fixed.items()))
        self.at = f"{shared_dir(spark)}/motifmill-fits/{name}" if name else None

    def _folder(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.at)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _records(self) -> list[str]:
        """Paths of whole records, the oldest first."""
        at, files = self._folder()
        if not files.exists(at):
            return []
        names = sorted(s.getPath().getName() for s in files.listStatus(at) if s.getPath().getName().startswith("pass-"))
        whole = lambda n: files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{n}/_SUCCESS"))
        return [f"{self.at}/{n}" for n in names if whole(n)]

    def last(self) -> tuple[int, dict[str, np.ndarray], DataFrame, str] | None:
        """Pass, values, rows and their path of the last record."""
        records = self._records() if self.name else []
        if not records:
            return None
        row = self.spark.read.parquet(records[-1]).first()
        if row.fixed != self.fixed:
            raise ValueError(f"the fit {self.name} was begun with other data or options: {row.fixed}")
        return row.it, dict(np.load(io.BytesIO(row.values_npz))), self.spark.read.parquet(row.path), row.path

    def save(self, it: int, path: str, stop: Stopper | None = None, history: list[tuple[int, float]] = (), **values: np.ndarray | float) -> None:
        if not self.name:
            return
        keep(path)
        data = io.BytesIO()
        extra = {} if stop is None else {f"stop_{k}": np.nan if v is None else v for k, v in asdict(stop).items() if k in ("last", "small")}
        np.savez(data, history=np.array(history, float).reshape(-1, 2), **extra, **values)
        old = self._records()
        self.spark.createDataFrame([(it, path, self.fixed, bytearray(data.getvalue()))], "it int, path string, fixed string, values_npz binary").coalesce(1).write.mode("overwrite").parquet(f"{self.at}/pass-{it:06d}")
        _, files = self._folder()
        for record in old:
            if not record.endswith(f"pass-{it:06d}"):
                files.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(record), True)

    def forget(self) -> None:
        """Delete the records and the last state."""
        for record in self._records():
            drop(self.spark.read.parquet(record).first().path, self.spark)
        at, files = self._folder()
        files.delete(at, True)


def restore(stop: Stopper, values: dict[str, np.ndarray]) -> list[tuple[int, float]]:
    """The history of a record; the stop rule goes on where it was."""
    if "stop_small" in values:
        last = float(values["stop_last"])
        stop.last, stop.small = None if np.isnan(last) else last, int(values["stop_small"])
    return [(int(t), float(v)) for t, v in values["history"]]
