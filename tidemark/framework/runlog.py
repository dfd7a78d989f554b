"""The dataset registry, the log of ingestion runs, and pipelines whose steps fail alone."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import first_of

REGISTRY = "dataset_id string, source string, storage_table string, description string, provenance string, resolution string, natural_key array<string>, freshness_column string, max_stale_us long, filter_column string, filter_value string"
RUNS = "run_id long, dataset_id string, started_us long, finished_us long, status string, fetched long, inserted long, cursor string, window_start string, window_end string, error string"


def latest(runs: DataFrame) -> DataFrame:
    """Each dataset's last run."""
    return first_of(runs, ["dataset_id"], F.col("started_us").desc(), F.col("run_id").desc())


def progress(deltas: DataFrame) -> DataFrame:
    """Totals of a run from its progress rows (run_id, seq, fetched, inserted, cursor); the cursor is the last."""
    return deltas.groupBy("run_id").agg(F.sum("fetched").alias("fetched"), F.sum("inserted").alias("inserted"), F.max_by("cursor", "seq").alias("cursor"))


def remaining(windows: DataFrame, runs: DataFrame, dataset_id: str) -> DataFrame:
    """Windows (window_start, window_end) that no completed run of a dataset covers."""
    done = runs.where((F.col("dataset_id") == dataset_id) & (F.col("status") == "completed")).select("window_start", "window_end")
    return windows.join(done, ["window_start", "window_end"], "left_anti")


def run_steps(steps: Mapping[str, Callable[[], object]]) -> dict[str, object]:
    """Results of all steps by name; a step that fails leaves its error, and the next one runs."""
    out: dict[str, object] = {}
    for name, step in steps.items():
        try:
            out[name] = step()
        except Exception as e:  # noqa: BLE001  the caller gets it
            out[name] = e
    return out
