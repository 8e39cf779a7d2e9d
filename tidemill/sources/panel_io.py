"""Reading and writing panels, backtest results and run metadata."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.panel import DS, ID


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; local sessions without a shared folder get a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemill-")
    return f"{base.rstrip('/')}/tidemill-{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table in the shared folder: several jobs read it, and a lost executor costs its tasks only."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def read_panel_csv(spark: SparkSession, path: str, columns: list[str], id_pattern: str = r"(F[0-9]+)") -> DataFrame:
    """Semicolon-separated files, one a series: the first column is the time, the series' id comes from the path.

    Time zones are dropped; NaN becomes null; files are appended.
    """
    schema = f"{DS} string, " + ", ".join(f"{c} double" for c in columns)
    raw = spark.read.csv(path, sep=";", header=True, schema=schema, enforceSchema=True)
    local = F.to_timestamp_ntz(F.regexp_replace(F.regexp_replace(DS, "T", " "), r"(Z|[+-][0-9]{2}:?[0-9]{2})$", ""))
    values = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns]
    return raw.select(F.regexp_extract(F.col("_metadata.file_path"), id_pattern, 1).alias(ID), local.alias(DS), *values)


def write_panel(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Write a panel, partitioned by series."""
    writer = df.write.mode("errorifexists").partitionBy(ID)
    writer.option("header", True).option("sep", ";").csv(path) if form == "csv" else writer.parquet(path)


def write_cv_results(cv: DataFrame, path: str) -> None:
    """Append long forecasts, partitioned by model and series."""
    cv.write.mode("append").partitionBy("model", ID).option("compression", "snappy").parquet(path)


def read_cv_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def config_hash(config: Mapping[str, object]) -> str:
    """Digest of parameters that does not depend on their order."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def run_metadata(cv: DataFrame, step: int, seconds: float | None = None, config: Mapping[str, object] | None = None, device: str | None = None, for_cv: bool = True) -> DataFrame:
    """One record a (model, series): windows, step, test span and seconds a fit.

    With ``config``, also the parameters as JSON, their digest for ``resume_windows``, the device, and whether the run is a backtest.
    """
    g = cv.groupBy(ID, "model").agg(F.count_distinct("cutoff").alias("n_windows"), F.min("cutoff").alias("first_cutoff"), F.max(DS).alias("end_test"))
    out = g.select("*", F.lit(step).alias("step_size"), F.lit(seconds).cast("double").alias("avg_el_per_fit"))
    if config is None:
        return out
    text = json.dumps(config, sort_keys=True, default=str)
    return out.select("*", F.lit(text).alias("config"), F.lit(config_hash(config)).alias("config_hash"), F.lit(device).cast("string").alias("device"), F.lit(for_cv).alias("for_cv"))


def check_metadata(records: DataFrame, group: str = ID) -> DataFrame:
    """Groups whose runs disagree on step, windows or end of test, and so must not be compared."""
    counts = records.groupBy(group).agg(*[F.count_distinct(c).alias(c) for c in ("step_size", "n_windows", "end_test")])
    return counts.where("step_size > 1 OR n_windows > 1 OR end_test > 1")
