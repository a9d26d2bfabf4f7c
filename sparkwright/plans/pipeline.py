"""The ETL pipeline as a list of stages run by one loop. A stage is a
name, a function from the previous table to the next, and the suffix of the
table it writes; each table is written to the shared dataset folder before the
next stage starts, so lineage is cut there and a lost executor recomputes from
the last written table only. The history is a table under the catalog's root."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cleaning import auto_clean, clean_name
from ..operators.features import generate_features
from ..operators.profile import full_profile
from ..operators.quality import validate_dataset
from ..operators.transform import apply_transformations
from ..sources.catalog import METADATA_SUFFIX, Catalog, ingest_metadata, sanitize_table_name
from ..sources.readers import read_any

HISTORY_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "step", "status", "timestamp", "table_name", "details")])
HISTORY_FOLDER = "_pipeline/history"


@dataclass
class Stage:
    """One step: ``work(table) -> (result, facts)``; facts go into the history."""

    name: str
    suffix: str
    work: Callable[[DataFrame], tuple[DataFrame, dict]]


def cleaning_stage(order_by=None) -> Stage:
    def work(df: DataFrame):
        cleaned, steps = auto_clean(df, order_by=order_by)
        return cleaned, {"cleaning_steps": steps}

    return Stage("cleaning", "_cleaned", work)


def transformation_stage(transformations: list[dict] | None = None) -> Stage:
    facts = {"transformations": transformations or ["auto_dtype_conversion"]}
    return Stage("transformation", "_transformed", lambda df: (apply_transformations(df, transformations), facts))


def feature_stage(numeric_columns=None, date_columns=None, order_by=None) -> Stage:
    def work(df: DataFrame):
        out, new = generate_features(df, numeric_columns, date_columns, order_by=order_by)
        return out, {"new_features": new}

    return Stage("feature_engineering", "_features", work)


class Pipeline:
    def __init__(self, spark: SparkSession, catalog: Catalog | None = None):
        self.spark = spark
        self.catalog = catalog or Catalog(spark)

    # -- history
    def _record(self, step: str, table: str, status: str = "completed", **details) -> None:
        row = (uuid.uuid4().hex[:12], step, status, dt.datetime.now().isoformat(), table, json.dumps(details, default=str))
        one = self.spark.createDataFrame([row], HISTORY_SCHEMA).coalesce(1)
        one.write.mode("append").parquet(f"{self.catalog.root}/{HISTORY_FOLDER}")

    def history_frame(self, last: int = 50) -> DataFrame:
        """The last ``last`` steps, oldest first; they outlive the driver."""
        log = self.spark.read.schema(HISTORY_SCHEMA).parquet(f"{self.catalog.root}/{HISTORY_FOLDER}")
        return log.orderBy(F.desc("timestamp"), "id").limit(last).orderBy("timestamp", "id")

    # -- one stage
    def _run(self, stage: Stage, table: str) -> dict:
        result, facts = stage.work(self.catalog.get(table))
        target = f"{table}{stage.suffix}"
        stored = self.catalog.store(result, target)
        self._record(stage.name, target, **facts)
        return {"status": "success", "table_name": target, "table": stored, **facts}

    def run_ingestion(self, path: str | None = None, df: DataFrame | None = None, name: str | None = None, order_by=None) -> dict:
        """A file by its type, or a frame, becomes a dataset with metadata."""
        if path is None and df is None:
            raise ValueError("give a path or a frame to ingest")
        default = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0] if path else "dataset"
        table, source = sanitize_table_name(name or default), path or "dataframe"
        stored = self.catalog.store(read_any(self.spark, path) if path else df, table)
        self.catalog.store(ingest_metadata(stored, table, source=source, order_by=order_by), table + METADATA_SUFFIX)
        self._record("ingestion", table, source=source)
        return {"status": "success", "table_name": table, "table": stored}

    def run_cleaning(self, table: str, order_by=None) -> dict:
        """E02, with the validation of what it wrote."""
        out = self._run(cleaning_stage(order_by), table)
        return {**out, "validation": validate_dataset(out["table"])}

    def run_transformation(self, table: str, transformations: list[dict] | None = None) -> dict:
        """E03."""
        return self._run(transformation_stage(transformations), table)

    def run_feature_engineering(self, table: str, numeric_columns=None, date_columns=None, order_by=None) -> dict:
        """E04."""
        return self._run(feature_stage(numeric_columns, date_columns, order_by), table)

    def run_full_etl(
        self,
        path: str | None = None,
        df: DataFrame | None = None,
        name: str | None = None,
        run_features: bool = True,
        numeric_columns=None,
        date_columns=None,
        order_by=None,
        profile: bool = True,
    ) -> dict:
        """Ingestion, then the stages one after the other; the final table
        and its profile. A failure is recorded and reported, not raised."""
        done: list[str] = []
        try:
            table = self.run_ingestion(path, df, name)["table_name"]
            done.append("ingestion")
            stages = [cleaning_stage(order_by), transformation_stage()]
            if run_features:  # the cleaning stage renames the columns
                stages.append(feature_stage(numeric_columns, date_columns, [clean_name(c) for c in order_by] if order_by else None))
            for stage in stages:
                table = self._run(stage, table)["table_name"]
                done.append(stage.name)
        except Exception as e:  # noqa: BLE001
            self._record("full_etl", name or "", status="failed", error=str(e))
            return {"status": "failed", "error": str(e), "steps": done}
        final = self.catalog.get(table)
        out = {"status": "success", "final_table": table, "final": final, "steps": done}
        return {**out, "profile": full_profile(final)} if profile else out

    # E07
    def profile_dataset(self, table: str) -> dict:
        return full_profile(self.catalog.get(table))

    def validate_dataset(self, table: str) -> DataFrame:
        return validate_dataset(self.catalog.get(table))
