"""Reading and writing tables, reports and fitted models (A1-A10).

CSV/Parquet/JSON through the DataFrame reader and writer; models through
``PipelineModel`` persistence.  Excel and pickle files of the reference are
single-machine formats and are not built.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import q


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None,
               drop: Sequence[str] = (), header: bool = True) -> DataFrame:
    """A1: read with an explicit schema when given, then drop listed columns that exist."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        df = r.option("header", header).option("inferSchema", schema is None).csv(path)
    else:
        df = r.format(fmt).load(path)
    return df.drop(*[c for c in drop if c in df.columns])


def training_frame(df: DataFrame, target: str, features: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """A2: features and target; features default to every numeric column but the target."""
    from ..functions.columns import numeric_columns

    feats = list(features) if features else numeric_columns(df, exclude=[target])
    return df.select(*[q(c) for c in feats], q(target)), feats


def read_feature_list(spark: SparkSession, path: str | None, all_columns: Sequence[str], target: str) -> tuple[list[str], str]:
    """A3: names from ``feature_name`` or ``feature``; all columns but the target when absent or malformed."""
    fallback = [c for c in all_columns if c != target]
    if not path:
        return fallback, "all"
    try:
        t = spark.read.option("header", True).csv(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":  # a missing list means "use all columns"
            return fallback, "all"
        raise
    col = "feature_name" if "feature_name" in t.columns else "feature" if "feature" in t.columns else None
    if col is None:
        return fallback, "all"
    order = "rank" if "rank" in t.columns else None
    rows = (t.orderBy(F.col(order).cast("int")) if order else t).select(col).collect()
    names = [r[0] for r in rows if r[0]]
    return (names, "file") if names else (fallback, "all")


def write_splits(df: DataFrame, path: str, split_col: str = "split", fmt: str = "parquet") -> None:
    """A4: one table partitioned by split (train/test); the full table is the whole directory."""
    df.write.mode("overwrite").partitionBy(split_col).format(fmt).save(path)


def write_selected(df: DataFrame, features: Sequence[str], target: str, path: str, fmt: str = "parquet") -> None:
    """A5: chosen columns plus the target."""
    df.select(*[q(c) for c in features], q(target)).write.mode("overwrite").format(fmt).save(path)


def feature_list_frame(spark: SparkSession, names: Sequence[str], indices: Sequence[int] | None = None) -> DataFrame:
    """(feature_index, feature_name, rank)."""
    idx = list(indices) if indices is not None else list(range(len(names)))
    return spark.createDataFrame([(int(i), n, r + 1) for r, (i, n) in enumerate(zip(idx, names))], "feature_index int, feature_name string, rank int")


def write_report(df: DataFrame, path: str, order: Sequence = (), fmt: str = "csv") -> None:
    """A report table, ordered, as one file (reports are small)."""
    out = df.orderBy(*order) if order else df
    w = out.coalesce(1).write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path))


#: Order of the rows of each result table; tables of other names keep the order of their first column.
RESULT_ORDER = {
    "quality": ["column"],
    "skew_kurtosis": ["column"],
    "outliers": ["column"],
    "validation": ["-mean_r2", "model"],
    "history": ["generation"],
    "importance": ["-importance", "feature_name"],
    "correlation": ["feature_a", "feature_b"],
    "comparison": ["-improvement", "model"],
}


def write_results(tables: dict[str, DataFrame], path: str, fmt: str = "csv") -> None:
    """The result tables of a run, each sorted as ``RESULT_ORDER`` says (``-`` is descending, missing values last).

    Their rows are columns, models or generations, so each is one file.
    """
    for name, df in tables.items():
        order = [F.desc_nulls_last(q(c[1:])) if c.startswith("-") else F.asc_nulls_last(q(c)) for c in RESULT_ORDER.get(name, df.columns[:1])]
        write_report(df, f"{path}/{name}", order, fmt)


def write_json_report(spark: SparkSession, path: str, sections: dict, metadata: dict | None = None) -> None:
    """One JSON line per section (NaN becomes null) plus a metadata line."""
    def clean_value(v):
        if isinstance(v, float) and v != v:
            return None
        if isinstance(v, dict):
            return {k: clean_value(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [clean_value(x) for x in v]
        return v

    rows = [("metadata", json.dumps(clean_value(metadata or {})))] + [(k, json.dumps(clean_value(v))) for k, v in sections.items()]
    spark.createDataFrame(rows, "section string, body string").coalesce(1).write.mode("overwrite").json(path)


def read_json_report(spark: SparkSession, path: str) -> dict:
    return {r["section"]: json.loads(r["body"]) for r in spark.read.json(path).collect()}


def save_model(model: PipelineModel, path: str, metrics: DataFrame | None = None, features: Sequence[str] = (), params: dict | None = None,
               importances: DataFrame | None = None, test: DataFrame | None = None) -> None:
    """The fitted chain with its metrics, feature list, hyper-parameters, importances and test table next to it.

    ``parts`` names what was written and is written last: a part that is not given
    is not loaded again, also where an older model at this path had one.
    """
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    if metrics is not None:
        metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    if features:
        feature_list_frame(spark, list(features)).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/features")
    if params is not None:
        rows = [(k, json.dumps(v)) for k, v in sorted(params.items())]
        spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/params")
    if importances is not None:
        write_report(importances, f"{path}/importances", [F.desc_nulls_last("importance"), F.asc("feature_name")], "parquet")
    if test is not None:
        test.write.mode("overwrite").parquet(f"{path}/test")
    given = {"metrics": metrics is not None, "features": bool(features), "params": params is not None, "importances": importances is not None, "test": test is not None}
    spark.createDataFrame([(k,) for k, there in given.items() if there], "part string").coalesce(1).write.mode("overwrite").json(f"{path}/parts")


def load_model(path: str) -> PipelineModel:
    """A10: the saved chain (scaler stages included, so they cannot go missing)."""
    return PipelineModel.load(f"{path}/model")


def load_saved(path: str) -> dict:
    """A10: model, metrics, features, params, importances and test table as saved; a part that was not saved is None (features: [])."""
    spark = SparkSession.active()
    parts = {r["part"] for r in spark.read.schema("part string").json(f"{path}/parts").collect()}
    return {
        "model": load_model(path),
        "metrics": spark.read.json(f"{path}/metrics") if "metrics" in parts else None,
        "features": read_feature_list(spark, f"{path}/features", [], "")[0] if "features" in parts else [],
        "params": {r["name"]: json.loads(r["value"]) for r in spark.read.schema("name string, value string").json(f"{path}/params").collect()} if "params" in parts else None,
        "importances": spark.read.parquet(f"{path}/importances") if "importances" in parts else None,
        "test": spark.read.parquet(f"{path}/test") if "test" in parts else None,
    }
