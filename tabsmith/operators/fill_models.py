"""Gap filling as Estimators (F1-F5, F8-F10): fitted on one table, applied to another.

A fitted model holds its numbers (fill values or coefficients) and, for the
neighbour strategies, the table of donors; ``save`` writes both, the donors as
Parquet, and ``load`` reads them back, so a test table or the batches of a stream
are filled from the training rows alone.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import clean, q
from . import impute
from .knn import knn_average
from .ordering import written

STRATEGIES = ("mean", "median", "mode", "regression", "multi_regression", "knn", "handle")


class _FillParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns to fill", TypeConverters.toListString)
    keyCol = Param(Params._dummy(), "keyCol", "key of a row (neighbour strategies)", TypeConverters.toString)
    strategy = Param(Params._dummy(), "strategy", f"one of {', '.join(STRATEGIES)}", TypeConverters.toString)
    predictor = Param(Params._dummy(), "predictor", "predictor of the first column (regression, handle)", TypeConverters.toString)
    referenceCols = Param(Params._dummy(), "referenceCols", "further coordinates of the neighbour search", TypeConverters.toListString)
    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)

    def _value(self, name: str):
        p = self.getParam(name)
        return self.getOrDefault(p) if self.isDefined(p) else None


class GapFiller(Estimator, _FillParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fills the gaps of ``inputCols``.

    mean, median, mode: the training value.  regression (F1): the first column from
    ``predictor``.  multi_regression (F8): every column from its most correlated
    ones.  knn (F2, F9): the mean of the ``k`` nearest training rows.  handle (F10):
    F1 for the first column, then neighbours over the columns and ``referenceCols``.
    A cell without a neighbour takes the training mean; one without a predictor
    stays missing.
    """

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None, keyCol: str | None = None, strategy: str = "mean",
                 predictor: str | None = None, referenceCols: Sequence[str] = (), k: int = 5):
        super().__init__()
        self._setDefault(strategy="mean", k=5, referenceCols=[])
        self._set(**{n: v for n, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> GapFillerModel:
        cols, how, k = self._value("inputCols"), self._value("strategy"), self._value("k")
        if how not in STRATEGIES:
            raise ValueError(f"unknown strategy {how}")
        state: dict = {"fills": {}, "linear": {}, "coords": []}
        donors = None
        if how in ("mean", "median", "mode"):
            state["fills"] = {"mean": impute.mean_fill, "median": impute.median_fill, "mode": impute.mode_fill}[how](df, cols)[1]
        if how in ("regression", "handle"):
            _, st = impute.regression_fill(df, cols[0], self._value("predictor"))
            if st["slope"] is not None:
                state["linear"][cols[0]] = [float(st["intercept"]), {self._value("predictor"): float(st["slope"])}]
        if how == "multi_regression":
            others = df.drop(self._value("keyCol")) if self._value("keyCol") else df
            for c in cols:
                intercept, coef = impute.multi_regression(others, c)
                state["linear"][c] = [intercept, coef]
        if how in ("knn", "handle"):
            if self._value("keyCol") is None:
                raise ValueError("neighbours need a key column")
            state["coords"] = list(dict.fromkeys([*cols, *self._value("referenceCols")]))
            state["fills"] = impute.mean_fill(df, cols)[1]
            filled = _linear(df, state["linear"])
            donors = written(filled.select(q(self._value("keyCol")), *[clean(c).cast("double").alias(c) for c in state["coords"]]))
        model = GapFillerModel(state, donors)
        return self._copyValues(model)


def _linear(df: DataFrame, models: dict) -> DataFrame:
    """Missing cells whose predictors are all present, from the stored coefficients."""
    for c, (intercept, coef) in models.items():
        pred = F.lit(intercept)
        for name, slope in coef.items():
            pred = pred + F.lit(slope) * clean(name)
        df = df.withColumn(c, F.coalesce(clean(c), pred))
    return df


class GapFillerModel(Model, _FillParams, MLWritable, MLReadable):
    """The fitted numbers and, where neighbours fill, the donors."""

    def __init__(self, state: dict | None = None, donors: DataFrame | None = None):
        super().__init__()
        self.state, self.donors = state or {}, donors

    def _transform(self, df: DataFrame) -> DataFrame:
        df = _linear(df, self.state["linear"])
        if self.donors is not None:
            key, cols = self._value("keyCol"), self._value("inputCols")
            gap = F.greatest(*[clean(c).isNull() for c in cols]) if len(cols) > 1 else clean(cols[0]).isNull()
            # a row is no donor of a value it lacks, so training rows need no exclusion
            got = knn_average(df.filter(gap), self.donors, key, self.state["coords"], cols, k=self._value("k"), same_key=True)
            found = got.groupBy(F.col(key).alias("_key")).agg(F.map_from_entries(F.collect_list(F.struct("target", "value"))).alias("_found"))
            names = df.columns
            df = df.join(found, q(key) == F.col("_key"), "left")
            df = df.select(*[F.coalesce(clean(c), F.col("_found")[c]).alias(c) if c in cols else q(c) for c in names])
        return impute._fill_values(df, self.state["fills"])

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: GapFillerModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.active()
        DefaultParamsWriter.saveMetadata(self.model, path, spark, extraMetadata={"state": json.dumps(self.model.state), "donors": self.model.donors is not None})
        if self.model.donors is not None:
            self.model.donors.write.parquet(f"{path.rstrip('/')}/donors")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> GapFillerModel:
        spark = SparkSession.active()
        meta = DefaultParamsReader.loadMetadata(path, spark)
        donors = spark.read.parquet(f"{path.rstrip('/')}/donors") if meta["donors"] else None
        model = self.cls(json.loads(meta["state"]), donors)
        DefaultParamsReader.getAndSetParams(model, meta)
        return model
