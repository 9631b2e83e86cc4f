"""Shared Estimator/Model plumbing.

Fitted state is a small JSON document (per-column bounds, centres, scales),
stored as a Param so ``DefaultParamsWritable`` saves it and a fitted chain is
an ordinary ``PipelineModel`` that loads and runs on batches and streams.
"""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable


class HasColumns(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns to process", typeConverter=TypeConverters.toListString)
    target = Param(Params._dummy(), "target", "target column, never transformed", typeConverter=TypeConverters.toString)
    exact = Param(Params._dummy(), "exact", "exact quantiles (else percentile_approx)", typeConverter=TypeConverters.toBoolean)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(inputCols=[], target="", exact=True)

    def cols_for(self, dataset) -> list[str]:
        from ..functions.columns import numeric_columns

        cols = self.getOrDefault(self.inputCols) or numeric_columns(dataset)
        t = self.getOrDefault(self.target)
        return [c for c in cols if c != t]


class StateModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    state = Param(Params._dummy(), "state", "fitted state as JSON", typeConverter=TypeConverters.toString)

    def __init__(self, state: dict | None = None) -> None:
        super().__init__()
        self._setDefault(state="{}")
        if state is not None:
            self._set(state=json.dumps(state))

    @property
    def fitted(self) -> dict:
        return json.loads(self.getOrDefault(self.state))


class ColumnEstimator(Estimator, HasColumns, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator over ``inputCols`` (default: numeric columns minus ``target``)."""

    def __init__(self, **kwargs) -> None:
        super().__init__()
        self._set(**{k: v for k, v in kwargs.items() if v is not None})
