"""Scalers (H1-H5, H7) as Estimators: fit = one or two aggregate jobs, transform = one projection."""

from __future__ import annotations

from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean, melt, q
from .base import ColumnEstimator, StateModel
from .quantiles import quantiles


class _AffineModel(StateModel):
    """x -> (x - centre) / scale for the fitted columns; other columns untouched."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        st = self.fitted
        out = []
        for f in dataset.schema.fields:
            c = f.name
            if c in st.get("centre", {}) and st["centre"][c] is not None:
                out.append(((clean(c) - F.lit(st["centre"][c])) / F.lit(st["scale"][c])).alias(c))
            else:
                out.append(q(c))
        return dataset.select(*out)

    def inverse(self, dataset: DataFrame) -> DataFrame:
        st = self.fitted
        return dataset.select(
            *[
                (clean(f.name) * F.lit(st["scale"][f.name]) + F.lit(st["centre"][f.name])).alias(f.name)
                if st.get("centre", {}).get(f.name) is not None
                else q(f.name)
                for f in dataset.schema.fields
            ]
        )


class RobustScaler(ColumnEstimator):
    """H1: (x - median) / IQR with interpolated quantiles; IQR 0 divides by 1."""

    def __init__(self, inputCols=None, target=None, exact=None) -> None:
        super().__init__(inputCols=inputCols, target=target, exact=exact)

    def _fit(self, dataset: DataFrame) -> _AffineModel:
        cols = self.cols_for(dataset)
        qs = quantiles(dataset, cols, [0.25, 0.5, 0.75], exact=self.getOrDefault(self.exact))
        centre, scale = {}, {}
        for c in cols:
            q1, med, q3 = qs[c]
            centre[c] = med
            iqr = (q3 - q1) if q1 is not None else None
            scale[c] = iqr if iqr else 1.0
        return RobustScalerModel(state={"centre": centre, "scale": scale})


class RobustScalerModel(_AffineModel):
    pass


class ZScoreScaler(ColumnEstimator):
    """H2: (x - mean) / std (ddof 1); columns with zero or undefined std are skipped."""

    def __init__(self, inputCols=None, target=None) -> None:
        super().__init__(inputCols=inputCols, target=target)

    def _fit(self, dataset: DataFrame) -> _AffineModel:
        cols = self.cols_for(dataset)
        rows = melt(dataset, cols).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).collect()
        centre, scale = {}, {}
        for r in rows:
            if r["s"]:
                centre[cols[r["k"]]] = r["m"]
                scale[cols[r["k"]]] = r["s"]
        return ZScoreModel(state={"centre": centre, "scale": scale})


class ZScoreModel(_AffineModel):
    """Also H7: applied to any scoring frame; columns without statistics pass through."""


class MinMaxScaler(ColumnEstimator):
    """H3: (x - min) / (max - min); constant columns skipped."""

    def __init__(self, inputCols=None, target=None) -> None:
        super().__init__(inputCols=inputCols, target=target)

    def _fit(self, dataset: DataFrame) -> _AffineModel:
        cols = self.cols_for(dataset)
        rows = melt(dataset, cols).groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        centre, scale = {}, {}
        for r in rows:
            if r["lo"] is not None and r["hi"] > r["lo"]:
                centre[cols[r["k"]]] = r["lo"]
                scale[cols[r["k"]]] = r["hi"] - r["lo"]
        return MinMaxModel(state={"centre": centre, "scale": scale})


class MinMaxModel(_AffineModel):
    pass


class MadScaler(ColumnEstimator):
    """H4: (x - median) / median(abs(x - median)); zero MAD skipped."""

    def __init__(self, inputCols=None, target=None, exact=None) -> None:
        super().__init__(inputCols=inputCols, target=target, exact=exact)

    def _fit(self, dataset: DataFrame) -> _AffineModel:
        cols = self.cols_for(dataset)
        ex = self.getOrDefault(self.exact)
        med = {c: v[0] for c, v in quantiles(dataset, cols, [0.5], exact=ex).items()}
        live = [c for c in cols if med[c] is not None]
        dev = dataset.select(*[F.abs(clean(c) - F.lit(med[c])).alias(c) for c in live])
        mad = {c: v[0] for c, v in quantiles(dev, live, [0.5], exact=ex).items()}
        centre = {c: med[c] for c in live if mad[c]}
        scale = {c: mad[c] for c in live if mad[c]}
        return MadModel(state={"centre": centre, "scale": scale})


class MadModel(_AffineModel):
    pass


class LogTransformer(ColumnEstimator):
    """H5: ``log1p`` of listed columns, or of those with abs(skew) > threshold.

    A column whose minimum is <= 0 is first moved to ``x - min + 1``.
    """

    threshold = Param(Params._dummy(), "threshold", "abs skew above which a column is logged", typeConverter=TypeConverters.toFloat)

    def __init__(self, inputCols=None, target=None, threshold=None) -> None:
        super().__init__(inputCols=inputCols, target=target)
        self._setDefault(threshold=1.0)
        if threshold is not None:
            self._set(threshold=threshold)

    def _fit(self, dataset: DataFrame) -> StateModel:
        from .outliers import skew_and_min

        explicit = bool(self.getOrDefault(self.inputCols))
        cols = self.cols_for(dataset)
        sm = skew_and_min(dataset, cols)
        t = self.getOrDefault(self.threshold)
        chosen = [c for c in cols if explicit or (sm[c][0] is not None and abs(sm[c][0]) > t)]
        shift = {c: (1.0 - sm[c][1]) if (sm[c][1] is not None and sm[c][1] <= 0) else 0.0 for c in chosen}
        return LogModel(state={"shift": shift})


class LogModel(StateModel):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        sh = self.fitted["shift"]
        return dataset.select(
            *[F.log1p(clean(f.name) + F.lit(sh[f.name])).alias(f.name) if f.name in sh else q(f.name) for f in dataset.schema.fields]
        )

