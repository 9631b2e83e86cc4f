"""Skew-aware clipping and outlier masks.

Fitting costs three aggregate jobs whatever the column count: skew and
min per column (long form), quantiles of the raw or log-shifted values, and
(when a summary is wanted) one conditional count.  The transform is a single
narrow projection of ``least/greatest`` with literal bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bands
from ..functions.columns import clean, explode_structs, melt, name_of, q
from ..functions.stats import skew_sample
from .base import ColumnEstimator, StateModel
from .quantiles import quantiles

# Fixed values from the reference configuration (percent ranges per class).
LIGHT_RANGE = (5.0, 95.0)
MODERATE_RANGE = (10.0, 90.0)
HEAVY_RANGE = (5.0, 95.0)
HEAVY_SHIFT_EPS = 1e-6


def skew_and_min(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    """{column: (bias-adjusted skew, min)} from one long-form aggregate."""
    v = F.col("v")
    rows = melt(df, cols).groupBy("k").agg(skew_sample(v).alias("s"), F.min(v).alias("m")).collect()
    out = {c: (None, None) for c in cols}
    for r in rows:
        out[cols[r["k"]]] = (r["s"], r["m"])
    return out


class SkewClipper(ColumnEstimator):
    """Clip each column at percentiles chosen by its skew class.

    light (abs skew < 1): 5-95; moderate (< 2): 10-90; heavy: shift to
    positive when min <= 0, ``log1p``, clip 5-95 in log space, ``expm1``; the
    shift stays in the output, as in the reference.
    """

    lightRange = Param(Params._dummy(), "lightRange", "percent range for light skew", typeConverter=TypeConverters.toListFloat)
    moderateRange = Param(Params._dummy(), "moderateRange", "percent range for moderate skew", typeConverter=TypeConverters.toListFloat)
    heavyRange = Param(Params._dummy(), "heavyRange", "percent range for heavy skew (log space)", typeConverter=TypeConverters.toListFloat)

    def __init__(self, inputCols=None, target=None, exact=None, lightRange=None, moderateRange=None, heavyRange=None) -> None:
        super().__init__()
        self._setDefault(lightRange=list(LIGHT_RANGE), moderateRange=list(MODERATE_RANGE), heavyRange=list(HEAVY_RANGE))
        self._set(**{k: v for k, v in dict(inputCols=inputCols, target=target, exact=exact, lightRange=lightRange,
                                          moderateRange=moderateRange, heavyRange=heavyRange).items() if v is not None})

    def _fit(self, dataset: DataFrame) -> SkewClipModel:
        cols = self.cols_for(dataset)
        sm = skew_and_min(dataset, cols)
        ranges = {
            "light_skew": self.getOrDefault(self.lightRange),
            "moderate_skew": self.getOrDefault(self.moderateRange),
            "heavy_skew": self.getOrDefault(self.heavyRange),
        }
        spec = {}
        for c in cols:
            s, mn = sm[c]
            a = abs(s) if s is not None else 0.0
            cls = "light_skew" if a < 1 else "moderate_skew" if a < 2 else "heavy_skew"
            shift = (abs(mn) + HEAVY_SHIFT_EPS) if (cls == "heavy_skew" and mn is not None and mn <= 0) else 0.0
            spec[c] = {"class": cls, "skew": s, "shift": shift}
        # one quantile job for every column: heavy columns are measured in log space
        probe = dataset.select(
            *[(F.log1p(clean(c) + F.lit(spec[c]["shift"])) if spec[c]["class"] == "heavy_skew" else clean(c)).alias(c) for c in cols]
        )
        probs = sorted({p / 100.0 for r in ranges.values() for p in r})
        qs = quantiles(probe, cols, probs, exact=self.getOrDefault(self.exact))
        for c in cols:
            lo_p, hi_p = ranges[spec[c]["class"]]
            vals = qs[c]
            spec[c]["lo"] = vals[probs.index(lo_p / 100.0)]
            spec[c]["hi"] = vals[probs.index(hi_p / 100.0)]
        return SkewClipModel(state={"cols": cols, "spec": spec})


class SkewClipModel(StateModel):
    def _space(self, c: str) -> Column:
        s = self.fitted["spec"][c]
        v = clean(c)
        return F.log1p(v + F.lit(s["shift"])) if s["class"] == "heavy_skew" else v

    def _transform(self, dataset: DataFrame) -> DataFrame:
        st = self.fitted
        out = []
        for f in dataset.schema.fields:
            c = f.name
            if c in st["spec"] and st["spec"][c]["lo"] is not None:
                s = st["spec"][c]
                x = F.least(F.greatest(self._space(c), F.lit(s["lo"])), F.lit(s["hi"]))
                if s["class"] == "heavy_skew":
                    x = F.expm1(x)
                out.append(x.alias(c))
            else:
                out.append(q(c))
        return dataset.select(*out)

    def summary(self, dataset: DataFrame) -> DataFrame:
        """feature, class, skew, cells outside the bounds (strict), one scan."""
        st = self.fitted
        structs = []
        for c in st["cols"]:
            s = st["spec"][c]
            x = self._space(c)
            n = F.count(F.when((x < F.lit(s["lo"])) | (x > F.lit(s["hi"])), 1)) if s["lo"] is not None else F.lit(0).cast("long")
            structs.append(
                F.struct(
                    F.lit(c).alias("feature"),
                    F.lit(s["class"]).alias("skew_class"),
                    F.lit(s["skew"]).cast("double").alias("skewness"),
                    F.lit(s["lo"]).cast("double").alias("lower"),
                    F.lit(s["hi"]).cast("double").alias("upper"),
                    n.alias("clipped"),
                )
            )
        return explode_structs(dataset, structs)


def iqr_bounds(df: DataFrame, cols: Sequence[str], multiplier: float = 1.5, exact: bool = True) -> dict[str, tuple]:
    """G4 bounds: [Q1 - m IQR, Q3 + m IQR] per column."""
    qs = quantiles(df, cols, [0.25, 0.75], exact=exact)
    out = {}
    for c in cols:
        q1, q3 = qs[c]
        out[c] = (None, None) if q1 is None else (q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1))
    return out


def iqr_mask(df: DataFrame, col: str, multiplier: float = 1.5, exact: bool = True, name: str = "is_outlier") -> DataFrame:
    """Boolean column ``name`` marking values outside the IQR fences."""
    lo, hi = iqr_bounds(df, [col], multiplier, exact)[col]
    v = clean(col)
    flag = F.lit(False) if lo is None else F.coalesce((v < F.lit(lo)) | (v > F.lit(hi)), F.lit(False))
    return df.withColumn(name, flag)


def zscore_mask(df: DataFrame, col: str, threshold: float = 3.0, name: str = "is_outlier") -> DataFrame:
    """abs((x - mean) / std_ddof1) > threshold; NULL or zero std -> False."""
    r = df.agg(F.avg(clean(col)).alias("m"), F.stddev_samp(clean(col)).alias("s")).first()
    if r["s"] is None or r["s"] == 0:
        return df.withColumn(name, F.lit(False))
    z = F.abs((clean(col) - F.lit(r["m"])) / F.lit(r["s"]))
    return df.withColumn(name, F.coalesce(z > F.lit(threshold), F.lit(False)))


def outlier_statistics(df: DataFrame, cols: Sequence[str], multiplier: float = 1.5, threshold: float = 3.0, exact: bool = True) -> DataFrame:
    """Per column IQR and z-score outlier counts, IQR bounds, non-null rows.

    Fitted pieces (quartiles, mean/std) are two small jobs; the counts are one
    conditional aggregate over the long form.
    """
    cols = list(cols)
    b = iqr_bounds(df, cols, multiplier, exact)
    ms = {r["k"]: (r["m"], r["s"]) for r in melt(df, cols).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).collect()}

    def arr(vals):
        return F.element_at(F.array(*[F.lit(x).cast("double") for x in vals]), F.col("k") + 1)

    lo = arr([b[c][0] for c in cols])
    hi = arr([b[c][1] for c in cols])
    mean = arr([ms.get(i, (None, None))[0] for i in range(len(cols))])
    std = arr([ms.get(i, (None, None))[1] for i in range(len(cols))])
    v = F.col("v")
    z_out = F.when(std > 0, F.abs((v - mean) / std) > threshold)
    return (
        melt(df, cols)
        .groupBy("k")
        .agg(
            F.count(F.when((v < lo) | (v > hi), 1)).alias("iqr_outliers"),
            F.count(F.when(z_out, 1)).alias("zscore_outliers"),
            F.count(v).alias("non_null"),
        )
        .select(name_of(cols).alias("column"), lo.alias("iqr_lower"), hi.alias("iqr_upper"), "iqr_outliers", "zscore_outliers", "non_null")
    )


def clip_class(skew: Column) -> Column:
    """D4 as a column expression."""
    return bands.clip_class(skew)
