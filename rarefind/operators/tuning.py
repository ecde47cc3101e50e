"""The search's parts as Spark ML stages, for pipelines and Spark's own ``CrossValidator``.

``UndersampledEstimator`` draws negatives when it fits and leaves rows alone when its model scores, and
``CorrectedF1Evaluator`` scores a validation fold. With ``foldCol`` set to the column of ``assign_folds``, a
cross-validation over rates and parameters makes the choice that ``search.tune_imbalanced`` makes, at the price of reading
the rows once for each trial.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefind.functions.metrics import corrected_f1
from rarefind.operators.sample import undersample_negatives


class UndersampledEstimator(Estimator, HasLabelCol, MLReadable, MLWritable):
    """Fits another estimator on all positives and a share ``rate`` of the negatives, drawn by the hash of ``keys``.

    The model is the inner estimator's own, so nothing is drawn from what it scores. Parameter maps may name parameters
    of both. Labels are 1 and 0; rows with any other label take no part in the fit.
    """

    rate = Param(Params._dummy(), "rate", "share of the negatives that the fit sees", TypeConverters.toFloat)
    keys = Param(Params._dummy(), "keys", "columns whose hash draws the negatives", TypeConverters.toListString)

    def __init__(self, estimator: Estimator, keys: Sequence[str], rate: float = 1.0, labelCol: str = "label"):
        super().__init__()
        self._estimator = estimator
        self._set(keys=list(keys), rate=rate, labelCol=labelCol)

    def getEstimator(self) -> Estimator:
        return self._estimator

    def getRate(self) -> float:
        return self.getOrDefault(self.rate)

    def copy(self, extra: dict | None = None) -> UndersampledEstimator:
        extra = extra or {}
        that = super().copy({p: v for p, v in extra.items() if p.parent == self.uid})
        that._estimator = self._estimator.copy({p: v for p, v in extra.items() if p.parent != self.uid})
        return that

    def _fit(self, dataset: DataFrame) -> Model:
        drawn = undersample_negatives(
            dataset, self.getRate(), self.getOrDefault(self.keys), label=self.getLabelCol()
        )
        return self._estimator.fit(drawn)

    def write(self) -> MLWriter:
        return _UndersampledWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _UndersampledReader()


class _UndersampledWriter(MLWriter):
    def __init__(self, instance: UndersampledEstimator):
        super().__init__()
        self._instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self._instance, path, self.sparkSession)
        self._instance.getEstimator().write().save(f"{path}/estimator")


class _UndersampledReader(MLReader):
    def load(self, path: str) -> UndersampledEstimator:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        inner = DefaultParamsReader.loadParamsInstance(f"{path}/estimator", self.sparkSession)
        out = UndersampledEstimator(inner, metadata["paramMap"]["keys"])
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        return out


class CorrectedF1Evaluator(Evaluator, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """F1 of label 1 with the precision carried over by ``fpScale``; 1 for rows in their true balance."""

    fpScale = Param(Params._dummy(), "fpScale", "what a false positive stands for", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, labelCol: str = "label", predictionCol: str = "prediction", fpScale: float = 1.0):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(fpScale=1.0)

    def _evaluate(self, dataset: DataFrame) -> float:
        label, prediction = F.col(self.getLabelCol()), F.col(self.getPredictionCol())
        counts = dataset.agg(
            F.count_if((label == 1) & (prediction == 1)).alias("tp"),
            F.count_if((label == 0) & (prediction == 1)).alias("fp"),
            F.count_if((label == 1) & (prediction == 0)).alias("fn"),
        )
        scale = self.getOrDefault(self.fpScale)
        return counts.select(corrected_f1(F.col("tp"), F.col("fp"), F.col("fn"), scale)).first()[0]

    def isLargerBetter(self) -> bool:
        return True
