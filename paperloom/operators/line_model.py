"""A trained classifier of lines over their features; ``unknown`` where there is none."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def _featured(lines: DataFrame) -> tuple[DataFrame, list[str]]:
    made = T.line_features(F.col("line"))
    names = [f"__{k}" for k in made]
    return lines.select("*", *[c.cast("double").alias(f"__{k}") for k, c in made.items()]), names


def train(lines: DataFrame, label: str = "corrected_label") -> PipelineModel:
    """A model from (line, label); lines without a label are left out."""
    featured, names = _featured(lines.where(F.coalesce(F.col(label), F.lit("")) != ""))
    index = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc").fit(featured)
    stages = [index, VectorAssembler(inputCols=names, outputCol="__x"), LogisticRegression(featuresCol="__x", labelCol="__y", predictionCol="__p", probabilityCol="__q", rawPredictionCol="__r", regParam=0.01)]
    model = Pipeline(stages=stages).fit(featured)
    return PipelineModel([*model.stages[1:], IndexToString(inputCol="__p", outputCol="label", labels=index.labels)])


def load(path: str) -> PipelineModel | None:
    """The saved model, or none if nothing can be read there."""
    try:
        return PipelineModel.load(path)
    except Exception:
        return None


def predict(lines: DataFrame, model: PipelineModel | None) -> DataFrame:
    """lines with label."""
    if model is None:
        return lines.withColumn("label", F.lit("unknown"))
    featured, _ = _featured(lines)
    made = model.transform(featured)
    return made.select(*lines.columns, "label")
