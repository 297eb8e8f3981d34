"""A linear probe: how well a layer of vectors tells labels apart."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def linear_probe(train: DataFrame, test: DataFrame, vector: str, label: str, steps: int = 50) -> DataFrame:
    """One row (accuracy, n): a multinomial regression on arrays of numbers, fitted on ``train``;
    a label that it never saw counts as missed."""
    index = StringIndexer(inputCol=label, outputCol="_y", handleInvalid="keep").fit(train)
    ready = lambda rows: index.transform(rows).withColumn("_x", array_to_vector(F.col(vector).cast("array<double>")))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=steps, regParam=1e-3).fit(ready(train).select("_x", "_y"))
    known = len(index.labels)
    made = model.transform(ready(test)).select(((F.col("prediction") == F.col("_y")) & (F.col("_y") < known)).cast("double").alias("hit"))
    return made.agg(F.coalesce(F.avg("hit"), F.lit(0.0)).alias("accuracy"), F.count("*").alias("n"))
