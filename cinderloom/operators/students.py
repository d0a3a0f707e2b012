"""Stand-ins for external models: hashed n-gram logistic regression as a student plug-in."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderloom.functions.scalars import argmax, entropy
from cinderloom.operators.loop import register_student
from cinderloom.operators.predictions import classification_metrics


@register_student("hashed_logistic")
class HashedLogistic:
    """Rows have id, text and class_id."""

    def __init__(self, features: int = 4096, iterations: int = 20):
        self.features, self.iterations = features, iterations

    def train(self, rows: DataFrame):
        words = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\W+")
        counts = HashingTF(inputCol="words", outputCol="features", numFeatures=self.features)
        model = LogisticRegression(featuresCol="features", labelCol="y", maxIter=self.iterations, regParam=0.01)
        return Pipeline(stages=[words, counts, model]).fit(rows.where("class_id is not null").select("text", F.col("class_id").cast("double").alias("y")))

    def predict(self, model, rows: DataFrame) -> DataFrame:
        p = model.transform(rows).select("*", vector_to_array("probability").alias("p"))
        return p.select(F.col("id").alias("idx"), argmax(F.col("p")).alias("pred"), F.col("class_id").cast("int").alias("true"), F.array_max("p").alias("conf"), entropy(F.col("p")).alias("entropy"))

    def evaluate(self, model, rows: DataFrame) -> dict[str, float]:
        pred = self.predict(model, rows)
        m, e = classification_metrics(pred).first(), pred.agg(F.avg("entropy")).first()[0]
        return {"accuracy": m.accuracy, "f1": m.f1, "entropy": e}
