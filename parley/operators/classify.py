"""Intent classifier on message vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.clusters import features
from parley.operators.similarity import usable
from parley.session import stage


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights: rows / (classes x rows of the class)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("n"), F.count("*").alias("k"))).scalar()
    return counts.withColumn("t", totals).select(
        label, "n", (F.col("t.n") / (F.col("t.k") * F.col("n"))).alias("weight")
    )


@dataclass(frozen=True)
class Classifier:
    indexer: StringIndexerModel
    model: LogisticRegressionModel

    def predict(self, df: DataFrame, vec: str = "embedding") -> DataFrame:
        """Add ``intent``, ``confidence`` and the ``probabilities`` map, to 4 places.

        Rows without a vector, or with a NaN or null in it, stay and have none of the three.
        """
        known = usable(F.col(vec).cast("array<double>"))
        zero = F.array_repeat(F.lit(0.0), self.model.numFeatures)
        filled = F.when(known, F.col(vec).cast("array<double>")).otherwise(zero)
        shares = F.transform(vector_to_array("probability"), lambda p: F.round(p, 4))
        names = F.array(*[F.lit(name) for name in self.indexer.labels])
        scored = self.model.transform(features(df.withColumn("_vector", filled), "_vector"))
        return (
            scored.withColumns(
                {
                    "intent": F.when(known, names[F.col("prediction").cast("int")]),
                    "confidence": F.when(known, F.array_max(shares)),
                    "probabilities": F.when(known, F.map_from_arrays(names, shares)),
                }
            )
            .drop("_vector", "features", "rawPrediction", "probability", "prediction")
        )


def fit_classifier(
    df: DataFrame, label: str, vec: str = "embedding", c: float = 1.0, max_iter: int = 1000
) -> Classifier:
    """Multinomial logistic regression with balanced classes.

    ``c`` is the inverse penalty on the summed loss; Spark averages the loss, hence 1/(c n).
    """
    named = df.where(F.col(label).isNotNull()).withColumn("_name", F.col(label).cast("string"))
    # Staged, so the planner knows how few the classes are and does not shuffle the rows.
    weights = stage(class_weights(named, "_name").drop("n"))
    weighted = features(named.join(weights, "_name"), vec)
    indexer = StringIndexer(
        inputCol="_name", outputCol="_label", stringOrderType="alphabetAsc"
    ).fit(weighted)
    rows = indexer.transform(weighted).select("features", "_label", "weight")
    model = LogisticRegression(
        labelCol="_label",
        weightCol="weight",
        family="multinomial",
        regParam=1.0 / (c * max(1, rows.count())),
        standardization=False,
        maxIter=max_iter,
    ).fit(rows)
    return Classifier(indexer, model)
