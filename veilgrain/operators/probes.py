"""Inferability probes. Only metrics leave a probe, never labels or predictions per person."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrain.functions.noise import keyed_uniform
from veilgrain.operators.bounding import balanced_sample


def logistic_probe(spark: SparkSession, df: DataFrame, inputs: Sequence[str], label: str, id_col: str,
                   feature_id: str, attr: str, per_class: int, max_iter: int = 20) -> DataFrame:
    """Train on 70% of a balanced keyed sample of at most ``per_class`` rows per class; exact AUC of all other rows.

    One row: feature_id, attr, auc, n_train, n_held_out.
    """
    seed = f"{feature_id}|{attr}"
    rows = df.select(id_col, label, *inputs)
    sample = balanced_sample(rows, label, id_col, per_class, seed)
    train = sample.filter(keyed_uniform(seed, "split", F.col(id_col)) < 0.7).select(id_col, F.lit(True).alias("_train"))
    split = rows.join(train, id_col, "left").withColumn("_train", F.coalesce("_train", F.lit(False)))
    vectors = VectorAssembler(inputCols=list(inputs), outputCol="features").transform(split).persist()
    try:
        model = LogisticRegression(labelCol=label, featuresCol="features", maxIter=max_iter).fit(vectors.filter("_train"))
        exact = BinaryClassificationEvaluator(labelCol=label, numBins=0)
        auc = exact.evaluate(model.transform(vectors.filter("NOT _train")))
        n_train, n_held_out = vectors.agg(F.count_if("_train"), F.count_if(~F.col("_train"))).first()
    finally:
        vectors.unpersist()
    return spark.range(1).select(
        F.lit(feature_id).alias("feature_id"), F.lit(attr).alias("attr"), F.lit(auc).alias("auc"),
        F.lit(n_train).cast("bigint").alias("n_train"), F.lit(n_held_out).cast("bigint").alias("n_held_out"),
    )
