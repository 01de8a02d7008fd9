"""Boosted-tree scoring of rows against a label, with q-values on the scores."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fdr import storey_q
from ..operators.lineage import cut


def boosted_scores(rows: DataFrame, features: list[str], label: str, row_id: str, rounds: int = 8, seed: int = 7) -> DataFrame:
    """row id, score and q_value. Trained on the rows whose id's hash is even, applied to all; label 0 is the decoy."""
    # A few numbers a row, written once: the scaler, each step of the trees and both reads of the scores would compute them from the texts again.
    x = cut(VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip").transform(rows.withColumn("label", F.col(label).cast("double")).select(*dict.fromkeys([row_id, label, "label", *features]))))
    x = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(x).transform(x)
    model = GBTClassifier(maxIter=rounds, maxDepth=3, seed=seed).fit(x.where(F.pmod(F.xxhash64(row_id), F.lit(2)) == 0))
    scored = cut(model.transform(x).select(row_id, label, F.round(vector_to_array("probability")[1], 6).alias("score")))
    q = storey_q(scored, "score", F.col(label) == 0).select("score", "q_value")
    return scored.join(q, "score").select(row_id, "score", "q_value")
