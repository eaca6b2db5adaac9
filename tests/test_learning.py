"""Text models: what is worked out once, and fits side by side."""

import threading

from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from quillrisk.operators import learning


def vectors(spark, n=60):
    rows = [(i, Vectors.sparse(4, {i % 2: 1.0, 2 + i % 3 % 2: 0.5}), "ab"[i % 2], i // 4) for i in range(n)]
    return spark.createDataFrame(rows, ["id", "features", "label", "grp"])


def test_tokens_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def cut(text):
        seen.add(1)
        return text.split()

    docs = spark.createDataFrame([(i, f"the word{i % 5}") for i in range(40)], "id long, text string")
    assert len(learning.embed(docs.select("id", cut("text").alias("tokens")), "id", "tokens").collect()) == 40
    assert seen.value == 40


def test_fits_run_side_by_side_with_the_results_of_one_after_the_other(spark, monkeypatch):
    rows, logistic = vectors(spark), learning._logistic
    known = learning._indexed(rows, "label")[0].withColumn("weight", F.lit(1.0))
    alone = [logistic(c, 60).fit(known.where(F.col("grp") % 2 == k)).coefficientMatrix.toArray() for c, k in ((4.0, 0), (0.25, 1))]
    both = learning._fitted(known, [(F.col("grp") % 2 == k, c) for c, k in ((4.0, 0), (0.25, 1))])
    assert all(abs(m.coefficientMatrix.toArray() - a).max() < 1e-6 for m, a in zip(both, alone))

    meet = threading.Barrier(2, timeout=60)

    class Waits:
        def __init__(self, c, n):
            self.model = logistic(c, n)

        def fit(self, train):
            meet.wait()  # breaks unless a second fit has begun
            return self.model.fit(train)

    monkeypatch.setattr(learning, "_logistic", Waits)
    assert learning.cross_validate(rows, "label", "grp", {"a": 4.0, "b": 0.25}, seeds=1).count() == 6
    assert learning.train_classifier(rows, "label", "grp").labels == ["a", "b"]
