"""Boosted trees: quantile coverage, exact contributions, list-wise ranking, rows without labels or values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import boosting as bo


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 2))
    y = 2 * (x[:, 0] > 0) + rng.normal(size=2000) * (1 + (x[:, 1] > 0))
    data = [(i, float(a), None if i % 50 == 0 else float(b), None if i % 97 == 5 else float(v)) for i, ((a, b), v) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id long, a double, b double, y double").withColumn("is_train", F.col("id") % 4 != 0)


def test_quantiles_cover_and_stop(rows):
    model = bo.fit(rows, ["a", "b"], "y", bo.Pinball((0.1, 0.9)), iterations=6, depth=2)
    for losses, kept, trees in zip(model.losses, model.rounds, model.trees):
        assert losses[kept] == min(losses) < 0.9 * losses[0] and len(trees) == kept
    held = rows.where("not is_train and y is not null").withColumn("s", bo.predict(model))
    low, high = held.select(*[F.avg((F.col("y") < F.col("s")[i]).cast("double")) for i in (0, 1)]).first()
    assert abs(low - 0.1) < 0.05 and abs(high - 0.9) < 0.05


def test_contributions_add_up_to_the_margin(rows):
    labelled = rows.withColumn("label", (F.col("y") > 1).cast("int"))
    model = bo.fit(labelled, ["a", "b"], "label", bo.Logistic(), iterations=5, depth=3)
    parts = F.aggregate(bo.explain(model), F.lit(0.0), lambda s, v: s + v)
    assert rows.select(F.max(F.abs(parts - bo.predict(model)[0]))).first()[0] < 1e-9
    assert bo.fit(labelled.where("false"), ["a"], "label", bo.Logistic(), iterations=2).trees == [[]]


def test_lists_are_ranked(rows):
    lists = rows.where("y is not null").withColumns({
        "g": F.col("id") % 80, "rel": F.when(F.col("y") > 2.5, 2).when(F.col("y") > 1, 1).otherwise(0),
    }).withColumn("is_train", F.col("g") % 4 != 0)
    model = bo.fit(lists, ["a", "b"], "rel", bo.Lambda(), group=["g"], iterations=4, depth=2)
    assert min(model.losses[0]) < model.losses[0][0]


def test_lambda_gradients_raise_what_is_relevant():
    g, h = bo.Lambda(k=3).gradients(np.array([2.0, 0.0, 1.0, 0.0]), np.array([[0.0], [3.0], [1.0], [2.0]]), np.array([4]))
    assert g[0, 0] > 0 > g[1, 0] and abs(g.sum()) < 1e-9 and (h > 0).all()
