import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tonelake.operators import newton
from tonelake.operators import training as tr


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (400, 6))
    y = (x @ [2, -1, 0.5, 0, 0, 0] + rng.normal(0, 1, 400) > 1).astype(int)
    rows = [(Vectors.dense(a), int(b)) for a, b in zip(x, y, strict=True)]
    return spark.createDataFrame(rows, ["features", "label"]).repartition(5)


@pytest.mark.parametrize("fan_in", [32, 2])
def test_same_optimum_as_the_estimator(spark, data, monkeypatch, fan_in):
    monkeypatch.setattr(newton, "FAN_IN", fan_in)
    monkeypatch.setattr(tr, "ROWS_PER_TASK", 50)
    for weights in ("balanced", {0: 1.0, 1: 3.0}, None):
        want = tr.fit_logistic(data, class_weight=weights, tol=1e-12, C=0.5)
        got = tr.fit_logistic(data, class_weight=weights, tol=1e-10, C=0.5, solver="newton")
        assert got.coefficients.toArray() == pytest.approx(want.coefficients.toArray(), abs=1e-5)
        assert got.intercept == pytest.approx(want.intercept, abs=1e-5)
    a, b = (m.transform(data).select("prediction").collect() for m in (got, want))
    assert a == b


def test_separable_rows_and_wrong_input(spark, data):
    rows = [(Vectors.dense([float(i)]), int(i > 4)) for i in range(10)]
    df = spark.createDataFrame(rows, ["features", "label"])
    model = tr.fit_sentiment(df, "features", solver="newton", C=1e6)
    assert tr.predict(model, df).filter("prediction = label").count() == 10
    with pytest.raises(ValueError, match="solver"):
        tr.fit_logistic(data, solver="saga")
    with pytest.raises(ValueError, match="labels 0 and 1"):
        tr.fit_logistic(df.selectExpr("features", "label + 1 AS label"), solver="newton")
    wide = spark.createDataFrame([(Vectors.sparse(5000, {1: 1.0}), 0), (Vectors.sparse(5000, {2: 1.0}), 1)], ["features", "label"])
    with pytest.raises(ValueError, match="1024 features"):
        tr.fit_logistic(wide, solver="newton")
