"""Training and scoring passes at larger sizes."""

import numpy as np
import pytest

from flowsieve.operators import dense_net as dn
from flowsieve.plans import queries_ml

from test_findings_r03 import events, plan_of


@pytest.mark.parametrize("loss", ["logistic", "squares"])
def test_blocks_share_their_arrays(loss):
    """Blocks of other sizes, one after the other in the same arrays."""
    rng = np.random.default_rng(3)
    net = dn.new_network(dn.classifier_layers((9, 5), 0.3) if loss == "logistic" else dn.autoencoder_layers(4, 2, (6, 5), 0.3), 4, loss)
    space = dn.Space()
    for i, n in enumerate((20, 31, 1, 7, 31)):
        x, y = rng.standard_normal((n, 4)), rng.integers(0, 2, n).astype(float)
        alone, shared = dn.block_gradient(net, x, y, (1, 2, i)), dn.block_gradient(net, x, y, (1, 2, i), space)
        assert alone[0] == shared[0] and (alone[1] == shared[1]).all() and (alone[2] == shared[2]).all()
        assert (dn.forward(net, x)[0] == dn.forward(net, x, space=space)[0]).all()


def test_scores_of_many_rows_are_those_of_each(spark):
    """More rows than are scored together."""
    from pyspark.sql import functions as F

    net = dn.new_network(dn.classifier_layers((5,)), 2, "logistic")
    rows = spark.range(0, 2 * dn.SCORED_ROWS + 9, 1, 1).select(F.col("id"), F.array(F.col("id") / 100.0, F.lit(1.0)).alias("x"))
    got = {r.id: (r.x, r.p) for r in rows.select("id", "x", dn.network_output(spark, net, F.col("x")).alias("p")).collect()}
    assert len(got) == 2 * dn.SCORED_ROWS + 9
    assert all(p == pytest.approx(float(dn.sigmoid(dn.forward(net, np.array([x]))[0])[0, 0]), abs=1e-12) for x, p in got.values())


@pytest.mark.parametrize("query", ["q_train_score_eval", "q_dense_detector"])
def test_rows_are_scored_once_for_all_metrics(spark, tmpdir_path, monkeypatch, query):
    events(spark, 400).write.parquet(f"{tmpdir_path}/events.parquet")
    monkeypatch.setattr(queries_ml, "DETECTOR_TRAINING", queries_ml.TrainConfig(epochs=1, steps=2))
    out = getattr(queries_ml, query)(spark, tmpdir_path, **({"max_iter": 2} if query == "q_train_score_eval" else {}))
    assert "UDF" not in plan_of(out) and "output(" not in plan_of(out)
    got = {r.metric: r.value for r in out.collect()}
    assert got["n_test"] == 80 and 0 <= got["accuracy"] <= 1 and 0 <= got["roc_auc"] <= 1 and got["log_loss"] > 0
