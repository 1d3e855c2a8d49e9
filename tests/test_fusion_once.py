"""The fused cases are scored once, however many figures are taken from them."""

import __spark_entry__
from docuvet.operators import evaluation


def test_curves_read_stored_scores(spark, monkeypatch):
    plans, real = [], evaluation.roc_auc

    def seen(scored, label, score):
        plans.append(scored._jdf.queryExecution().optimizedPlan().toString())
        return real(scored, label, score)

    monkeypatch.setattr(evaluation, "roc_auc", seen)
    row = __spark_entry__.queries()["forest_fusion"](spark, "/root/testdata/sf0.001").first()
    assert len(plans) == 2 and not any("EvalPython" in p or "Join" in p for p in plans)
    assert row["contributions_add_up"]
