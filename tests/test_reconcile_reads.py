"""Detections are made once, however often reconciliation reads them."""

from __future__ import annotations

from tidewell.plans import runs


def test_detections_are_made_once(spark, monkeypatch):
    seen, plain = [], runs.reconcile.reconcile
    monkeypatch.setattr(runs.reconcile, "reconcile", lambda rows, *a, **k: seen.append(rows) or plain(rows, *a, **k))
    out = runs.reconciled(spark, "/root/testdata/sf0.001")
    assert len(seen[0].inputFiles()) > 0 and not any("lineitem" in f for f in [*seen[0].inputFiles(), *out.inputFiles()])
    assert "Aggregate" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
