"""Reconciliation of runs with curves fitted again: what is kept, moved, forced and filled."""

from __future__ import annotations

import numpy as np

from tidewell.operators import reconcile

ROW = "file_name string, entry_id long, peptide string, charge int, decoy boolean, apex double, start double, end double, score double, coelution double, run_precursor_q double, run_peptide_q double, run_protein_q double, exp_precursor_q double, exp_peptide_q double, candidates array<struct<apex:double,start:double,end:double>>"


def test_actions(spark):
    rng, rows, library = np.random.default_rng(2), [], []
    shifts = {"a": 0.0, "b": 0.06, "c": -0.04}  # of what the runs' curves say
    for n in range(40):
        rt = 2.0 + n * 0.7
        library += [(n, f"p{n}", 2, False, 450.0 + n), (n + 1000, f"p{n}", 2, True, 450.0 + n)]
        for run, shift in shifts.items():
            at = float(rt + shift + rng.normal(0, 0.01))
            others = []
            if (n, run) == (5, "b"):  # the wrong peak was taken, the right one is stored with it
                others, at = [(at, at - 0.1, at + 0.1), (at + 5, at + 4.9, at + 5.1)], at + 5
            if (n, run) == (9, "c"):  # no other peak near
                at += 4
            if (n, run) in ((12, "a"), (30, "c")):
                continue
            bad = (n, run) in ((5, "b"), (9, "c"))
            rows.append((run, n, f"p{n}", 2, False, at, at - 0.1, at + 0.1, 3.0, 5.0, 0.5 if bad else 0.001, 0.5 if bad else 0.001, 1.0, 0.5 if bad else 0.001, 0.5 if bad else 0.001, others))
    df = spark.createDataFrame(rows, ROW)
    curves = spark.createDataFrame([(r, [0.0, 40.0], [0.0, 40.0], 0.3) for r in shifts], "file_name string, knots array<double>, fitted array<double>, mad double")
    lib = spark.createDataFrame(library, "entry_id long, peptide string, charge int, decoy boolean, precursor_mz double")
    windows = spark.createDataFrame([("a", 400.0, 500.0), ("b", 400.0, 500.0), ("c", 400.0, 460.0)], "file_name string, low double, high double")
    got = {(r.file_name, r.entry_id): r for r in reconcile.reconcile(df, curves, lib, windows).collect()}
    odd = {k: v.action for k, v in got.items() if v.action != "keep"}
    assert odd == {("b", 5): "move", ("c", 9): "force", ("a", 12): "fill", ("a", 1012): "fill"}  # run c doesn't select p30
    place = lambda n, run: 2.0 + n * 0.7 + shifts[run]
    assert abs(got["b", 5].apex - place(5, "b")) < 0.1 and abs(got["c", 9].apex - place(9, "c")) < 0.15 and abs(got["a", 12].apex - place(12, "a")) < 0.15
    assert abs(got["c", 9].end - got["c", 9].start - 0.2) < 1e-6 and len(got) == len(rows) + 2
    # the fitted curves take the runs' shifts in, the given ones don't
    plain = {(r.file_name, r.entry_id): r for r in reconcile.reconcile(df, curves, lib, windows, refit=False).collect()}
    assert abs(plain["a", 12].apex - place(12, "a")) < 0.7 and plain["b", 5].action in ("move", "force")
    assert reconcile.reconcile(df.limit(0), curves, lib, windows, refit=False).count() == 0
