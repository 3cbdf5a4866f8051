"""The whole job over simulated runs."""

from __future__ import annotations

from test_calibration import ENTRY, SPECTRUM, simulated, warp

from tidewell import job
from tidewell.operators import apex, calibration


def test_search_to_report(spark, tmp_path):
    entries, spectra = simulated(40)
    spark.createDataFrame(entries, ENTRY).write.parquet(str(tmp_path / "entries.parquet"))
    spark.createDataFrame(spectra, SPECTRUM).write.parquet(str(tmp_path / "spectra.parquet"))
    settings = calibration.Settings(sample=0, enough=25, fewest=20, threshold=0.06, narrowest=0.7)
    ask = lambda s: job.run(spark, str(tmp_path / "spectra.parquet"), str(tmp_path / "entries.parquet"), str(tmp_path / "job"), s)
    found, ran = ask(settings)
    assert ran == ["spectra", "surveys", "entries", "curves", "matches", "rated", "report"]
    times = {e[1]: e[3] for e in entries if not e[5]}
    rows = found.collect()
    assert {r.file_name for r in rows} == {"a", "b"} and len({r.base for r in rows}) >= 36
    assert all(abs(r.apex_rt - warp(times[r.base])) < 0.2 and r.start_rt <= r.apex_rt <= r.end_rt and r.n_runs == 2 for r in rows)
    assert sum(r.exp_q < 1 for r in rows) >= 36 and all(0 <= r.pep <= 1 for r in rows)
    matches = spark.read.parquet(str(next((tmp_path / "job").glob("matches-*"))))
    assert set(apex.MODEL_FEATURES) <= set(matches.columns) and matches.filter("xcorr IS NULL OR explained IS NULL").count() == 0
    assert matches.filter("NOT decoy AND xcorr > 0.1 AND explained > 0.2").count() >= 72
    assert ask(settings)[1] == []
