"""The command line's parts that need no cluster, and a small suite."""

import json

import pytest

from thicket.__main__ import configurations, main, parser
from thicket.plans import evaluate as E
from thicket.queries import fixed_model, synthetic_suite
from thicket.sources import persist


def test_lists_and_inspects(capsys, tmp_path):
    assert main(["list", "models"]) == 0
    assert capsys.readouterr().out.split() == ["gbdt", "gblinear", "linear_trees"]
    persist.save(fixed_model(), tmp_path / "m.bin")
    assert main(["inspect", str(tmp_path / "m.bin")]) == 0
    assert json.loads(capsys.readouterr().out)["model_type"] == "gbdt"
    with pytest.raises(SystemExit):
        parser().parse_args(["suite", "unknown"])


def test_configurations_resolve():
    found = configurations()
    assert len(found) == 18
    c = found["synthetic_reg_small/gbdt"]
    s = E.suite("minimal", [c])
    assert E.resolved(c, s)["n_estimators"] == 10 and E.resolved(c, s, n_estimators=3)["n_estimators"] == 3
    assert [x.settings["max_depth"] for x in E.ablation("depth", c)] == [4, 6, 8]
    assert E.run_seed(1, "a", "b") == E.run_seed(1, "a", "b") != E.run_seed(2, "a", "b")


def test_suite_baseline_and_files(spark, tmp_path):
    rows = synthetic_suite(spark, "").collect()
    assert all(r.error is None and r.metrics for r in rows)
    results = spark.createDataFrame([(r.config, "own", r.seed, "regression", "gbdt", r.config, r.metrics, 0.1, 0.1, None) for r in rows], E.RESULTS)
    E.write_results(results, f"{tmp_path}/r")
    again = E.read_results(spark, f"{tmp_path}/r")
    E.record_baseline(again, f"{tmp_path}/b.json")
    checked = E.check_baseline(again, E.load_baseline(f"{tmp_path}/b.json")).collect()
    assert checked and not any(r.regressed for r in checked)
    assert "**" in E.markdown(E.summary(again)) and f"spark: {spark.version}" in E.report(E.summary(again))


def test_runners_can_be_registered(spark):
    from thicket.sources import synthetic
    from thicket.sources.dataset import Dataset

    @E.runner("mean")
    def mean(ds, c, settings, seed):
        return E.GBDTModel(E.GBDTModel.train(ds, E.GBDTConfig(n_estimators=1, max_depth=1)).forest, ds.features)

    load = lambda s: Dataset.from_dataframe(synthetic.regression(s, 200, 2), ["f0", "f1"], "y", row="_row")
    made = E.run_suite(spark, E.Suite("own", (E.RunConfig("x", "regression", load, booster="mean"), E.RunConfig("x", "regression", load, booster="none")))).collect()
    E.RUNNERS.pop("mean")
    assert made[0].error is None and made[0].metrics and "no runner" in made[-1].error
