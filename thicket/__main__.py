"""Command line: python -m thicket suite|ablation|compare|check|record|report|list|train|predict|inspect ..."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions import objectives
from thicket.plans import evaluate as E
from thicket.sources import persist, synthetic
from thicket.sources.dataset import Dataset


def _generated(maker, n: int, f: int):
    return lambda s: Dataset.from_dataframe(maker(s, n, f), [f"f{i}" for i in range(f)], "y", row="_row")


def configurations() -> dict[str, E.RunConfig]:
    """The built-in configurations: generated regression, binary and five-class data for both kinds of models and linear trees."""
    out = {}
    for size, n, f in (("small", 2000, 50), ("medium", 10_000, 100)):
        makers = (("reg", "regression", synthetic.regression), ("bin", "binary", synthetic.binary), ("multi", "multiclass", lambda s, n, f: synthetic.multiclass(s, n, f, 5)))
        for short, task, maker in makers:
            for booster in E.BOOSTER_DEFAULTS:
                name = f"synthetic_{short}_{size}/{booster}"
                out[name] = E.RunConfig(name, task, _generated(maker, n, f), booster, 5)
    return out


def chosen(args: argparse.Namespace) -> list[E.RunConfig]:
    """Configurations by dataset, booster and task."""
    found = configurations().values()
    return [c for c in found if (not args.dataset or c.name.split("/")[0] in args.dataset) and (not args.booster or c.booster in args.booster) and (not args.task or c.task in args.task)]


def shown(results: DataFrame) -> None:
    print(E.markdown(E.summary(results)))
    for c, e in results.where(F.col("error").isNotNull()).select("config", "error").collect():
        print(f"failed: {c}: {e}", file=sys.stderr)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="thicket", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *choices: tuple[str, dict]) -> argparse.ArgumentParser:
        s = sub.add_parser(name)
        for flag, options in choices:
            s.add_argument(flag, **options)
        return s

    filters = [(f"--{k}", {"action": "append", "default": []}) for k in ("dataset", "booster", "task")]
    trees = ("--n-estimators", {"type": int, "default": None})
    out = ("--out", {"default": None, "help": "folder for results as JSON lines"})
    add("suite", ("name", {"choices": sorted(E.SUITES)}), *filters, trees, out)
    add("ablation", ("name", {"choices": sorted(E.ABLATIONS)}), *filters, trees, out)
    add("compare", ("results", {"nargs": "+", "help": "folders of results"}))
    add("report", ("results", {}), ("--csv", {"default": None}))
    add("record", ("results", {}), ("baseline", {}))
    add("check", ("results", {}), ("baseline", {}), ("--tolerance", {"type": float, "default": 0.02}))
    add("list", ("what", {"choices": ["datasets", "models", "suites", "tasks", "objectives"]}))
    add("train", ("table", {}), ("model", {}), ("--label", {"required": True}), ("--features", {"required": True, "help": "comma-separated"}), ("--objective", {"default": "squared"}), ("--params", {"default": "{}", "help": "JSON"}))
    add("predict", ("table", {}), ("model", {}), ("out", {}))
    add("inspect", ("model", {}))
    return p


def main(argv: Sequence[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "list":
        found = {"datasets": {c.name.split("/")[0] for c in configurations().values()}, "models": set(E.BOOSTER_DEFAULTS), "suites": set(E.SUITES), "tasks": {c.task for c in configurations().values()}, "objectives": set(objectives.NAMES)}
        print("\n".join(sorted(found[a.what])))
        return 0
    if a.command == "inspect":
        with open(a.model, "rb") as f:
            data = f.read()
        print(json.dumps(persist.inspect_bytes(data) if data[:4] == persist.MAGIC else {k: v for k, v in json.loads(data).items() if k != "model"}))
        return 0
    spark = SparkSession.builder.appName("thicket").getOrCreate()
    if a.command in ("suite", "ablation"):
        picked = chosen(a)
        of = E.suite(a.name, picked) if a.command == "suite" else E.Suite(a.name, tuple(x for c in picked for x in E.ablation(a.name, c)))
        results = E.run_suite(spark, of, **({"n_estimators": a.n_estimators} if a.n_estimators else {})).persist()
        shown(results)
        if a.out:
            E.write_results(results, a.out)
    elif a.command == "compare":
        # each folder is a library of its own
        parts = [E.read_results(spark, r).withColumn("library", F.lit(r)) for r in a.results]
        both = parts[0]
        for x in parts[1:]:
            both = both.unionByName(x)
        print(E.markdown(E.summary(both)))
    elif a.command == "report":
        results = E.read_results(spark, a.results)
        shown(results)
        if a.csv:
            E.write_results(results, a.csv, "csv")
    elif a.command == "record":
        E.record_baseline(E.read_results(spark, a.results), a.baseline)
    elif a.command == "check":
        rows = E.check_baseline(E.read_results(spark, a.results), E.load_baseline(a.baseline), a.tolerance).collect()
        bad = [r for r in rows if r["regressed"]]
        for r in bad:
            print(f"regressed: {r['config']} {r['metric']}: {r['mean']:.6g}, baseline {r['baseline']:.6g}")
        return int(bool(bad))
    elif a.command == "train":
        from thicket.operators.model import GBDTModel
        from thicket.plans.gbdt import GBDTConfig

        ds = Dataset.from_dataframe(spark.read.parquet(a.table), a.features.split(","), a.label)
        persist.save(GBDTModel.train(ds, GBDTConfig(objective=objectives.get(a.objective), **json.loads(a.params))), a.model)
    else:
        persist.load(a.model).transform(spark.read.parquet(a.table)).write.parquet(a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
