"""python -m kerbline build|validate|sensitivity|stats FOLDER [--out DIR] [--params FILE] [--set key=value]...

Exit codes: 0 done, 1 a gate or comparison failed, 2 wrong usage or parameters, 3 a source failed.
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession

from kerbline import sources
from kerbline.functions import rules
from kerbline.operators import scenario, stats
from kerbline.operators.quality import ExpectationError
from kerbline.params import Params, ParamsError, load
from kerbline.plans import build as plan
from kerbline.session import ship


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="kerbline")
    parser.add_argument("command", choices=["build", "validate", "sensitivity", "stats"])
    parser.add_argument("folder")
    parser.add_argument("--out", default="data")
    parser.add_argument("--params")
    parser.add_argument("--set", action="append", default=[], dest="overrides")
    args = parser.parse_args(argv)
    try:
        p = load(args.params, args.overrides)
    except (ParamsError, OSError) as e:
        print(e, file=sys.stderr)
        return 2
    spark = ship(SparkSession.builder.appName("kerbline").getOrCreate())
    try:
        return _run(spark, args, p)
    except ExpectationError as e:
        print(e, file=sys.stderr)
        return 1
    except OSError as e:
        print(e, file=sys.stderr)
        return 3


def _run(spark: SparkSession, args, p: Params) -> int:
    if args.command == "build":
        head = plan.publish(plan.from_files(spark, args.folder, p), args.out, p, datetime.now(UTC).isoformat(timespec="seconds"))
        print(json.dumps(head))
    elif args.command == "stats":
        edges = spark.read.parquet(f"{args.out}/edges.parquet")
        stats.by_level(edges.where("fac <> 'connector'")).orderBy("lts").show()
        stats.summary(edges, rules.is_low_stress("lts", p)).show()
    elif args.command == "validate":
        edges = spark.read.parquet(f"{args.out}/edges.parquet")
        said = []
        golden = Path(args.folder, "golden.csv")
        if golden.exists():
            verdicts = scenario.golden(edges, sources.golden_rows(spark, str(golden)))
            said += [f"{r['id']}: {r['verdict']} ({r['got']}, wanted {r['expected']})" for r in verdicts.where("verdict <> 'passed'").limit(20).collect()]
        baseline = Path(args.folder, "baseline.json")
        if baseline.exists():
            said += scenario.drift(json.loads(Path(args.out, "stats.json").read_text()), json.loads(baseline.read_text())["values"])
        print("\n".join(said) or "passed")
        return int(bool(said))
    else:
        run = lambda values: plan.from_files(spark, args.folder, p.with_values(values)).edges
        low = rules.is_low_stress("lts", p)
        rows, moved = scenario.sweep(run, p["sensitivity.runs"], lambda e: {"low_stress_miles": round(stats.summary(e, low).first()["low_stress_miles"], 1)})
        Path(args.out).mkdir(parents=True, exist_ok=True)
        Path(args.out, "sensitivity.md").write_text(scenario.markdown(rows))
        ids = [] if moved is None else sorted(r["id"] for r in moved.toLocalIterator())
        Path(args.out, "flipped_ids.json").write_text(json.dumps(ids))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
