"""python -m wardenlake.cli info | validate FILE | monitor --agent-id ID --perf PATH"""

from __future__ import annotations

import argparse
import json
import sys

from wardenlake import __version__


def _validate(path: str) -> int:
    """Check a JSON file of firewall patterns and policy rules; 1 and the reasons if it is wrong."""
    from wardenlake.functions.dialect import java_pattern

    wrong = []
    try:
        with open(path) as f:
            config = json.load(f)
    except (OSError, ValueError) as e:
        print(f"{path}: {e}")
        return 1
    for kind in ("blocked_patterns", "allowed_patterns"):
        for p in config.get(kind, []):
            try:
                java_pattern(p)
            except Exception as e:  # noqa: BLE001
                wrong.append(f"{kind}: {p!r}: {e}")
    wrong += [f"policy_rules: no {field}: {rule}" for rule in config.get("policy_rules", []) for field in ("name", "description", "condition") if not rule.get(field)]
    print("\n".join(wrong) or f"{path}: valid")
    return int(bool(wrong))


def _monitor(agent_id: str, perf: str) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from wardenlake.operators import performance

    rows = SparkSession.builder.getOrCreate().read.parquet(perf).filter(F.col("agent_id") == agent_id)
    performance.statistics(rows).show(truncate=False)
    performance.suggestions(rows).show(truncate=False)
    return 0


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="wardenlake")
    parser.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    commands = parser.add_subparsers(dest="command")
    commands.add_parser("info")
    commands.add_parser("validate").add_argument("file")
    monitor = commands.add_parser("monitor")
    monitor.add_argument("--agent-id", required=True)
    monitor.add_argument("--perf", help="Parquet table of performance rows")
    got = parser.parse_args(args)
    if got.command == "info":
        print(f"wardenlake {__version__}: agent-safety analytics on Spark DataFrames")
    elif got.command == "validate":
        return _validate(got.file)
    elif got.command == "monitor":
        if got.perf:
            return _monitor(got.agent_id, got.perf)
        print(f"no performance table given for agent {got.agent_id}")
    else:
        parser.print_help()
    return 0


if __name__ == "__main__":
    sys.exit(main())
