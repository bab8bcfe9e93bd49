"""``python -m auditframe.cli scan|clean|harmonize|crosswalk|report|benchmark``; nothing is written unless a place is given, nothing changed without ``--execute``."""

from __future__ import annotations

import argparse
import json
import os
import sys

import yaml
from pyspark.sql import SparkSession

from .operators import cleaning, tables
from .operators import rules as R
from .plans import injection
from .plans.frame import AuditFrame
from .plans.investigation import Investigation
from .sources import writers
from .sources.readers import IngestError, read_table


def load_rules(path: str | None) -> dict:
    if not path:
        return {}
    with open(path, encoding="utf-8") as f:
        said = yaml.safe_load(f) or {}
    known = {"version", "primary_key", "columns", "missing_values", "category_mappings", "safe_fixes", "expectations", "weights_strata"}
    if not isinstance(said, dict) or (odd := set(said) - known):
        raise ValueError(f"rules: not known: {', '.join(sorted(odd)) if isinstance(said, dict) else said}")
    return said


def checked(rules: dict, frame: AuditFrame) -> dict:
    """The same rules, if all of them can be applied to the table; ValueError otherwise."""
    R.check_rules({k: v for k, v in rules.items() if k in R.RULE_PARTS}, frame.columns)
    cleaning.check_fixes(rules.get("safe_fixes") or {}, frame.columns, rules.get("primary_key") or [])
    return rules


def harmonize(spark: SparkSession, files: list[str], said: dict, out: str | None, execute: bool) -> int:
    """Several files, each by its own rules and renamed by its own part of the crosswalk; rows of two files are never joined.

    ``said`` is ``{file name: {rules, column_map, value_map}}``. All files are read and their rules checked, then
    all are repaired and compared with what they were, and only if every one passes is anything written.
    """
    names = [os.path.basename(x) for x in files]
    try:
        if len(set(names)) < len(names):
            raise ValueError("two files of one name would be written to one place")
        if odd := sorted(set(said) ^ set(names)):
            raise ValueError(f"files and crosswalk don't name the same: {', '.join(odd)}")
        plans = []
        for path, name in zip(files, names, strict=True):
            part = said[name] or {}
            rules = load_rules(part.get("rules"))
            frame = AuditFrame(read_table(spark, path), primary_key=rules.get("primary_key") or [])
            checked(rules, frame)
            if missing := sorted((set(part.get("column_map") or {}) | set(part.get("value_map") or {})) - set(frame.columns)):
                raise ValueError(f"{name}: no column {', '.join(missing)}")
            renamed = [(part.get("column_map") or {}).get(c, c) for c in frame.columns]
            if len(set(renamed)) < len(renamed):
                raise ValueError(f"{name}: two columns would have one name")
            plans.append((path, name, part, rules, frame))
    except (IngestError, ValueError, OSError, yaml.YAMLError) as e:
        print(e, file=sys.stderr)
        return 2
    done = []
    for path, name, part, rules, frame in plans:
        rows, log, safety = Investigation(frame).clean({k: rules.get(k) or {} for k in ("missing_values", "category_mappings")}, rules.get("safe_fixes") or {})
        if failed := [r.check for r in safety.where("not passed").collect()]:
            print(f"{name}: {', '.join(failed)}", file=sys.stderr)
            return 3
        mapped = tables.crosswalk(AuditFrame(rows), part.get("column_map") or {}, part.get("value_map") or {})
        done.append((path, name, part, mapped, log))
        print(json.dumps({"file": name, "size": writers.format_bytes(os.path.getsize(path)), "mutations": log.count()}))
    if execute and out:
        for path, name, part, mapped, log in done:
            at = f"{out}/{name}"
            writers.write_csv(mapped, f"{at}/rows")
            writers.write_parquet(log, f"{at}/log")
            writers.atomic_write(f"{at.removeprefix('file://')}/manifest.json", json.dumps(writers.manifest([path], [part["rules"]] if part.get("rules") else [], log.count()), indent=1))
    return 0


def main(argv: list[str] | None = None) -> int:
    """Exit codes: 0 done, 1 findings that are errors, 2 a file or rules that can't be read, 3 a safety check that failed."""
    p = argparse.ArgumentParser(prog="auditframe")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "clean", "crosswalk"):
        s = sub.add_parser(name)
        s.add_argument("file")
        s.add_argument("--rules")
        s.add_argument("--out")
        s.add_argument("--execute", action="store_true")
    h = sub.add_parser("harmonize")
    h.add_argument("files", nargs="+")
    h.add_argument("--crosswalk", required=True)
    h.add_argument("--out")
    h.add_argument("--execute", action="store_true")
    b = sub.add_parser("benchmark")
    b.add_argument("--rows", type=int, default=1000)
    b.add_argument("--seeds", type=int, default=10)
    r = sub.add_parser("report")
    r.add_argument("artifact")
    r.add_argument("--out", required=True)
    a = p.parse_args(argv)
    if a.command == "report":
        with open(a.artifact, encoding="utf-8") as f:
            parts = json.load(f)
        writers.atomic_write(a.out, writers.render_html("Audit", parts) if a.out.endswith(".html") else writers.render_markdown("Audit", parts))
        return 0
    spark = SparkSession.builder.appName("auditframe").getOrCreate()
    if a.command == "benchmark":
        rows, scores = injection.run_seeds(spark, a.rows, range(a.seeds))
        print(writers.markdown_table(rows) + f"\nMean score clean, spoilt, repaired: {', '.join(f'{x:.1f}' for x in scores)}")
        return int(any(r["recall"] < 1 or r["clean"] for r in rows))
    if a.command == "harmonize":
        try:
            with open(a.crosswalk, encoding="utf-8") as f:
                said = yaml.safe_load(f) or {}
        except (OSError, yaml.YAMLError) as e:
            print(e, file=sys.stderr)
            return 2
        if not isinstance(said, dict):
            print("crosswalk: no entries by file name", file=sys.stderr)
            return 2
        return harmonize(spark, a.files, said, a.out, a.execute)
    try:
        rules = load_rules(a.rules) if a.command != "crosswalk" else yaml.safe_load(open(a.rules, encoding="utf-8"))  # noqa: SIM115
        frame = AuditFrame(read_table(spark, a.file), primary_key=rules.get("primary_key") or [])
        if a.command != "crosswalk":
            checked(rules, frame)
    except (IngestError, ValueError, OSError, yaml.YAMLError) as e:
        print(e, file=sys.stderr)
        return 2
    if a.command == "crosswalk":
        out = tables.crosswalk(frame, rules.get("column_map") or {}, rules.get("value_map") or {})
        if a.execute and a.out:
            writers.write_csv(out, a.out)
        return 0
    case = Investigation(frame)
    if a.command == "scan":
        parts = case.report()
        if rules:
            parts["Rules"] = [x.asDict() for x in R.validate(frame, rules).groupBy("severity", "rule", "column").count().collect()]
            if rules.get("expectations"):
                parts["Expectations"] = [x.asDict() for x in R.evaluate_expectations(frame, rules["expectations"]).collect()]
        text = json.dumps(parts, indent=1, default=str)
        writers.atomic_write(a.out, text) if a.out else print(text)
        return int(any(c["status"] == "Found" and c["severity"] == "error" for c in case.catalogue))
    rows, log, safety = case.clean({k: rules.get(k) or {} for k in ("missing_values", "category_mappings")}, rules.get("safe_fixes") or {})
    print(json.dumps([x.asDict() for x in log.groupBy("column", "rule").count().collect()], indent=1))
    if not safety.where("not passed").isEmpty():
        return 3
    if a.execute and a.out:
        writers.write_csv(rows, f"{a.out}/rows")
        writers.write_parquet(log, f"{a.out}/log")
        writers.atomic_write(f"{a.out.removeprefix('file://')}/manifest.json", json.dumps(writers.manifest([a.file], [a.rules] if a.rules else [], log.count()), indent=1))
    return 0


if __name__ == "__main__":
    sys.exit(main())
