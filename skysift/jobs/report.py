"""Suites, gates and reports: small metric tables to JSON and Markdown."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import registry

#: The queries of each suite; what a suite reports is their rows.
SUITES = {
    "1 cross-validation": ("ensemble_oof", "feature_importance"),
    "2 ablation": ("class_cluster_stats", "ablation_projection"),
    "3 off-distribution audit": ("evaluate_ood", "role_rates"),
    "4 baselines": ("baseline_models",),
    "5 significance": ("mcnemar", "wilson_ci"),
    "6 manifold": ("manifold_conformal", "waterfall_features"),
    "7 population": ("population_classification", "population_ood"),
}
REQUIRED = ("6 manifold", "7 population")
MAX_ROWS = 50


def rows_of(df: DataFrame) -> list[dict]:
    """At most MAX_ROWS rows, for reading; tables go to storage instead."""
    return [r.asDict(recursive=True) for r in df.limit(MAX_ROWS).collect()]


def guard(make: Callable[[], dict]) -> dict:
    """A suite's record; a failure is reported as skipped with its reason."""
    began = time.time()
    try:
        out = make() | {"skipped": False}
    except Exception as e:  # a suite may fail without the others
        out = {"skipped": True, "reason": f"{type(e).__name__}: {str(e)[:300]}", "passed": False}
    return out | {"elapsed_s": round(time.time() - began, 3)}


def run_suite(spark: SparkSession, sf_dir: str, name: str) -> dict:
    queries = registry.queries()

    def make() -> dict:
        tables = {q: rows_of(queries[q](spark, sf_dir)) for q in SUITES[name]}
        gates = [r["passed"] for t in tables.values() for r in t if "passed" in r]
        return {"tables": tables, "passed": all(gates)}

    return guard(make)


def verdict(summary: dict[str, dict]) -> dict:
    """Validated if no suite failed and the required ones ran."""
    failed = [k for k, v in summary.items() if not v.get("skipped") and not v.get("passed")]
    skipped = [k for k, v in summary.items() if v.get("skipped")]
    missing = [k for k in REQUIRED if k not in summary or summary[k].get("skipped")]
    return {"validated": bool(summary) and not failed and not missing, "failed": failed, "skipped": skipped, "missing": missing}


def markdown(name: str, record: dict) -> str:
    out = [f"# Suite {name}", "", "SKIPPED: " + record["reason"] if record.get("skipped") else "PASS" if record.get("passed") else "FAIL", ""]
    for q, rows in record.get("tables", {}).items():
        out += [f"## {q}", ""]
        if rows:
            cols = list(rows[0])
            out += ["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
            out += ["| " + " | ".join(f"{r[c]:.6g}" if isinstance(r[c], float) else str(r[c]) for c in cols) + " |" for r in rows]
        out.append("")
    return "\n".join(out)


def write_reports(summary: dict[str, dict], folder: str) -> None:
    p = Path(folder)
    p.mkdir(parents=True, exist_ok=True)
    (p / "summary.json").write_text(json.dumps({"suites": summary, "verdict": verdict(summary)}, default=str, indent=1))
    for name, record in summary.items():
        stem = name.replace(" ", "_")
        (p / f"{stem}.json").write_text(json.dumps(record, default=str, indent=1))
        (p / f"{stem}.md").write_text(markdown(name, record))
