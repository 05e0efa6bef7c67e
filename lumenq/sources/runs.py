"""Run folders, metrics, traces and reports."""

from __future__ import annotations

import datetime
import json
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenq.operators.evaluate import METRICS


def new_run(root: str, now: datetime.datetime | None = None, name: str | None = None) -> Path:
    """A run's folder; one that is there already raises FileExistsError."""
    now = now or datetime.datetime.now(datetime.UTC)
    path = Path(root) / (name or now.strftime("%Y%m%d_%H%M%S"))
    path.mkdir(parents=True, exist_ok=False)
    return path


def commit_of(folder: str = ".") -> str | None:
    """The commit that a folder is at, or None outside a repository."""
    try:
        return subprocess.run(["git", "-C", folder, "rev-parse", "--short", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return None


def write_manifest(run: Path, settings: dict, counts: dict) -> Path:
    """The run's manifest, with the commit, and its copy as the root's latest."""
    text = json.dumps({"run": run.name, "commit": commit_of(), "settings": settings, "counts": counts}, sort_keys=True, indent=1)
    (run / "manifest.json").write_text(text)
    (run.parent / "latest.json").write_text(text)
    return run / "manifest.json"


def write_trace(rows: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object for each question, in a fresh folder or behind what is there."""
    rows.write.mode("append" if append else "overwrite").json(path)


def short(text: str, limit: int = 360) -> str:
    flat = " ".join(str(text or "").split())
    return flat if len(flat) <= limit else flat[: limit - 1] + "…"


def trace_markdown(rows: list[dict]) -> str:
    """A readable report of agent traces (qid, question, answer, rounds as JSON)."""
    out = ["# Agent traces", ""]
    for r in rows:
        out += [f"## {r['qid']}", "", short(r.get("question")), "", f"Answer: {short(r.get('answer'))}", ""]
        for step in json.loads(r["rounds"]) if isinstance(r.get("rounds"), str) else r.get("rounds") or []:
            calls = ", ".join(t["tool_name"] for t in step["tool_results"]) or "no call"
            before, after = step["evidence_chunk_ids_before"], step["evidence_chunk_ids_after"]
            out.append(f"- round {step['round']}: {calls}; evidence {len(before)} to {len(after)}")
            out += [f"  - {short(t['output'], 200)}" for t in step["tool_results"]]
        out.append("")
    return "\n".join(out)


def percent(x: float | None) -> str:
    return "-" if x is None else f"{100 * x:.1f}%"


def metrics_markdown(summary: DataFrame, breakdown: DataFrame | None = None) -> str:
    """The aggregates of each strategy, and the breakdown, as Markdown. Only aggregated rows come to the driver."""
    rows = summary.orderBy("strategy").collect()
    out = ["# Retrieval report", "", "| strategy | n | " + " | ".join(METRICS) + " | median rank |", "|---" * (len(METRICS) + 3) + "|"]
    out += [f"| {r.strategy} | {r.n} | " + " | ".join(percent(r[m]) for m in METRICS) + f" | {'-' if r.median_gold_rank is None else f'{r.median_gold_rank:g}'} |" for r in rows]
    if breakdown is not None:
        out += ["", "| dimension | value | n | hit5 | mrr |", "|---|---|---|---|---|"]
        out += [f"| {r.dimension} | {r.value} | {r.n} | {percent(r.hit5)} | {percent(r.mrr)} |" for r in breakdown.orderBy("dimension", "value").collect()]
    return "\n".join(out) + "\n"


def tiers_markdown(tiers: DataFrame) -> str:
    """A table for each dimension of ``evaluate.tiers``: a row for each value, hits at 5 of each strategy beside each other, then the other means."""
    rows = tiers.orderBy("dimension", "value", "strategy").collect()
    names, out = sorted({r.strategy for r in rows}), []
    for d in dict.fromkeys(r.dimension for r in rows):
        out += [f"## By {d}", "", "| value | n | " + " | ".join(f"{x} hit5" for x in names) + " | " + " | ".join(f"{x} mrr" for x in names) + " |", "|---" * (2 + 2 * len(names)) + "|"]
        for v in dict.fromkeys(r.value for r in rows if r.dimension == d):
            own = {r.strategy: r for r in rows if (r.dimension, r.value) == (d, v)}
            cells = [percent(own[x][m] if x in own else None) for m in ("hit5", "mrr") for x in names]
            out.append(f"| {v} | {max(r.n for r in own.values())} | " + " | ".join(cells) + " |")
        out.append("")
    return "\n".join(out)


def write_report(run: Path, summary: DataFrame, breakdown: DataFrame | None = None) -> Path:
    (run / "results.json").write_text(json.dumps([r.asDict() for r in summary.orderBy("strategy").collect()], indent=1))
    (run / "report.md").write_text(metrics_markdown(summary, breakdown))
    return run / "report.md"


def sources_list(ranked: DataFrame) -> DataFrame:
    """What an answer cites: for each question an array of (rank, chunk_id, section, score to 4 places, preview)."""
    flat = F.substring(F.regexp_replace("text", r"\s+", " "), 1, 280)
    return ranked.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "section", F.round("score", 4).alias("score"), flat.alias("preview")))).alias("sources"))
