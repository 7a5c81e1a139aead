"""Reports as JSON files and Markdown tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .manifests import write_json


def _table(head: list[str], rows: list[list[str]]) -> str:
    return "\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * len(head), *rows])


def summary_markdown(summary: DataFrame) -> str:
    """The one row of `evaluation.summary`."""
    r = summary.first()
    recalls = sorted((int(c[7:]), c) for c in summary.columns if c.startswith("recall_"))
    rows = [["cases", str(r.n_cases)], ["misses", str(r.n_misses)], *[[f"recall@{k}", f"{r[c]:.3f}"] for k, c in recalls]]
    rows += [["median rank", f"{r.median_rank:.1f}"], ["mean rank", f"{r.mean_rank:.1f}"], ["mean time-to-target (s)", f"{r.mean_ttt_s:.1f}"]]
    return _table(["metric", "value"], rows)


def answers_markdown(rates: DataFrame, mean_s: float) -> str:
    """The rows of `evaluation.answer_rates`: overall, then by archetype in order."""
    rows = rates.collect()  # one row an archetype
    whole = next(r for r in rows if r.archetype is None)
    head = _table(["qa metric", "value"], [["cases", str(whole.n_cases)], ["answer accuracy", f"{whole.answer_rate:.3f}"], ["moment hit rate", f"{whole.moment_rate:.3f}"], ["qa correct (both)", f"{whole.joint_rate:.3f}"], ["mean time/case (s)", f"{mean_s:.1f}"]])
    parts = sorted((r for r in rows if r.archetype is not None), key=lambda r: r.archetype)
    if not parts:
        return head
    return head + "\n\n" + _table(["archetype", "n", "answer", "moment", "correct"], [[r.archetype, str(r.n_cases), f"{r.answer_rate:.3f}", f"{r.moment_rate:.3f}", f"{r.joint_rate:.3f}"] for r in parts])


def coverage_markdown(coverage: DataFrame, concentrations: dict[str, DataFrame], most: int = 20) -> str:
    """A corpus by kind of evidence, and its videos with the most shots."""
    told = [(name, df.first()) for name, df in concentrations.items()]
    head = _table(["evidence", "coverage", "hub share", "hub", "variation"], [[n, f"{r.coverage:.3f}", f"{r.hub_share:.3f}", str(r.hub), f"{r.cv:.3f}"] for n, r in told])
    first = coverage.orderBy("n_shots", "video_id", ascending=[False, True]).limit(most).collect()
    counts = [c for c in coverage.columns if c != "video_id"]
    return head + "\n\n" + _table(["video", *counts], [[r.video_id, *[str(r[c]) for c in counts]] for r in first])


def save_report(rows: DataFrame, path: str, most: int = 100_000) -> None:
    """A report's rows as one JSON file, written whole or not at all; a table is no report."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report has at most {most} rows")
    write_json(path, [r.asDict(recursive=True) for r in found])
