"""Findings, statistics and evaluation runs as JSON or text, for people; small results only."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

START, END = "<!-- results:start -->", "<!-- results:end -->"


def as_json(df: DataFrame) -> str:
    return json.dumps([r.asDict(recursive=True) for r in df.collect()], indent=2, default=str, ensure_ascii=False)


def section_tree(sections: list[dict], previews: list[str] | None = None) -> str:
    lines = []
    for i, s in enumerate(sections):
        lines.append(f"{'  ' * (s['level'] - 1)}{s['path']}  [{s['char_start']}, {s['char_end']})")
        if previews:
            lines.append(f"{'  ' * s['level']}{' '.join(previews[i].split())}")
    return "\n".join(lines)


def findings_text(findings: list[dict]) -> str:
    if not findings:
        return "No contradictions found."
    where = lambda c: f" ({c['path']})" if c.get("path") else ""
    return "\n\n".join(f"{i}. {f['conflict_type']} (confidence {f['confidence']:.2f})\n   {f['rationale']}\n   A{where(f['a'])}: {f['a']['text']}\n   B{where(f['b'])}: {f['b']['text']}" for i, f in enumerate(findings, 1))


def stats_text(stats: dict) -> str:
    return "\n".join(f"{name.replace('_', ' '):32} {'not measured' if value is None else value}" for name, value in stats.items())


def percent(value: float | None) -> str:
    return "not measured" if value is None else f"{100 * value:.1f}%"


def results_table(run: dict) -> str:
    """Markdown of a run: {metrics, by_type, started_at, model, id, classify, verify}."""
    m, on = run.get("metrics"), lambda flag: "enabled" if flag else "disabled"
    lines = ["### Preliminary results", "", f"Measured {str(run['started_at'])[:10]} on `{run['model']}`, run `{run['id'][:8]}`.", "", "| Metric | Value |", "|---|---|"]
    if m:
        rate = m["control"]["false_positives_per_paper"]
        lines += [
            f"| Injected contradictions | {m['injected']['total']} |", f"| Detected | {m['injected']['detected']} |", f"| **Recall** | **{percent(m['injected']['recall'])}** |",
            f"| Clean control papers | {m['control']['papers']} |", f"| Findings on clean papers | {m['control']['findings']} |",
            f"| **False positives per clean paper** | **{'not measured' if rate is None else f'{rate:.2f}'}** |", f"| Classification | {on(run['classify'])} |", f"| Verification | {on(run['verify'])} |",
        ]
    else:
        lines.append("| — | run recorded no metrics |")
    if run.get("by_type"):
        lines += ["", "| Conflict type | Injected | Detected | Recall |", "|---|---|---|---|"]
        lines += [f"| `{r['mutation_type']}` | {r['total']} | {r['detected']} | {percent(r['recall'])} |" for r in run["by_type"]]
    return "\n".join(lines)


def splice(page: str, rendered: str) -> str:
    """page with what stands between the markers replaced."""
    start, end = page.find(START), page.find(END)
    if start < 0 or end < 0:
        raise ValueError(f"the page has no {START} and {END}")
    return f"{page[: start + len(START)]}\n\n{rendered}\n\n{page[end:]}"
