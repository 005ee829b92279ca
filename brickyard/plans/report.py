"""Reports as text, GitHub annotations and summary, HTML and Mermaid.

Tables of bricks (their values, edges and worst levels) are collected: they are as large as the workspace has bricks. Display
rows, of which there may be any number, stay a table: a page is a list of texts and of frames with lines, which tasks write.
"""

import html as escape_html
import math
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickyard.plans import display, picture
from brickyard.plans.registry import METRICS, SECTIONS
from brickyard.session import kept


class Listing:
    """Display rows with their texts, and what is counted in them."""

    def __init__(self, rows: DataFrame, resolved: DataFrame | None = None):
        self.rows = kept(display.with_texts(rows))
        by = self.rows.groupBy("section", "level", display.introduced().alias("fresh")).agg(F.count("*").alias("n")).collect()
        self.levels, self.fresh, self.every = Counter(), Counter(), Counter()
        for section, level, fresh, n in by:
            self.every[section] += n
            if fresh:
                self.levels[level] += n
                self.fresh[section] += n
        self.old = sum(self.every.values()) - sum(self.fresh.values())
        self.grid = {m: (e, w, r) for m, e, w, r in display.grid(self.rows, resolved).select("metric", "errors", "warnings", "resolved").collect()}
        self.worst = {(b, m): level for b, m, level in display.worst(self.rows).collect()}

    @classmethod
    def none(cls, spark: SparkSession) -> "Listing":
        """Without rows; for pages of workspaces in which nothing is checked."""
        out = cls.__new__(cls)
        out.rows, out.levels, out.fresh, out.every, out.old, out.grid, out.worst = None, Counter(), Counter(), Counter(), 0, {}, {}
        return out


def graph_ends(rows: DataFrame) -> dict[str, list[tuple[str, str]]]:
    """Pairs of bricks that the graph marks; at most one for each edge, and for each hidden pair."""
    marked = rows.filter(F.col("metric").isin("unstable-dependencies", "co-change")).select("metric", F.get("bricks", F.lit(0)).alias("brick"), "subject", "rank")
    out: dict[str, list[tuple[str, str]]] = {}
    for metric, brick, subject, _ in marked.orderBy("rank").collect():
        out.setdefault(metric, []).append((brick, subject))
    return out


@dataclass
class Report:
    """What a run found."""

    workspace: str
    bricks: list[dict]
    listing: Listing
    edges: list[dict]
    values: dict[tuple[str, str], tuple[float | None, str | None]]
    averages: dict[str, float | None] = field(default_factory=dict)
    outliers: dict[tuple[str, str], dict] = field(default_factory=dict)
    libraries: list[dict] = field(default_factory=list)
    thresholds: dict[str, dict | None] = field(default_factory=dict)
    configured: set[str] = field(default_factory=set)
    ends: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    base_ref: str | None = None
    changed: set[str] = field(default_factory=set)
    base_values: dict[tuple[str, str], float | None] = field(default_factory=dict)
    resolved: list[dict] = field(default_factory=list)
    hidden_warnings: int | None = None
    hidden_existing: int = 0
    generated_at: str = ""
    hazards: dict[str, dict[str, int]] = field(default_factory=dict)  # brick -> kind -> number


def number(x: float) -> str:
    if x == math.floor(x):
        return str(int(x))
    return _trim(f"{_half_up(x, 2):.2f}")


def _half_up(x: float, digits: int) -> float:
    from decimal import ROUND_HALF_UP, Decimal

    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def _trim(text: str) -> str:
    return text.rstrip("0").rstrip(".")


def format_value(key: str, value: float | None) -> str:
    metric = METRICS[key]
    if value is None:
        return "–"
    if metric.form == "percent":
        return f"{math.floor(100 * value + 0.5)}%"
    if metric.form == "decimal":
        return f"{_half_up(float(value), metric.precision):.{metric.precision}f}"
    return str(int(value)) if value == math.floor(value) else f"{_half_up(value, 1):.1f}"


def threshold_text(key: str, t) -> str | None:
    op = "> " if METRICS[key].direction == "max" else "< "
    if t is None:
        return None
    if isinstance(t, dict):
        return f"{op}mean {'+' if op == '> ' else '−'} {number(t['std-devs'])}σ"
    return op + number(t)


def describe(thresholds: dict, key: str) -> str | None:
    s = thresholds.get(key) or {}
    parts = [f"{level} {threshold_text(key, s[level])}" for level in ("warning", "error") if s.get(level) is not None]
    return ", ".join(parts) or None


def _plural(n: int, noun: str) -> str:
    return f"{n} {noun}{'' if n == 1 else 's'}"


def _headline(r: Report) -> str:
    """What was checked, and how much was found, listed or not."""
    kind = "new " if r.base_ref else ""
    levels = r.listing.levels
    said = [f"{_plural(len(r.bricks), 'brick')} checked" + (f" against {r.base_ref}" if r.base_ref else ""), _plural(levels["error"], f"{kind}error")]
    said.append(_plural(levels["warning"], f"{kind}warning") if r.hidden_warnings is None else f"{_plural(r.hidden_warnings, f'{kind}warning')} left out (use --warnings)")
    old = r.listing.old + r.hidden_existing
    if r.base_ref and old:
        said.append(f"{_plural(old, 'older finding')} left out")
    return "brickyard: " + ", ".join(said)


#: A page's parts: texts, and frames (ord, line) of any size.
Parts = list["str | DataFrame"]


def assembled(spark: SparkSession, parts: Parts) -> DataFrame:
    """part, ord, line: the parts' lines in order."""
    texts = [(i, 0, p) for i, p in enumerate(parts) if isinstance(p, str)]
    out = spark.createDataFrame(texts, "part int, ord long, line string")
    for i, p in enumerate(parts):
        if not isinstance(p, str):
            out = out.unionByName(p.select(F.lit(i).alias("part"), F.col("ord").cast("long").alias("ord"), "line"))
    return out


def text(r: Report) -> Parts:
    parts: Parts = []
    lines = display.text_lines(r.listing.rows) if r.listing.rows is not None else None
    for section, title in SECTIONS:
        if n := r.listing.fresh[section]:
            parts += [f"{title} ({n})", lines.filter(F.col("section") == section), ""]
    return [*parts, _headline(r)]


def annotations(r: Report) -> Parts:
    return [display.annotation_lines(r.listing.rows)] if r.listing.every else []


# -- GitHub summary ---------------------------------------------------------------------------------


def _cell(s: str) -> str:
    return s.replace("|", "\\|").replace("\n", " ")


def _table(head: list[str], rows: list[list[str]]) -> str:
    return "\n".join("| " + " | ".join(map(_cell, x)) + " |" for x in (head, ["---"] * len(head), *rows))


def _grid(r: Report) -> list[list[str]]:
    """Errors, warnings and resolved of each metric."""
    return [[METRICS[k].label, *map(str, r.listing.grid[k])] for k in METRICS if k in r.listing.grid]


def _heads(r: Report, keys: list[str]) -> list[str]:
    """Column heads, with the number of violations of metrics that have some."""
    found = {k: sum(r.listing.grid.get(k, (0, 0, 0))[:2]) for k in keys}
    return [f"{METRICS[k].label} ({found[k]})" if found[k] else METRICS[k].label for k in keys]


def legend(keys: list[str]) -> list[tuple[str, str]]:
    return [(METRICS[k].label, METRICS[k].about) for k in keys]


def hazard_text(r: Report, brick: str) -> str:
    return ", ".join(f"{kind}: {n}" for kind, n in sorted((r.hazards.get(brick) or {}).items()))


def tiles(r: Report) -> list[tuple[str, int]]:
    """What the page shows first: numbers of bricks, dependencies, violations by level, and resolved ones."""
    levels = r.listing.levels
    shown = [("Bricks", len(r.bricks)), ("Dependencies", len({(x["from"], x["to"]) for x in r.edges})), ("Errors", levels["error"]), ("Warnings", levels["warning"])]
    return shown + ([("Resolved", len(r.resolved))] if r.base_ref else [])


def _delta(r: Report, brick: str, key: str) -> str:
    value, _ = r.values.get((brick, key), (None, None))
    was = r.base_values.get((brick, key))
    if not r.base_ref or value is None or was is None or value == was:
        return ""
    return f" ({'+' if value > was else '−'}{format_value(key, abs(value - was))})"


def value_text(r: Report, brick: str, key: str) -> str:
    value, subject = r.values.get((brick, key), (None, None))
    shown = format_value(key, value)
    return (f"{subject} ({shown})" if subject and value is not None else shown) + _delta(r, brick, key)


def _section_rows(r: Report, section: str) -> tuple[list[str], list[list[tuple[str, str, str]]]]:
    """Keys of the section, and for each brick its cells: (text, brick, metric)."""
    keys = [m.key for m in METRICS.values() if m.section == section]
    shown = [b for b in r.bricks if not r.base_ref or b["brick"] in r.changed or any(_delta(r, b["brick"], k) for k in keys)]
    return keys, [[(f"{b['type']} {b['brick']}", b["brick"], "")] + [(value_text(r, b["brick"], k), b["brick"], k) for k in keys] for b in shown]


def _folded(lines: DataFrame, section: str, n: int, head: str = "", before: str = "<details><summary>{} more</summary>", after: str = "</details>") -> Parts:
    """A section's first lines, and the others folded away."""
    own = lines.filter(F.col("section") == section)
    parts: Parts = [head] if head else []
    parts.append(own.filter("is_shown"))
    if n > display.SHOWN:
        parts += [before.format(n - display.SHOWN), *([head] if head else []), own.filter("not is_shown"), after]
    return parts


def summary(r: Report) -> Parts:
    parts: Parts = [f"## {r.workspace}\n", _headline(r) + "\n"]
    if grid := _grid(r):
        parts.append(_table(["Metric", "Errors", "Warnings", "Resolved"], grid) + "\n")
    if r.listing.fresh:
        lines = display.markdown_lines(display.with_shown(r.listing.rows.filter(display.introduced())))
    for section, title in SECTIONS:
        n = r.listing.fresh[section]
        if n:
            head = _table(["Level", "Metric", "What", "Where"], [])
            parts += [f"### {title}: {_plural(n, 'violation')}\n", *_folded(lines, section, n, head, "\n<details><summary>{} more</summary>\n", "\n</details>"), ""]
        else:
            parts.append(f"### {title}: none found\n")
        keys, rows = _section_rows(r, section)
        if rows:
            body = [[f"**{t}**" if (b, k) in r.listing.worst else t for t, b, k in row] for row in rows]
            body.append(["**Average**"] + [format_value(k, r.averages.get(k)) for k in keys])
            parts.append(f"### {title}\n\n" + _table(["Brick"] + _heads(r, keys), body) + "\n")
            parts.append("\n".join(f"- {name}: {about}" for name, about in legend(keys)) + "\n")
    if r.libraries:
        parts.append("### Shared libraries\n\n" + _table(["Library", "Bricks", "Spread"], [[x["library"], str(x["n"]), spread_level(r, x)] for x in r.libraries]) + "\n")
    parts.append("### Dependencies\n\n```mermaid\n" + mermaid(r) + "\n```\n")
    if r.resolved:
        parts.append("### Resolved\n\n" + _table(["Brick", "Metric", "What"], [[v["brick"], METRICS[v["metric"]].label, v["message"]] for v in r.resolved]) + "\n")
    return [*parts, "### Thresholds\n\n" + _table(["Metric", "Threshold", "Configured"], threshold_rows(r))]


def spread_level(r: Report, library: dict) -> str:
    s = r.thresholds.get("library-spread") or {}
    if library["library"] in {str(x) for x in s.get("allow") or ()}:
        return "allowed"
    return next((level for level in ("error", "warning") if s.get(level) is not None and library["n"] > s[level]), "")


def threshold_rows(r: Report) -> list[list[str]]:
    out = []
    for key, metric in METRICS.items():
        said = describe(r.thresholds, key)
        if said:
            options = [f"{k} {v}" for k in metric.options if (v := (r.thresholds[key] or {}).get(k))]
            out.append([metric.label, ", ".join([said, *options]), "yes" if key in r.configured else ""])
    return out


# -- graph and page ---------------------------------------------------------------------------------


def mermaid(r: Report) -> str:
    ids = {b["brick"]: f"b{i}" for i, b in enumerate(r.bricks)}
    pairs = list(dict.fromkeys((e["from"], e["to"]) for e in r.edges))
    fresh = {(e["from"], e["to"]) for e in r.edges if e.get("is_new")}
    ends = {m: list(dict.fromkeys(r.ends.get(m, ()))) for m in ("unstable-dependencies", "co-change")}
    lines = ["graph TD"]
    lines += [f"  {ids[b['brick']]}([\"{b['brick']}\"])" if b["type"] == "base" else f"  {ids[b['brick']]}[\"{b['brick']}\"]" for b in r.bricks]
    lines += [f"  {ids[a]} {'-.->' if (a, b) in fresh else '-->'} {ids[b]}" for a, b in pairs]
    lines += [f"  {ids[a]} -.- {ids[b]}" for a, b in ends["co-change"]]
    lines += [f"  linkStyle {i} stroke:#d1242f,stroke-width:2px" for i, p in enumerate(pairs) if p in ends["unstable-dependencies"]]
    lines += [f"  linkStyle {len(pairs) + i} stroke:#b26b00,stroke-width:2px,stroke-dasharray:2 4" for i in range(len(ends["co-change"]))]
    return "\n".join(lines)


_STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 8px}.error{background:#ffd7d5}.warning{background:#fff1c2}.outlier{outline:2px solid #8250df}.tiles{display:flex;gap:1em}.tiles div{border:1px solid #ccc;padding:.5em 1em}dt{font-weight:bold}"


def html(r: Report) -> Parts:
    e = escape_html.escape
    worst = r.listing.worst

    def table(head, body):
        top = "".join(f"<th>{e(h)}</th>" for h in head)
        return f"<table><tr>{top}</tr>{''.join(f'<tr>{x}</tr>' for x in body)}</table>"

    def cell(text: str, brick: str, key: str) -> str:
        marks = [x for x in (worst.get((brick, key)), "outlier" if (brick, key) in r.outliers else None) if x]
        o = r.outliers.get((brick, key))
        kinds = hazard_text(r, brick) if key == "isolation-hazards" else ""
        tip = f' title="{e(kinds)}"' if kinds else f' title="{o["z"]:.1f} deviations off the mean of the {o["peers"]} others"' if o else ""
        return f'<td class="{" ".join(marks)}"{tip}>{e(text)}</td>'

    head = f"<!doctype html><html><head><meta charset='utf-8'><title>{e(r.workspace)}</title><style>{_STYLE}{picture.STYLE}</style></head><body>"
    parts: Parts = [head, f"<h1>{e(r.workspace)}</h1><p>{e(_headline(r))}</p><p>{e(r.generated_at)}</p>"]
    parts.append('<div class="tiles">' + "".join(f"<div><b>{n}</b> {e(name)}</div>" for name, n in tiles(r)) + "</div>")
    if grid := _grid(r):
        parts.append("<h2>Summary</h2>" + table(["Metric", "Errors", "Warnings", "Resolved"], ["".join(f"<td>{e(c)}</td>" for c in x) for x in grid]))
    if r.listing.every:
        lines = display.html_lines(display.with_shown(r.listing.rows))
    for section, title in SECTIONS:
        n_here = r.listing.fresh[section]
        parts.append(f"<h2>{e(title)}: {_plural(n_here, 'violation') if n_here else 'none found'}</h2>")
        if r.listing.every[section]:
            parts += _folded(lines, section, r.listing.every[section])
        keys, rows = _section_rows(r, section)
        if rows:
            average = "<td>Average</td>" + "".join(f"<td>{e(format_value(k, r.averages.get(k)))}</td>" for k in keys)
            parts.append(table(["Brick"] + _heads(r, keys), ["".join(cell(*c) for c in x) for x in rows] + [average]))
            parts.append("<dl>" + "".join(f"<dt>{e(name)}</dt><dd>{e(about)}</dd>" for name, about in legend(keys)) + "</dl>")
    if r.libraries:
        parts.append("<h2>Shared libraries</h2>" + table(["Library", "Bricks", "Spread"], [f"<td>{e(x['library'])}</td><td>{x['n']}</td><td>{spread_level(r, x)}</td>" for x in r.libraries]))
    parts.append("<h2>Dependencies</h2>" + picture.svg(r.bricks, r.edges, r.ends))
    parts.append(f'<details><summary>as Mermaid text</summary><pre class="mermaid">{e(mermaid(r))}</pre></details>')
    if r.resolved:
        parts.append("<h2>Resolved</h2>" + "".join(f"<li>{e(v['brick'])}: {e(METRICS[v['metric']].label)} {e(v['message'] or '')}</li>" for v in r.resolved))
    parts.append("<h2>Thresholds</h2>" + table(["Metric", "Threshold", "Configured"], ["".join(f"<td>{e(c)}</td>" for c in x) for x in threshold_rows(r)]))
    return [*parts, f"<script>{picture.SCRIPT}</script></body></html>"]
