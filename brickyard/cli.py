"""Command line: measure a workspace, check it, compare it with a base, and report."""

import argparse
import datetime
import os
import shutil
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickyard.operators import stats
from brickyard.plans import baseline, report, thresholds
from brickyard.plans.analysis import Workspace
from brickyard.plans.config import ConfigError, lowest_limit, merge_config
from brickyard.plans.facts_table import FactsTable
from brickyard.plans.registry import METRICS
from brickyard.session import kept, local_session
from brickyard.sources import git
from brickyard.sources.lines import write_lines
from brickyard.sources.reader import ReadError
from brickyard.sources.workspace import Revision, Tree, is_workspace, read_config, read_settings

FORMATS = ("html", "github", "text")


def _history(tree: Tree, merged: dict) -> DataFrame | None:
    """History for co-change, or None if that is off or there is none to read."""
    settings = merged.get("co-change")
    if lowest_limit(settings) is None:
        return None
    try:
        return git.log(tree.spark, tree.local, settings["since"])
    except (git.GitError, FileNotFoundError):
        return None


class Measured:
    """One workspace, measured and checked. What is used again is kept, so plans stay small."""

    def __init__(self, tree: Tree | Revision, merged: dict, history: DataFrame | None = None, facts: FactsTable | None = None):
        facts = facts or FactsTable(tree.spark)
        self.tables = Workspace(read_settings(tree), tree.bricks(), facts.of(tree.files()), history)
        for name in ("edges", "references", "libraries", "functions"):
            setattr(self.tables, name, kept(getattr(self.tables, name)))
        self.wide = kept(self.tables.brick_metrics)
        self.findings = kept(self.tables.findings(merged))
        self.violations = kept(thresholds.check(self.wide, self.tables.functions, self.findings, merged))
        self.values = kept(thresholds.filled_values(self.wide, self.findings, self.violations, merged))


def _dicts(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def build_report(tree: Tree, configured: dict, base_ref: str | None, warnings: bool = True, only_new: bool = False, facts_folder: str | None = None) -> tuple[report.Report, bool, bool]:
    """The report, and whether it has errors that are new, and any errors. Only tables of bricks are collected."""
    spark = tree.spark
    merged = merge_config(configured)
    facts = FactsTable(spark, facts_folder)
    head = Measured(tree, merged, _history(tree, merged), facts)
    bricks, violations, edges = head.tables.bricks, head.violations, head.tables.edges
    order = [F.asc("from"), F.asc("interface"), F.asc("to_ord")]
    extra: dict = {}
    if base_ref:
        rev = git.merge_base(tree.local, base_ref)
        was_tree = Revision(spark, tree.local, rev)
        changed = kept(baseline.changed_bricks(bricks, git.changed_files(spark, tree.local, rev)))
        if is_workspace(was_tree):
            base = Measured(was_tree, merged, None, facts)  # parses only what the head doesn't have
            known, was, functions, base_edges = base.violations, base.values, base.tables.functions, base.tables.edges
        else:
            known, was, functions, base_edges = (df.limit(0) for df in (violations, head.values, head.tables.functions, edges))
        violations = kept(baseline.compare(violations, known, changed, was, functions))
        gone = baseline.resolved(known, head.violations)
        edges = baseline.new_edges(edges, base_edges)
        extra = {
            "base_ref": base_ref,
            "changed": {r["brick"] for r in _dicts(changed)},
            "base_values": {(r["brick"], r["metric"]): r["value"] for r in _dicts(was)},
            "resolved": [v for v in _dicts(gone) if warnings or v["level"] == "error"],
        }
    collected_edges = _dicts(edges.orderBy(*order))
    every = kept(thresholds.rows(violations, bricks))
    status = violations.withColumn("status", F.coalesce("status", F.lit("new"))) if base_ref else violations.withColumn("status", F.lit("new"))
    facts = status.agg(F.count_if(F.expr("level = 'error' and status = 'new'")).alias("new"), F.count_if(F.col("level") == "error").alias("all"), F.count_if(F.expr("level = 'warning' and status = 'new'")).alias("warnings"), F.count_if(F.expr("status <> 'new' and level = 'error'")).alias("old_errors"), F.count_if(F.expr("status <> 'new'")).alias("old")).first()
    shown = status
    if not warnings:
        shown = shown.filter("level = 'error'")
        extra["hidden_warnings"] = facts["warnings"]
    if base_ref and only_new:
        shown = shown.filter("status = 'new'")
        extra["hidden_existing"] = facts["old"] if warnings else facts["old_errors"]
    narrowed = not warnings or (base_ref and only_new)
    rows = thresholds.rows(shown if base_ref else shown.drop("status"), bricks) if narrowed else every
    listing = report.Listing(rows, (gone if warnings else gone.filter("level = 'error'")) if base_ref else None)
    checked = [(m.key, list(m.checked)) for m in METRICS.values()]
    peers = head.values.join(F.broadcast(spark.createDataFrame(checked, "metric string, checks array<string>")), "metric").filter(F.array_contains("checks", F.col("type")))
    averages = stats.with_average(peers.select("metric", "brick", "value").filter("value is not null")).filter("brick is null")
    shared = head.tables.libraries.filter("n_bricks > 1").groupBy("library").agg(F.max("n_bricks").alias("n")).orderBy(F.desc("n"), "library")
    found = report.Report(
        workspace=tree.name, bricks=_dicts(bricks.orderBy("ord")), listing=listing, edges=collected_edges, ends=report.graph_ends(every),
        values={(r["brick"], r["metric"]): (r["value"], r["subject"]) for r in _dicts(head.values)}, averages={r["metric"]: r["value"] for r in _dicts(averages)},
        outliers={(r["brick"], r["metric"]): r for r in _dicts(thresholds.outlined(head.wide))}, libraries=_dicts(shared), thresholds=merged,
        configured={k for metrics in configured.values() for k in metrics}, generated_at=datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds"), hazards={r["brick"]: r["hazard-kinds"] for r in _dicts(head.wide.filter("`hazard-kinds` is not null").select("brick", "hazard-kinds"))}, **extra,
    )
    return found, facts["new"] > 0, facts["all"] > 0


def _printed(spark: SparkSession, parts: report.Parts) -> None:
    """The parts' lines, as they come: a partition at a time."""
    for row in report.assembled(spark, parts).orderBy("part", "ord").select("line").toLocalIterator():
        print(row.line)


def _saved(spark: SparkSession, parts: report.Parts, path: str) -> None:
    write_lines(report.assembled(spark, parts), path, "part", "ord")


def _write(spark: SparkSession, kind: str, found: report.Report, options, env: dict) -> None:
    if kind == "text":
        _printed(spark, report.text(found))
    elif kind == "github":
        _printed(spark, report.annotations(found))
        where = env.get("GITHUB_STEP_SUMMARY")
        if where:
            _saved(spark, report.summary(found), f"{where}.brickyard")
            with open(f"{where}.brickyard", "rb") as own, open(where, "ab") as f:  # others write there too
                shutil.copyfileobj(own, f)
            os.remove(f"{where}.brickyard")
        else:
            _printed(spark, report.summary(found))
    else:
        where = options.output or os.path.join(options.workspace, "target", "brickyard", "index.html")
        _saved(spark, report.html(found), where)
        print("Wrote", where)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("brickyard", description="Measure the bricks of a workspace and check them against thresholds.")
    p.add_argument("-w", "--workspace", default=".", help="workspace root")
    p.add_argument("-c", "--config", help="config file (default: brickyard.edn in the workspace, if present)")
    p.add_argument("-b", "--base", help="compare with the merge-base of this ref and HEAD")
    p.add_argument("-f", "--format", action="append", choices=FORMATS, default=None, help="output format; may be repeated")
    p.add_argument("-o", "--output", help="HTML report file")
    p.add_argument("--facts", help="folder of facts by content, read and added to: files measured before aren't parsed again")
    p.add_argument("--fail-on", choices=("new", "all"), help="errors that fail the run (default: new with --base, else all)")
    p.add_argument("--warnings", action=argparse.BooleanOptionalAction, default=False, help="report warnings too")
    p.add_argument("--fail", action=argparse.BooleanOptionalAction, default=True, help="exit with 1 on errors")
    return p


def run(args: list[str], env: dict, spark: SparkSession | None = None) -> int:
    """Exit status: 0, 1 if errors in scope were found, 2 if the run itself failed."""
    try:
        options = _parser().parse_args(args)
    except SystemExit as e:
        return 2 if e.code else 0
    scope = options.fail_on or ("new" if options.base else "all")
    try:
        tree = Tree(spark or local_session(), options.workspace)
        if not is_workspace(tree):
            print(f"Not a workspace (no workspace.edn): {options.workspace}", file=sys.stderr)
            return 2
        configured = read_config(tree, options.config)
        merge_config(configured)
        found, any_new, any_error = build_report(tree, configured, options.base, options.warnings, scope == "new", options.facts)
    except (ConfigError, ReadError, git.GitError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 2
    formats = options.format or ["github" if env.get("GITHUB_ACTIONS") else "html"]
    for kind in dict.fromkeys(formats):
        _write(tree.spark, kind, found, options, env)
    return 1 if options.fail and (any_new if scope == "new" else any_error) else 0


def main() -> None:
    sys.exit(run(sys.argv[1:], dict(os.environ)))


if __name__ == "__main__":
    main()
