"""The registry of metrics, as data; thresholds, reports and queries are driven by it."""

from dataclasses import dataclass, field

COMPONENT, BASE = "component", "base"
BOTH = (BASE, COMPONENT)
SECTIONS = (("dependencies", "Dependencies"), ("complexity", "Complexity"), ("modularity", "Modularity"), ("io", "I/O and mutability"), ("errors", "Error handling"), ("tests", "Tests"))
LEVELS = ("error", "warning")
OUTLIER_STD_DEVS = 2.0


@dataclass(frozen=True)
class Metric:
    key: str
    section: str
    label: str
    about: str
    kind: str = "brick"  # brick, function, finding or count: what a threshold is applied to
    direction: str = "max"
    types: tuple[str, ...] = BOTH  # brick types it describes
    checks: tuple[str, ...] = ()  # brick types it checks; () for types
    default: dict = field(default_factory=dict)
    options: dict = field(default_factory=dict)
    gate: tuple[tuple[str, int], ...] = ()  # other metrics and the least value they must have
    outline: bool = False
    aggregate: str = "count"  # how findings make the brick's value
    measure: str | None = None  # the function's measure
    line: str = "line"
    form: str = "number"  # number, decimal or percent
    precision: int = 2

    @property
    def checked(self) -> tuple[str, ...]:
        return self.checks or self.types


_C = (COMPONENT,)
METRICS: dict[str, Metric] = {}


def register_metric(metric: Metric) -> None:
    """Adds a metric; what follows it in the registry is unchanged."""
    METRICS[metric.key] = metric


for _m in (
    Metric("afferent", "dependencies", "Afferent (Ca)", "bricks that depend on it", types=_C),
    Metric("efferent", "dependencies", "Efferent (Ce)", "interfaces it depends on"),
    Metric("instability", "dependencies", "Instability", "Ce / (Ca + Ce)", types=_C, form="decimal"),
    Metric("unstable-dependencies", "dependencies", "Unstable dependencies", "dependencies on less stable bricks", "finding", default={"error": 0.1}),
    Metric("positional-interface", "dependencies", "Positional interface", "interface functions with many parameters that others call", "finding", types=_C, default={"warning": 4}),
    Metric("co-change", "dependencies", "Co-change", "bricks that change together without depending on each other", "finding", default={"warning": 0.5}, options={"since": "12 months", "min-shared": 5, "max-bricks-per-commit": 5}),
    Metric("forms", "complexity", "Forms", "code forms"),
    Metric("functions", "complexity", "Functions", "functions, macros and methods"),
    Metric("mean-function-complexity", "complexity", "Mean function complexity", "mean cyclomatic complexity", gate=(("functions", 5),), outline=True, form="decimal", precision=1),
    Metric("mean-function-depth", "complexity", "Mean nesting depth", "mean nesting depth", gate=(("functions", 5),), outline=True, form="decimal", precision=1),
    Metric("function-complexity", "complexity", "Complex functions", "functions with many paths", "function", default={"error": 10}, measure="complexity"),
    Metric("function-depth", "complexity", "Deep functions", "functions that nest deeply", "function", default={"warning": 8}, measure="depth", line="depth_line"),
    Metric("function-forms", "complexity", "Long functions", "functions of many forms", "function", default={"warning": 150}, measure="forms"),
    Metric("function-params", "complexity", "Many-parameter functions", "functions with many positional parameters", "function", default={"warning": 4}, measure="params"),
    Metric("abstractness", "modularity", "Abstractness", "share of definitions hidden behind the interface", types=_C, form="decimal"),
    Metric("main-sequence-distance", "modularity", "Main-sequence distance", "|A + I - 1|", types=_C, gate=(("definitions", 10),), outline=True, default={"warning": 0.7}, form="decimal"),
    Metric("cohesion", "modularity", "Cohesion", "share of workspace references that stay inside", direction="min", types=_C, gate=(("workspace-references", 10),), outline=True, default={"warning": 0.5}, form="decimal"),
    Metric("shared-keywords", "modularity", "Shared keywords", "qualified keywords that other bricks use too"),
    Metric("duplicate-code", "modularity", "Duplicated forms", "forms that other bricks repeat", "finding", aggregate="sum", default={"warning": 30}),
    Metric("merge-candidate", "modularity", "Merge into", "size relative to the only dependent", "finding", direction="min", types=_C, aggregate="value", default={"warning": 0.25}, form="percent"),
    Metric("libraries", "io", "Libraries", "external libraries it requires"),
    Metric("library-spread", "io", "Spread libraries", "libraries that many bricks require", "finding", default={"warning": 3}, options={"allow": set()}),
    Metric("interop-density", "io", "Interop density", "host interop for each 100 forms", checks=_C, outline=True, default={"warning": 5}, form="decimal", precision=1),
    Metric("mutable-state", "io", "Mutable state", "definitions of mutable state", "count", checks=_C, default={"warning": 0}),
    Metric("error-surface", "errors", "Error surface", "share of interface definitions that can throw", types=_C, outline=True, form="decimal"),
    Metric("untyped-errors", "errors", "Untyped errors", "throws that callers can't tell apart", "count", checks=_C, default={"warning": 0}),
    Metric("broad-catches", "errors", "Broad catches", "catch-all clauses that don't rethrow", "count", checks=_C, default={"warning": 0}),
    Metric("tests", "tests", "Tests", "tests"),
    Metric("assertions-per-test", "tests", "Assertions per test", "mean assertions of a test", checks=_C, gate=(("tests", 10),), outline=True, default={"warning": {"std-devs": 2}}, form="decimal", precision=1),
    Metric("forms-per-test", "tests", "Forms per test", "mean forms of a test", checks=_C, gate=(("tests", 10),), outline=True, default={"warning": {"std-devs": 2}}, form="decimal", precision=1),
    Metric("untested-interface", "tests", "Untested interface", "share of interface definitions no test mentions", types=_C, gate=(("definitions", 10),), outline=True, default={"warning": 0.5}, form="decimal"),
    Metric("boundary-crossings", "tests", "Boundary crossings", "tests that reach into other bricks", "count", default={"warning": 0}),
    Metric("isolation-hazards", "tests", "Isolation hazards", "things that let tests affect each other"),
    Metric("test-ratio", "tests", "Test ratio", "test forms / source forms", direction="min", outline=True, form="decimal"),
):
    register_metric(_m)
