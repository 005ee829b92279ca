"""From facts to metrics and findings: tables of a workspace, its edges, brick metrics and findings."""

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickyard.operators import code, graph, paths
from brickyard.plans.config import lowest_limit
from brickyard.session import kept
from brickyard.sources.workspace import Settings

FINDINGS = "metric string, brick string, type string, subject string, value double, file string, line int, loc_name string, message string, historical boolean, ord long"


def trimmed(x: Column) -> Column:
    """Two decimals without trailing zeros."""
    return F.regexp_replace(F.format_string("%.2f", x.cast("double")), r"\.?0+$", "")


def _round_percent(x: Column) -> Column:
    return F.floor(x * 100 + 0.5).cast("string")


@dataclass
class Workspace:
    """Tables of one workspace: bricks(ord, brick, type, dir) and facts (a row a file)."""

    settings: Settings
    bricks: DataFrame
    facts: DataFrame
    commits: DataFrame | None = None  # (commit, path)

    # -- child tables -------------------------------------------------------------------------------

    def _child(self, column: str, test: bool, also: tuple[str, ...] = ()) -> DataFrame:
        rows = self.facts.filter(F.col("is_test") == test)
        return rows.select("brick", "type", "file", "ns", *also, F.explode(column).alias("x")).select("brick", "type", "file", "ns", *also, "x.*")

    @cached_property
    def sources(self) -> DataFrame:
        return self.facts.filter(~F.col("is_test")).select("brick", "type", "dir", "file", "ns", "forms", "interop")

    @cached_property
    def requires(self) -> DataFrame:
        return self._child("requires", False)

    @cached_property
    def definitions(self) -> DataFrame:
        return self._child("definitions", False)

    @cached_property
    def functions(self) -> DataFrame:
        f = self._child("functions", False)
        return f.withColumn("id", F.when(F.col("ns").isNull(), F.col("name")).otherwise(F.concat_ws("/", "ns", "name")))

    @cached_property
    def segments(self) -> DataFrame:
        """(brick, own): most of a brick's namespaces are in this segment."""
        seg = self.sources.withColumn("own", code.segment(F.col("ns"), self.settings.top))
        return self.bricks.select("brick").join(graph.mode_first(seg, "brick", "own", "file"), "brick", "left")

    def is_interface(self, ns: Column, seg: Column) -> Column:
        return code.is_interface(ns, self.settings.top, seg, self.settings.interface)

    # -- dependencies -------------------------------------------------------------------------------

    @cached_property
    def edges(self) -> DataFrame:
        """from, to, interface, file, line: to each component of a required interface, at the first require."""
        seg = self.requires.withColumn("interface", code.segment(F.col("target"), self.settings.top)).join(self.segments, "brick", "left")
        foreign = seg.filter(F.col("interface").isNotNull() & ~F.col("interface").eqNullSafe(F.col("own")))
        first = graph.first_of(foreign, ["brick", "interface"], [F.asc("file"), F.asc("ord")])
        makers = self.bricks.filter(F.col("type") == "component").join(self.segments, "brick").select(F.col("own").alias("interface"), F.col("brick").alias("to"), F.col("ord").alias("to_ord"))
        return first.join(makers, "interface").select(F.col("brick").alias("from"), "to", "interface", "file", "line", "to_ord")

    def _lookup(self, is_test: bool) -> DataFrame:
        """How names resolve in each file: kind 0 own, 1 refer, 2 alias, 3 required namespace."""
        req = self._child("requires", is_test)
        parts = [
            req.filter("alias is not null").select("file", F.lit(2).alias("kind"), F.col("alias").alias("name"), "target", "ord"),
            req.select("file", F.lit(3).alias("kind"), F.col("target").alias("name"), "target", "ord"),
            req.select("file", "target", "ord", F.explode("refer").alias("name")).select("file", F.lit(1).alias("kind"), "name", "target", "ord"),
        ]
        if not is_test:
            parts.append(self.definitions.select("file", F.lit(0).alias("kind"), "name", F.col("ns").alias("target"), "ord"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        # A later require of one alias or name replaces an earlier one.
        return out.groupBy("file", "kind", "name").agg(F.max_by("target", "ord").alias("target"))

    def _resolve(self, symbols: DataFrame, is_test: bool) -> DataFrame:
        """symbols(file, symbol, ...) with what each refers to: to_ns, to_name; unknown ones go."""
        qualified = F.col("symbol").contains("/") & (F.col("symbol") != "/")
        s = symbols.withColumn("_q", F.when(qualified, F.split_part("symbol", F.lit("/"), F.lit(1))))
        s = s.withColumn("to_name", F.when(qualified, F.substring_index("symbol", "/", -1)).otherwise(F.col("symbol")))
        look = self._lookup(is_test).withColumnRenamed("file", "_file")
        fits = F.when(F.col("_q").isNull(), (F.col("kind") < 2) & (F.col("name") == F.col("symbol"))).otherwise((F.col("kind") >= 2) & (F.col("name") == F.col("_q")))
        key = F.coalesce("_q", "symbol")
        joined = s.join(look, (s["file"] == F.col("_file")) & (F.col("name") == key) & fits)
        keys = symbols.columns + ["to_name"]
        return joined.groupBy(*keys).agg(F.min_by("target", "kind").alias("to_ns")).filter("to_ns is not null")

    @cached_property
    def references(self) -> DataFrame:
        """Resolved references: brick, type, file, ns, name (of the definition), ord, to_ns, to_name."""
        refs = self.definitions.select("brick", "type", "file", "ns", "name", "ord", F.explode("refs").alias("symbol")).withColumnRenamed("name", "def_name")
        return self._resolve(refs, False)

    @cached_property
    def calls(self) -> DataFrame:
        """brick, ns, def_name, to_ns, to_name and how many references: resolved once for all that is made of them."""
        return kept(self.references.groupBy("brick", "ns", "def_name", "to_ns", "to_name").agg(F.count("*").alias("n")))

    @cached_property
    def interface_definitions(self) -> DataFrame:
        d = self.definitions.join(self.segments, "brick")
        return d.filter(~F.col("private") & self.is_interface(F.col("ns"), F.col("own")))

    @cached_property
    def used(self) -> DataFrame:
        """(segment, name) that other bricks refer to."""
        r = self.calls.join(self.segments, "brick", "left").withColumn("segment", code.segment(F.col("to_ns"), self.settings.top))
        return r.filter(F.col("segment").isNotNull() & ~F.col("segment").eqNullSafe(F.col("own"))).select("segment", F.col("to_name").alias("name")).distinct()

    @cached_property
    def libraries(self) -> DataFrame:
        r = self.requires.filter(code.is_external(F.col("target"), F.col("is_js"), self.settings.top))
        return code.libraries(r.select("brick", "file", "line", F.struct("file", "ord").alias("ord"), "target", "is_js"))

    # -- brick metrics ------------------------------------------------------------------------------

    @cached_property
    def brick_metrics(self) -> DataFrame:
        """One row a brick: every metric that is not made from findings, by its key."""
        b = self.bricks.select("ord", "brick", "type", "dir")
        component = F.col("type") == "component"
        src = self.sources.groupBy("brick").agg(F.sum("forms").alias("forms"), F.sum("interop").alias("_interop"))
        fun = self.functions.groupBy("brick").agg(F.count("*").alias("functions"), F.avg("complexity").alias("mean-function-complexity"), F.avg("depth").alias("mean-function-depth"))
        defs = self.definitions.groupBy("brick").agg(F.count("*").alias("definitions"))
        facade = self.interface_definitions
        intf = facade.groupBy("brick").agg(F.count("*").alias("_facade"))
        tests = self._child("tests", True).groupBy("brick").agg(F.count("*").alias("tests"), F.avg("assertions").alias("assertions-per-test"), F.avg("forms").alias("forms-per-test"))
        by_kind = self._child("hazards", True).groupBy("brick", "kind").agg(F.count("*").alias("n"))
        hazards = by_kind.groupBy("brick").agg(F.sum("n").alias("isolation-hazards"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("hazard-kinds"))
        test_forms = self.facts.filter("is_test").groupBy("brick").agg(F.sum("forms").alias("_test_forms"))
        seg = code.segment(F.col("to_ns"), self.settings.top)
        refs = self.calls.join(self.segments, "brick", "left").filter(seg.isNotNull()).groupBy("brick").agg(F.sum("n").alias("workspace-references"), F.sum(F.when(seg.eqNullSafe(F.col("own")), F.col("n")).otherwise(0)).alias("_inside"))
        words = self.facts.filter(~F.col("is_test")).select("brick", F.explode("keywords").alias("keyword")).filter(F.col("keyword").contains("/"))
        shared = code.shared_counts(words, "brick", "keyword").withColumnRenamed("shared", "shared-keywords")
        libs = self.libraries.groupBy("brick").agg(F.count("*").alias("libraries"))
        untested = self.untested.groupBy("brick").agg(F.count("*").alias("_untested"))
        throwing = facade.join(self.throwing.withColumnRenamed("ns", "_ns").withColumnRenamed("name", "_name"), F.col("ns").eqNullSafe(F.col("_ns")) & (F.col("name") == F.col("_name")), "left_semi").groupBy("brick").agg(F.count("*").alias("_throwing"))
        deps = graph.dependency_metrics(self.bricks, self.edges)
        for part in (src, fun, defs, intf, tests, hazards, test_forms, refs, shared, libs, untested, throwing, deps):
            b = b.join(part, "brick", "left")
        zero = ["forms", "functions", "definitions", "tests", "isolation-hazards", "shared-keywords", "libraries", "_facade", "_untested", "_throwing", "workspace-references", "_inside", "_interop", "_test_forms"]
        b = b.fillna(0, zero)
        c = {k: F.col(f"`{k}`") for k in ("forms", "definitions", "workspace-references")}
        b = b.withColumn("abstractness", F.when(component & (c["definitions"] > 0), 1.0 - F.col("_facade") / c["definitions"]))
        of_component = lambda x: F.when(component, x)
        return b.withColumns(
            {
                "main-sequence-distance": F.abs(F.col("abstractness") + F.col("instability") - 1.0),
                "cohesion": of_component(F.try_divide(F.col("_inside").cast("double"), c["workspace-references"])),
                "interop-density": F.try_divide(F.col("_interop") * 100.0, c["forms"]),
                "test-ratio": F.try_divide(F.col("_test_forms").cast("double"), c["forms"]),
                "error-surface": of_component(F.try_divide(F.col("_throwing").cast("double"), F.col("_facade"))),
                "untested-interface": of_component(F.try_divide(F.col("_untested").cast("double"), F.col("_facade"))),
                "throwing-interface": of_component(F.col("_throwing")),
                "interface-definitions": of_component(F.col("_facade")),
                "untested-definitions": of_component(F.col("_untested")),
                "workspace-references": of_component(c["workspace-references"]),
            }
        ).drop("_facade", "_untested", "_throwing", "_inside", "_interop", "_test_forms")

    @cached_property
    def throwing(self) -> DataFrame:
        """(ns, name) of definitions that throw, or refer to one that does."""
        name = lambda ns, n: F.concat(F.coalesce(ns, F.lit("")), F.lit("\0"), n)
        calls = kept(self.calls.select(name(F.col("ns"), F.col("def_name")).alias("a"), name(F.col("to_ns"), F.col("to_name")).alias("b")).distinct())  # each round reads them
        seeds = self.definitions.filter("throws").select(name(F.col("ns"), F.col("name")).alias("node"))
        found = graph.reach_back(calls, seeds)
        return found.select(F.nullif(F.substring_index("node", "\0", 1), F.lit("")).alias("ns"), F.substring_index("node", "\0", -1).alias("name"))

    @cached_property
    def untested(self) -> DataFrame:
        """Interface definitions that no test mentions."""
        symbols = self.facts.filter("is_test").select("file", F.explode("test_refs").alias("symbol"))
        seen = self._resolve(symbols, True).select(F.col("to_ns").alias("_ns"), F.col("to_name").alias("_name")).distinct()
        return self.interface_definitions.join(seen, (F.col("ns") == F.col("_ns")) & (F.col("name") == F.col("_name")), "left_anti")

    # -- findings -----------------------------------------------------------------------------------

    def findings(self, settings: dict[str, dict | None]) -> DataFrame:
        """All findings in one long table (see FINDINGS); settings decide what is looked for."""
        parts = [self._unstable(), self._positional(), self._merge(), self._state(), self._catches(), self._untyped(), self._crossings(), self._spread(settings.get("library-spread"))]
        limit = lowest_limit(settings.get("duplicate-code"))
        if limit is not None:
            parts.append(self._duplicates(limit))
        change = settings.get("co-change")
        if self.commits is not None and change and lowest_limit(change) is not None:
            parts.append(self._co_change(change))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _finding(self, df: DataFrame, metric: str, order: list, subject, message, value=None, file=None, line=None, name=None, historical=False) -> DataFrame:
        null = F.lit(None)
        rows = df.join(self.bricks.select("brick", F.col("type").alias("_type"), F.col("ord").alias("_ord")), "brick")
        return rows.select(
            F.lit(metric).alias("metric"), "brick", F.col("_type").alias("type"), (subject if subject is not None else null).cast("string").alias("subject"),
            (value if value is not None else null).cast("double").alias("value"), (file if file is not None else null).cast("string").alias("file"), (line if line is not None else null).cast("int").alias("line"),
            (name if name is not None else null).cast("string").alias("loc_name"), message.alias("message"), F.lit(historical).alias("historical"),
            (F.col("_ord").cast("long") * F.lit(1 << 32) + F.row_number().over(Window.partitionBy("brick").orderBy(*order))).alias("ord"),  # by brick: no task orders all findings
        )

    def _unstable(self) -> DataFrame:
        e = graph.unstable_edges(self.edges, graph.dependency_metrics(self.bricks, self.edges)).withColumn("brick", F.col("from"))
        message = F.concat(F.lit("uses "), "to", F.lit(", whose instability of "), trimmed(F.col("i_to")), F.lit(" exceeds its own "), trimmed(F.col("i_from")))
        return self._finding(e, "unstable-dependencies", ["interface", "to_ord"], F.col("to"), message, F.col("gap"), F.col("file"), F.col("line"))

    def _positional(self) -> DataFrame:
        own = self.functions.filter(F.col("type") == "component").join(self.segments, "brick")
        own = own.filter(self.is_interface(F.col("ns"), F.col("own")))
        used = self.used.select(F.col("segment").alias("_s"), F.col("name").alias("_n"))
        f = own.join(used, (F.col("own") == F.col("_s")) & (F.col("name") == F.col("_n")), "left_semi")
        message = F.concat(F.lit("callers in other bricks must know the order of its "), F.col("params").cast("string"), F.lit(" arguments; named ones in a map would bind them less"))
        return self._finding(f, "positional-interface", ["file", "ord"], F.col("name"), message, F.col("params"), F.col("file"), F.col("line"), F.col("name"))

    def _merge(self) -> DataFrame:
        sizes = self.sources.groupBy("brick").agg(F.sum("forms").alias("forms"))
        b = self.bricks.filter(F.col("type") == "component").select("brick").join(sizes, "brick", "left").fillna(0, ["forms"])
        other = b.select(F.col("brick").alias("dependent"), F.col("forms").alias("_forms")).filter("_forms > 0")
        m = b.join(graph.sole_dependents(self.edges), "brick").join(other, "dependent").withColumn("share", F.col("forms").cast("double") / F.col("_forms"))
        message = F.concat(F.lit("serves "), "dependent", F.lit(" alone and has "), _round_percent(F.col("share")), F.lit("% of its forms; the two could be one component"))
        return self._finding(m, "merge-candidate", ["brick"], F.col("dependent"), message, F.col("share"))

    def _state(self) -> DataFrame:
        s = self._child("mutable_state", False).join(self.segments, "brick", "left")
        texts = {"atom": "holds state in an atom", "ref": "holds state in a ref", "agent": "holds state in an agent", "volatile": "holds state in a volatile", "dynamic": "rebinds state through a dynamic var"}
        what = F.concat(F.lit("replaces the root value of "), F.coalesce("name", F.lit("")))
        for kind, text in texts.items():
            what = F.when(F.col("kind") == kind, text).otherwise(what)
        where = F.when(self.is_interface(F.col("ns"), F.col("own")), " (part of the interface: all users see its changes)").otherwise(" (internal: results depend on what was called before)")
        return self._finding(s, "mutable-state", ["file", "ord"], F.col("name"), F.concat(what, where), None, F.col("file"), F.col("line"), F.col("name"))

    def _at(self) -> Column:
        return F.concat("file", F.lit(":"), F.col("line").cast("string"))

    def _catches(self) -> DataFrame:
        c = self._child("catches", False).filter("broad and handling <> 'rethrows'")
        message = F.concat(F.lit("a handler for "), "class", F.when(F.col("handling") == "logs", " only writes a log entry").otherwise(" drops the error"), F.lit(", so callers never learn of the failure"))
        return self._finding(c, "broad-catches", ["file", "ord"], self._at(), message, None, F.col("file"), F.col("line"))

    def _untyped(self) -> DataFrame:
        t = self._child("throws", False).filter(F.col("kind").isin("untyped", "host"))
        message = F.when(F.col("kind") == "untyped", "the data of this ex-info has no :type to dispatch on").otherwise("an exception of the host platform carries no data to dispatch on")
        return self._finding(t, "untyped-errors", ["file", "ord"], self._at(), message, None, F.col("file"), F.col("line"))

    def _crossings(self) -> DataFrame:
        tests = self.facts.filter("is_test and ns is not null").select(F.col("ns").alias("_test_ns")).distinct()
        r = self._child("requires", True).join(self.segments, "brick", "left").withColumn("_seg", code.segment(F.col("target"), self.settings.top))
        r = r.filter(F.col("_seg").isNotNull() & ~F.col("_seg").eqNullSafe(F.col("own")) & ~self.is_interface(F.col("target"), F.col("_seg"))).join(tests, F.col("target") == F.col("_test_ns"), "left_anti")
        message = F.concat(F.lit("this test reaches past the interface of "), "_seg", F.lit(" into "), "target")
        return self._finding(r, "boundary-crossings", ["file", "ord"], F.concat_ws(" ", "file", "target"), message, None, F.col("file"), F.col("line"))

    def _spread(self, settings: dict | None) -> DataFrame:
        allowed = [str(x) for x in (settings or {}).get("allow") or ()]
        all_of = self.libraries.groupBy("library").agg(F.sort_array(F.collect_set("brick")).alias("_all"))
        s = self.libraries.filter((F.col("n_bricks") > 1) & ~F.col("library").isin(allowed)).join(all_of, "library")
        others = F.filter("_all", lambda x: x != F.col("brick"))
        message = F.concat("library", F.lit(" is used here and by "), F.array_join(others, ", "))
        return self._finding(s, "library-spread", [F.desc("n_bricks"), "library"], F.col("library"), message, F.col("n_bricks"), F.col("file"), F.col("line"))

    def _duplicates(self, limit: float) -> DataFrame:
        fragments = self._child("fragments", False)
        d = code.duplicates(fragments.select("brick", "file", "hash", "forms", "line", "end_line"), limit)
        # A hash's bricks in order of their first occurrences: the first other one is one of the first two.
        every = fragments.filter(F.col("forms") > limit).groupBy("hash", F.col("brick").alias("_b")).agg(F.min(F.struct("file", "line")).alias("_at"))
        firsts = every.groupBy("hash").agg(F.slice(F.sort_array(F.collect_list(F.struct("_at", "_b"))), 1, 2).alias("_firsts"), F.sort_array(F.collect_list("_b")).alias("_bricks"))
        d = d.join(firsts, "hash").withColumn("_first", F.filter("_firsts", lambda x: x["_b"] != F.col("brick"))[0]["_at"])
        d = d.withColumn("_names", F.array_join(F.filter("_bricks", lambda x: x != F.col("brick")), ", "))
        message = F.concat(F.lit("the same "), F.col("forms").cast("string"), F.lit(" forms stand in "), "_names", F.lit(", for instance at "), "_first.file", F.lit(":"), F.col("_first.line").cast("string"))
        return self._finding(d, "duplicate-code", ["file", "line", "hash"], F.col("hash"), message, F.col("forms"), F.col("file"), F.col("line"))

    def _co_change(self, settings: dict) -> DataFrame:
        touched = paths.owners(self.commits.select("commit", "path"), self.bricks).select("commit", "brick")
        pairs = graph.co_changes(touched, settings["max-bricks-per-commit"]).filter(F.col("shared") >= settings["min-shared"])
        hidden = graph.unconnected(pairs, "fewer", "more", self.edges).withColumn("brick", F.col("fewer"))
        message = F.concat(F.col("shared").cast("string"), F.lit(" of "), F.col("changes").cast("string"), F.lit(" commits ("), _round_percent(F.col("strength")), F.lit("%) also change "), "more", F.lit(", with no dependency either way"))
        return self._finding(hidden, "co-change", ["fewer", "more"], F.col("more"), message, F.col("strength"), historical=True)
