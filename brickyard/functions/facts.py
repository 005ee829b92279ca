"""Facts of one source file, read from its tree: the engine's one Python step.

``file_facts`` turns a file's text into flat records; ``extract`` applies it to a DataFrame of files
in Arrow batches. Everything after that is DataFrame work.
"""

from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from brickyard.sources.reader import Keyword, Node, ReadError, Symbol, local_name, name_space, read_source

# The language's vocabularies that the metrics are defined by.
BINDING_HEADS = set("let let* loop loop* binding with-open with-redefs with-local-vars if-let if-some when-let when-some when-first dotimes for doseq".split())
FN_HEADS = set("fn fn* defn defn- defmacro defmethod".split())
WRAPPERS = set("deref quote syntax-quote unquote unquote-splicing meta".split())
ONE_DECISION = set("if if-not if-let if-some when when-not when-let when-some when-first while catch case".split())
FUNCTION_HEADS = set("defn defn- defmacro defmethod".split())
DEFINITION_HEADS = set("def defn defn- defmacro defmulti defmethod defonce".split())
THROW_HEADS = {"throw", "throw+"}
BROAD = set("Exception java.lang.Exception RuntimeException java.lang.RuntimeException Throwable java.lang.Throwable Object java.lang.Object :default js/Error js/Object".split())
LOG_HEADS = set("log logf log! error errorf warn warnf info infof debug debugf trace tracef fatal fatalf report spy".split())
STATEFUL = {"atom": "atom", "ref": "ref", "agent": "agent", "volatile!": "volatile"}
HAZARD_HEADS = {"with-redefs", "with-redefs-fn", "alter-var-root"}
SYNTAX_KEYWORDS = set(
    "as refer refer-clojure require use import exclude rename only all keys strs syms or let when while else default pre post "
    "private dynamic const doc arglists tag added deprecated gen-class load reload verbose as-alias export".split()
)
REQUIRE_CLAUSES = {"require", "use", "require-macros", "use-macros"}
FRAGMENT_FORMS = 20

SCHEMA = (
    "brick string, type string, dir string, file string, is_test boolean, ord int, ns string, forms long, interop long, error string, "
    "requires array<struct<ord:int,target:string,is_js:boolean,line:int,alias:string,as_alias:string,refer:array<string>>>, "
    "functions array<struct<ord:int,name:string,line:int,complexity:int,depth:int,depth_line:int,forms:int,params:int>>, "
    "definitions array<struct<ord:int,name:string,line:int,private:boolean,throws:boolean,refs:array<string>>>, "
    "keywords array<string>, "
    "fragments array<struct<hash:long,forms:int,line:int,end_line:int>>, "
    "throws array<struct<ord:int,line:int,kind:string>>, "
    "catches array<struct<ord:int,line:int,class:string,broad:boolean,handling:string>>, "
    "mutable_state array<struct<ord:int,name:string,line:int,kind:string>>, "
    "tests array<struct<ord:int,name:string,line:int,forms:int,assertions:int>>, "
    "hazards array<struct<ord:int,line:int,kind:string>>, "
    "test_refs array<string>"
)


def _kids(node: Node) -> list[Node]:
    return node.children or []


def _is(node: Node, tag: str) -> bool:
    return node is not None and node.tag == tag


def _get(items: list[Node], i: int) -> Node | None:
    return items[i] if len(items) > i else None


def _bare(node: Node | None, once: bool = False) -> Node | None:
    """What metadata is attached to; only through one layer if ``once``."""
    while node is not None and node.tag == "meta":
        node = node.children[-1]
        if once:
            break
    return node


def _size(node: Node) -> int:
    return sum(1 for _ in node.walk())


def _symbols(nodes) -> list[str]:
    return sorted({v for top in nodes for n in top.walk() if isinstance(v := n.value, Symbol)})


# -- requires ---------------------------------------------------------------------------------------


def _spliced(nodes: list[Node]) -> list[Node]:
    """Nodes with reader conditionals replaced by what their branches hold."""
    out = []
    for n in nodes:
        if n.tag == "?":
            out += _spliced(_kids(n))
        elif n.tag == "?@":
            out += _spliced([c for branch in _kids(n) for c in _kids(branch)])
        else:
            out.append(n)
    return out


def _is_library(value) -> bool:
    return isinstance(value, str) and not isinstance(value, Keyword)


def _options(nodes: list[Node]) -> dict:
    found = {k.value: v for k, v in zip(nodes[::2], nodes[1::2], strict=False) if isinstance(k.value, Keyword)}
    names = {k: found[k].value for k in ("as", "as-alias") if k in found and isinstance(found[k].value, Symbol)}
    refer = [v for k in ("refer", "refer-macros") if k in found and found[k].tag == "vector" for c in _kids(found[k]) if isinstance(v := c.value, Symbol)]
    return {"alias": names.get("as"), "as_alias": names.get("as-alias"), "refer": refer}


def _require(node: Node, prefix: str = "") -> list[dict]:
    """Requires of one entry: a library, a vector with options, or a prefix list."""

    def one(value, options):
        return {"target": prefix + value, "is_js": not prefix and not isinstance(value, Symbol), "line": node.row, **options}

    if _is_library(node.value):
        return [one(node.value, _options([]))]
    if node.tag not in ("vector", "list"):
        return []
    kids = _spliced(_kids(node))
    head, second = (_get(kids, i) for i in (0, 1))
    value = head.value if head else None
    if second is None or isinstance(second.value, Keyword):
        return [one(value, _options(kids[1:]))] if _is_library(value) else []
    if value is None:
        return []
    return [r for c in kids[1:] for r in _require(c, f"{prefix}{value}.")]


def _namespace(forms: list[Node]) -> tuple[str | None, list[dict]]:
    form = next((f for f in forms if f.head == "ns"), None)
    if form is None:
        return None, []
    name = _bare(_get(form.children, 1))
    found = []
    for clause in _spliced(form.children):
        kids = _kids(clause)
        if kids and isinstance(kids[0].value, Keyword) and kids[0].value in REQUIRE_CLAUSES:
            found += [r for entry in _spliced(kids[1:]) for r in _require(entry)]
    return (name.value if name is not None else None), [{"ord": i, **r} for i, r in enumerate(found)]


# -- nesting and decisions --------------------------------------------------------------------------


@dataclass(slots=True)
class _Deepest:
    """The deepest collection met so far; the first one wins ties."""

    depth: int = 0
    node: Node | None = None

    def meet(self, node: Node, depth: int) -> None:
        if depth > self.depth:
            self.depth, self.node = depth, node


def deepest(node: Node) -> tuple[int, Node | None]:
    """How deep collections nest, and where. Bound values start again at 1; names, parameters and wrapping
    reader macros add nothing."""
    found = _Deepest()
    stack = [(node, 1)]  # read in order, so the first of equal depth is kept
    while stack:
        n, d = stack.pop()
        if n.children is None:
            continue
        if n.tag in WRAPPERS:
            if n.children:
                stack.append((n.children[-1], d))
            continue
        found.meet(n, d)
        stack.extend(reversed(_inside(n, d)))
    return found.depth, found.node


def _inside(n: Node, d: int) -> list[tuple[Node, int]]:
    args, head = n.children[1:], n.head
    first = _get(args, 0)
    if _is(first, "vector") and (head in BINDING_HEADS or head == "letfn"):
        body = [(c, d + 1) for c in args[1:]]
        if head == "letfn":
            return body + [x for f in _kids(first) if f.children is not None for x in [(_Entered(f), 1)]]
        return body + [(v, 1) for v in _bound(first)]
    if head in FN_HEADS:
        return _fn_inside(args[2:] if head == "defmethod" else args, d)
    if isinstance(n, _Entered):
        return _fn_inside(args, d)
    if isinstance(n, _Arity):
        return [(c, d + 1) for c in n.children[1:]]
    return [(c, d + 1) for c in n.children]


class _Entered(Node):
    """A letfn function: like fn."""

    __slots__ = ()

    def __init__(self, n: Node):
        super().__init__("letfn-fn", n.row, n.text, n.children, n.end_row)


class _Arity(Node):
    """One arity: a list that starts with its parameters."""

    __slots__ = ()

    def __init__(self, n: Node):
        super().__init__("arity", n.row, n.text, n.children, n.end_row)


def _fn_inside(args: list[Node], d: int) -> list[tuple[Node, int]]:
    at = next((i for i, a in enumerate(args) if a.tag == "vector"), None)
    if at is not None:
        return [(c, d + 1) for c in args[at + 1 :]]
    return [(_Arity(a), d + 1) for a in args if _kids(a) and a.children[0].tag == "vector"]


def _bound(bindings: Node) -> list[Node]:
    """Values of a binding vector; :let in a comprehension has bindings of its own."""
    kids, out = _kids(bindings), []
    for k, v in zip(kids[::2], kids[1::2], strict=False):
        out += _bound(v) if isinstance(k.value, Keyword) and k.value == "let" else [v]
    return out


def decisions(n: Node) -> int:
    """Decision points that a form itself adds."""
    head = n.head
    if head is None:
        return 0
    args = n.children[1:]
    if head in ONE_DECISION:
        return 1
    if head in ("and", "or"):
        return max(0, len(args) - 1)
    if head in ("cond->", "cond->>"):
        return max(0, len(args) - 1) // 2
    if head == "condp":
        return max(0, len(args) - 2) // 2
    if head == "cond":
        clauses = len(args) // 2
        last = args[2 * clauses - 2].value if clauses else None
        return clauses - (isinstance(last, Keyword) or last is True)
    if head in ("for", "doseq"):
        return sum(isinstance(c.value, Keyword) and c.value in ("when", "while") for c in _kids(args[0])) if args else 0
    if head in FN_HEADS and head != "defmethod" and not any(a.tag == "vector" for a in args):
        return max(0, sum(a.tag == "list" for a in args) - 1)
    return 0


def _function(n: Node) -> dict:
    args = n.children[1:]
    name = _bare(_get(args, 0), once=True)
    text = name.source() if name else ""
    if n.head == "defmethod":
        text += f" {args[1].source()}" if len(args) > 1 else ""
        args = args[2:]
    vectors = [a for a in args if a.tag == "vector"][:1] or [a.children[0] for a in args if _kids(a) and a.children[0].tag == "vector"]
    params = 0
    for v in vectors:
        names = [c.text for c in v.children]
        params = max(params, names.index("&") if "&" in names else len(names))
    depth, at = deepest(n)
    return {"name": text, "line": n.row, "complexity": 1 + sum(decisions(x) for x in n.walk()), "depth": depth, "depth_line": at.row if at else n.row, "forms": _size(n), "params": params}


# -- definitions, errors, state ---------------------------------------------------------------------


def _private(head: str, name: Node | None) -> bool:
    if head == "defn-":
        return True
    while name is not None and name.tag == "meta":
        mark, name = name.children
        if isinstance(mark.value, Keyword) and mark.value == "private":
            return True
        kids = _kids(mark) if mark.tag == "map" else []
        if any(isinstance(k.value, Keyword) and k.value == "private" and v.value is True for k, v in zip(kids[::2], kids[1::2], strict=False)):
            return True
    return False


def _definition(n: Node) -> dict | None:
    head, name, body = n.children[0], _get(n.children, 1), n.children[2:]
    bare = _bare(name, once=True)
    value = bare.value if bare is not None else None
    if not isinstance(value, Symbol):
        return None
    throws = any(x.head in THROW_HEADS for b in body for x in b.walk())
    return {"name": value, "line": n.row, "private": _private(head.text, name), "throws": throws, "refs": _symbols(body)}


class _Keywords:
    """Reads keywords as the file's namespace would."""

    def __init__(self, ns: str | None, requires: list[dict]):
        self.ns = ns or "user"
        self.alias = {a: r["target"] for r in requires for a in (r["alias"], r["as_alias"]) if a}

    def of(self, n: Node) -> str | None:
        value = n.value
        if not isinstance(value, Keyword):
            return None
        if not n.text.startswith("::"):
            return value
        space = name_space(value)
        return f"{self.alias.get(space, space)}/{local_name(value)}" if space else f"{self.ns}/{value}"


def _branches(n: Node | None) -> list[Node | None]:
    return _kids(n) if n is not None and n.tag in ("?", "?@") else [n]


def _typed(data: Node, read: _Keywords) -> bool:
    keys = [read.of(k) for k in _kids(data)[::2]]
    return any(k is not None and (local_name(k) == "type" or k == "cognitect.anomalies/category") for k in keys)


def _thrown(n: Node | None, read: _Keywords) -> str:
    if _is(n, "map"):
        return "typed" if _typed(n, read) else "untyped"
    if n is not None and n.head == "ex-info":
        data = _get(n.children, 2)
        return "unknown" if not _is(data, "map") else "typed" if _typed(data, read) else "untyped"
    if _is(n, "list") and n.children:
        makers = [b.value for b in _branches(n.children[0]) if b is not None]
        if any(isinstance(v, Symbol) and (local_name(v) == "new" or v.endswith(".")) for v in makers):
            return "host"
    return "rethrow"


def _throw_kind(n: Node, read: _Keywords) -> str:
    kinds = [_thrown(b, read) for b in _branches(_get(n.children, 1))] or ["rethrow"]
    return next((k for k in ("host", "untyped") if k in kinds), kinds[0])


def _catch(n: Node) -> dict:
    caught = _get(n.children, 1)
    heads = {x.head for c in n.children[3:] for x in c.walk()}
    handling = "rethrows" if heads & THROW_HEADS else "logs" if heads & LOG_HEADS else "continues"
    broad = any(b is not None and b.source() in BROAD for b in _branches(caught))
    return {"line": n.row, "class": caught.source() if caught is not None else None, "broad": broad, "handling": handling}


def _class_name(s: str | None) -> bool:
    return bool(s) and s.split(".")[-1][:1].isupper()


def is_interop(n: Node) -> bool:
    value = n.value
    if not isinstance(value, Symbol):
        return False
    space, name = name_space(value), local_name(value)
    if space is not None:
        return _class_name(space) or space == "js"
    long = len(name) > 1
    return name == "new" or long and name.startswith(".") or long and name.endswith(".") and _class_name(name[:-1])


def _mutable(forms: list[Node]) -> list[dict]:
    out = []
    for n in forms:
        if n.head not in ("def", "defonce"):
            continue
        name = _get(n.children, 1)
        bare = _bare(name)
        if bare is None or not isinstance(bare.value, Symbol):
            continue
        dynamic = any(isinstance(x.value, Keyword) and x.value == "dynamic" for x in name.walk())
        kind = "dynamic" if dynamic else STATEFUL.get(n.children[-1].head) if len(n.children) > 2 else None
        if kind:
            out.append({"name": bare.value, "line": n.row, "kind": kind})
    for top in forms:
        for n in top.walk():
            if n.head == "alter-var-root":
                target = _get(n.children, 1)
                out.append({"name": target.source() if target is not None else None, "line": n.row, "kind": "alter-var-root"})
    return out


def _hazards(forms: list[Node]) -> list[dict]:
    out = []
    for top in forms:
        for n in top.walk():
            if n.head in HAZARD_HEADS:
                out.append({"line": n.row, "kind": n.head})
            elif n.head == "sleep" and n.children[0].text == "Thread/sleep":
                out.append({"line": n.row, "kind": "sleep"})
    return out + [{"line": m["line"], "kind": m["kind"]} for m in _mutable(forms) if m["kind"] != "alter-var-root"]


def _fragments(forms: list[Node]) -> list[dict]:
    """Subtrees of some size with a hash of their content, bottom up, whatever their layout."""
    out = []
    for top in forms:
        if top.head == "ns":
            continue
        done: dict[int, tuple[int, bytes]] = {}
        for n in reversed(list(top.walk())):  # children before parents
            if n.children is None:
                done[id(n)] = (1, b"t" + n.text.encode())
                continue
            parts = [done.pop(id(c)) for c in n.children]
            size = 1 + sum(p[0] for p in parts)
            digest = xxhash.xxh3_128_digest(n.tag.encode() + b"\0" + b"\0".join(len(p[1]).to_bytes(4) + p[1] for p in parts))
            done[id(n)] = (size, digest)
            if size >= FRAGMENT_FORMS:
                out.append({"hash": int.from_bytes(digest[:8], signed=True), "forms": size, "line": n.row, "end_line": n.end_row})
    return out


def _numbered(rows: list[dict]) -> list[dict]:
    return [{"ord": i, **r} for i, r in enumerate(rows)]


def file_facts(source: str, is_test: bool) -> dict:
    """Facts of a file's text, by the names of SCHEMA; tests and sources have different ones."""
    forms = read_source(source)
    ns, requires = _namespace(forms)
    facts = {"ns": ns, "requires": requires, "forms": sum(map(_size, forms))}
    nodes = [n for f in forms for n in f.walk()]
    if is_test:
        tests = [
            {"name": name.value if (name := _bare(_get(f.children, 1), once=True)) is not None else None, "line": f.row, "forms": _size(f), "assertions": sum(n.head in ("is", "are") for n in f.walk())}
            for f in forms
            if f.head == "deftest"
        ]
        return facts | {"tests": _numbered(tests), "hazards": _numbered(_hazards(forms)), "test_refs": _symbols(forms)}
    read = _Keywords(ns, requires)
    keywords = {k for f in forms if f.head != "ns" for n in f.walk() if (k := read.of(n)) is not None and k not in SYNTAX_KEYWORDS}
    return facts | {
        "functions": _numbered([_function(f) for f in forms if f.head in FUNCTION_HEADS]),
        "definitions": _numbered([d for f in forms if f.head in DEFINITION_HEADS and (d := _definition(f))]),
        "keywords": sorted(keywords),
        "fragments": _fragments(forms),
        "throws": _numbered([{"line": n.row, "kind": _throw_kind(n, read)} for n in nodes if n.head in THROW_HEADS]),
        "catches": _numbered([_catch(n) for n in nodes if n.head == "catch"]),
        "mutable_state": _numbered(_mutable(forms)),
        "interop": sum(map(is_interop, nodes)),
    }


def extract(files: DataFrame) -> DataFrame:
    """files(brick, type, dir, file, is_test, ord, source) -> one row of facts a file (see SCHEMA).

    A file that can't be read has its error and no facts. Null source counts as empty.
    """
    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))
    keep = ("brick", "type", "dir", "file", "is_test", "ord")

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                try:
                    facts = file_facts(row["source"] or "", row["is_test"])
                except (ReadError, RecursionError) as e:  # the second: a require or binding form nested without end
                    facts = {"error": str(e), "forms": 0}
                rows.append({k: row[k] for k in keep} | facts)
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select(*keep, "source").mapInArrow(run, SCHEMA)
