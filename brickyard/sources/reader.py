"""Reader for Clojure source and EDN: text to a tree of code nodes.

White space, comments and discarded forms (#_) never become nodes. A reader conditional keeps only
its branches' values, of every platform. Lines are 1-based.
"""

from dataclasses import dataclass, field


class ReadError(ValueError):
    pass


class Symbol(str):
    """A symbol's text."""

    __slots__ = ()


class Keyword(str):
    """A keyword's text without its colon."""

    __slots__ = ()


@dataclass(slots=True)
class Node:
    tag: str
    row: int
    text: str = ""  # of tokens; a set of conditional branches has "?" or "?@"
    children: list["Node"] | None = None  # None: not a collection
    end_row: int = 0
    key_prefix: str | None = field(default=None)  # of a keyword that a #:prefix{} map qualifies

    def walk(self):
        """This node and all below it, in reading order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            if node.children:
                stack.extend(reversed(node.children))

    @property
    def value(self):
        """A token's value: str, Symbol, Keyword, bool, None, int, float or its text; other nodes have None."""
        if self.tag == "multi-line" or self.tag != "token":
            return None
        return token_value(self.text, self.key_prefix)

    @property
    def head(self) -> str | None:
        """The unqualified name of a list's leading symbol."""
        if self.tag != "list" or not self.children:
            return None
        value = self.children[0].value
        return local_name(value) if isinstance(value, Symbol) else None

    def source(self) -> str:
        """The node written on one line."""
        if self.children is None:
            return self.text
        inner = " ".join(c.source() for c in self.children)
        opening, closing = _BRACKETS.get(self.tag, (_PREFIXES.get(self.tag, self.text), ""))
        return f"{opening}{inner}{closing}"


_BRACKETS = {"list": ("(", ")"), "vector": ("[", "]"), "map": ("{", "}"), "set": ("#{", "}"), "fn": ("#(", ")"), "?": ("#?(", ")"), "?@": ("#?@(", ")")}
_PREFIXES = {"quote": "'", "syntax-quote": "`", "unquote": "~", "unquote-splicing": "~@", "deref": "@", "meta": "^", "var": "#'", "eval": "#="}
_CLOSERS = {"(": ")", "[": "]", "{": "}"}
_ENDS = set("()[]{}\"; \t\n\r\f,")
_CHARS = {"newline": "\n", "space": " ", "tab": "\t", "return": "\r", "backspace": "\b", "formfeed": "\f"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "\\": "\\", '"': '"'}


def local_name(symbol: str) -> str:
    """The part after the namespace; the symbol / has none."""
    return symbol if symbol == "/" else symbol.split("/", 1)[-1]


def name_space(symbol: str) -> str | None:
    return symbol.split("/", 1)[0] if "/" in symbol and symbol != "/" else None


def _number(text: str):
    body = text[1:] if text[0] in "+-" else text
    if not body[:1].isdigit():
        return None
    for kind in (int, float):
        try:
            return kind(text.rstrip("NM") if kind is int else text.rstrip("M"))
        except ValueError:
            continue
    return text


def _unescape(text: str) -> str:
    out, i = [], 0
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text):
            if text[i + 1] == "u" and len(text) >= i + 6:
                out.append(chr(int(text[i + 2 : i + 6], 16)))
                i += 6
                continue
            out.append(_ESCAPES.get(text[i + 1], text[i + 1]))
            i += 2
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def token_value(text: str, prefix: str | None = None):
    first = text[0]
    if first == '"':
        return _unescape(text[1:-1])
    if first == ":":
        name = text.lstrip(":")
        if prefix and not text.startswith("::"):
            if name.startswith("_/"):
                name = name[2:]
            elif "/" not in name:
                name = f"{prefix}/{name}"
        return Keyword(name)
    if first == "\\":
        return _CHARS.get(text[1:], text[1:2] if len(text) == 2 else text[1:])
    if text in ("nil", "true", "false"):
        return {"nil": None, "true": True, "false": False}[text]
    number = _number(text)
    return Symbol(text) if number is None else number


class Reader:
    """Forms are read by generators that yield the reading of a form inside them; ``_run`` keeps these on a stack of
    its own, so forms may be nested to any depth."""

    def __init__(self, source: str):
        self.source, self.at, self.row = source, 0, 1

    def fail(self, why: str):
        raise ReadError(f"line {self.row}: {why}")

    def _step(self, n: int = 1) -> str:
        taken = self.source[self.at : self.at + n]
        self.row += taken.count("\n")
        self.at += n
        return taken

    @staticmethod
    def _run(reading):
        stack, value = [reading], None
        while stack:
            try:
                inner = stack[-1].send(value)
                stack.append(inner)
                value = None
            except StopIteration as done:
                stack.pop()
                value = done.value
        return value

    def _skip(self):
        """Past what isn't code."""
        s = self.source
        while self.at < len(s):
            c = s[self.at]
            if c.isspace() or c == ",":
                self._step()
            elif c == ";" or s.startswith("#!", self.at):
                end = s.find("\n", self.at)
                self._step((len(s) if end < 0 else end) - self.at)
            elif s.startswith("#_", self.at):
                self._step(2)
                yield self._read()
            else:
                return

    def forms(self) -> list[Node]:
        return self._run(self._forms())

    def _forms(self):
        out = []
        while True:
            yield from self._skip()
            if self.at >= len(self.source):
                return out
            out.append((yield self._read()))

    def _read(self):
        yield from self._skip()
        if self.at >= len(self.source):
            self.fail("a form is missing at the end")
        row = self.row
        node = yield from self._form(row)
        node.end_row = self.row
        return node

    def _until(self, closer: str):
        row, out = self.row, []
        while True:
            yield from self._skip()
            if self.at >= len(self.source):
                self.fail(f"{closer} is missing for line {row}")
            c = self.source[self.at]
            if c == closer:
                self._step()
                return out
            if c in ")]}":
                self.fail(f"{c} does not match")
            out.append((yield self._read()))

    def _form(self, row: int):
        s, c = self.source, self.source[self.at]
        if c in _CLOSERS:
            self._step()
            return Node({"(": "list", "[": "vector", "{": "map"}[c], row, children=(yield from self._until(_CLOSERS[c])))
        if c in ")]}":
            self.fail(f"{c} does not match")
        if c == '"':
            return self._string(row)
        if c == "#":
            return (yield from self._dispatch(row))
        for mark, tag in (("'", "quote"), ("`", "syntax-quote"), ("~@", "unquote-splicing"), ("~", "unquote"), ("@", "deref")):
            if s.startswith(mark, self.at):
                self._step(len(mark))
                return Node(tag, row, children=[(yield self._read())])
        if c == "^":
            self._step()
            return Node("meta", row, children=[(yield self._read()), (yield self._read())])
        if c == "\\":
            end = self.at + 2
            while end < len(s) and s[end] not in _ENDS:
                end += 1
            return Node("token", row, text=self._step(end - self.at))
        return Node("token", row, text=self._token())

    def _token(self) -> str:
        end = self.at
        while end < len(self.source) and self.source[end] not in _ENDS:
            end += 1
        if end == self.at:
            self.fail(f"unexpected {self.source[self.at]!r}")
        return self._step(end - self.at)

    def _quoted(self) -> str:
        end = self.at + 1
        while end < len(self.source) and self.source[end] != '"':
            end += 2 if self.source[end] == "\\" else 1
        if end >= len(self.source):
            self.fail("a string is not closed")
        return self._step(end + 1 - self.at)

    def _string(self, row: int) -> Node:
        text = self._quoted()
        return Node("multi-line" if "\n" in text else "token", row, text=text)

    def _dispatch(self, row: int):
        s = self.source
        after = s[self.at + 1 : self.at + 2]
        if after == "(":
            self._step(2)
            return Node("fn", row, children=(yield from self._until(")")))
        if after == "{":
            self._step(2)
            return Node("set", row, children=(yield from self._until("}")))
        if after == '"':
            self._step()
            return Node("regex", row, text="#" + self._quoted())
        for mark, tag in (("'", "var"), ("=", "eval")):
            if after == mark:
                self._step(2)
                return Node(tag, row, children=[(yield self._read())])
        if after == "^":
            self._step(2)
            return Node("meta", row, children=[(yield self._read()), (yield self._read())])
        if after == "?":
            mark = "?@" if s.startswith("#?@", self.at) else "?"
            self._step(1 + len(mark))
            return Node(mark, row, children=((yield self._read()).children or [])[1::2])
        if after == ":":
            self._step()
            prefix = self._token()
            body = yield self._read()
            for key in (body.children or [])[::2]:
                if key.tag == "token" and key.text.startswith(":"):
                    key.key_prefix = prefix.lstrip(":")
            return Node("namespaced-map", row, children=[Node("map-qualifier", row, text=prefix, end_row=row), body])
        if after == "#":  # symbolic values: ##Inf
            self._step(2)
            return Node("token", row, text="##" + self._token())
        self._step()
        return Node("reader-macro", row, text="#", children=[(yield self._read()), (yield self._read())])


def read_source(source: str) -> list[Node]:
    """The top-level forms of Clojure source."""
    return Reader(source).forms()


def to_python(node: Node):
    """An EDN node's data: dict, list, set, Keyword, Symbol, str, numbers, bool, None."""
    if node.tag == "map":
        items = node.children
        if len(items) % 2:
            raise ReadError(f"line {node.row}: a map needs a value for each key")
        return {_hashable(to_python(k)): to_python(v) for k, v in zip(items[::2], items[1::2], strict=True)}
    if node.tag in ("vector", "list"):
        return [to_python(c) for c in node.children]
    if node.tag == "set":
        return {_hashable(to_python(c)) for c in node.children}
    if node.tag == "multi-line":
        return token_value(node.text)
    if node.tag == "token":
        return node.value
    raise ReadError(f"line {node.row}: {node.source()} is not plain data")


def _hashable(x):
    return tuple(x) if isinstance(x, list) else frozenset(x) if isinstance(x, set) else x


def read_edn(text: str):
    """The first form of EDN text as data, or None if there is none."""
    forms = read_source(text)
    return to_python(forms[0]) if forms else None
