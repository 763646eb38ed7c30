"""Modules, types, functions, imports and calls of languages with braces.

A file's tokens are read once, in order, with the scope they stand in.  Rules of
a language tell at a token whether a declaration begins there, where it ends and
what of it is read further: bodies of types are, bodies of functions and methods
are read for calls only.  Blocks, modules, namespaces and functions without a
name belong to the scope around them.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from dataclasses import dataclass

from stemma.sources.lexing import SCRIPTS, Tokens

LANGUAGES = (*SCRIPTS, "java", "go", "rust", "c", "cpp")
#: Words before a bracket that make no call.
NO_CALL = {
    "javascript": "if for while switch catch return function typeof instanceof in of do else case delete void throw new await yield async with",
    "go": "if for switch select return func defer go range case type struct interface map chan var const import else",
    "rust": "if while for match return fn let in as impl where loop else move unsafe pub crate use mod struct enum trait dyn ref mut",
    "c": "if for while switch return sizeof do else case typeof alignof _Alignof _Generic __attribute__ __asm__ asm defined goto",
    "cpp": "if for while switch return sizeof do else case typeof alignof decltype noexcept catch throw new delete static_cast dynamic_cast const_cast reinterpret_cast static_assert alignas typeid requires __attribute__ __declspec asm operator co_await co_return co_yield",
}
NO_CALL = {k: set(v.split()) for k, v in NO_CALL.items()}
NO_CALL["typescript"] = NO_CALL["tsx"] = NO_CALL["javascript"]
#: Words that may stand before a call's name, where any other makes it a declaration.
BEFORE_CALL = set("return else do case throw co_await co_return co_yield goto and or not".split())
MEMBER_WORDS = set("public private protected static async get set readonly override abstract declare accessor".split())
#: Words before brackets and braces that are no member's name.
NOT_MEMBERS = set("if for while switch catch with function".split())
RUST_BEFORE = set("pub async const unsafe extern default".split())
#: What may follow the parameters of a function definition of C or C++.
AFTER_PARAMETERS = set("{ const noexcept override final -> : & && try throw volatile __attribute__ requires".split())
#: Signs after which a line break ends nothing.
GOES_ON = set("= + - * / % ? : . , & | ^ ! ~ < ( [ { && || ?? => ?.".split())


@dataclass(slots=True)
class Scope:
    """Where declarations belong: its name's path and id; ``open``: the bracket of a type's body, whose members are methods."""

    path: str
    id: str
    kind: str = "module"
    open: int = -1


class Reader:
    """Rows of nodes and edges of one file."""

    def __init__(self, path: str, text: str, lang: str):
        self.path, self.text, self.lang = path, text, lang
        self.t = Tokens(text, lang)
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.nodes: dict[str, dict] = {}
        self.edges: dict[str, dict] = {}
        self.named: dict[str, str] = {}  # the last definition of a name
        self.types: dict[str, Scope] = {}
        self.bodies: list[tuple[int, int, str]] = []  # first token, last token and node of what calls
        name = path.replace("\\", "/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
        self.top = Scope(name, self._node("module", name, name, None, 0, max(1, len(text)), loc=text.count("\n") + 1))

    # -- rows

    def _node(self, kind: str, name: str, qualified: str, parent: str | None, start: int | None = None, end: int | None = None, loc: int | None = None) -> str:
        own = hashlib.sha256(f"{kind}:{qualified}".encode()).hexdigest()[:16]
        if start is None and own in self.nodes:
            return own
        first = bisect.bisect_right(self.lines, start) if start is not None else None
        last = bisect.bisect_right(self.lines, max(start, end - 1)) if end is not None else None
        seq = self.nodes[own]["seq"] if own in self.nodes else len(self.nodes)
        self.nodes[own] = {"id": own, "name": name, "node_type": kind, "qualified_name": qualified, "file": self.path if start is not None else None, "line": first, "column": start - self.lines[first - 1] if start is not None else None, "end_line": last, "docstring": None, "signature": None, "source_code": self.text[start:end] if end is not None and kind != "module" else None, "parent_id": parent, "tags": [], "cyclomatic_complexity": 0, "lines_of_code": loc if loc is not None else last - first + 1 if last else 0, "depth": 0, "seq": seq}
        return own

    def _edge(self, kind: str, source: str, target: str) -> None:
        own = hashlib.sha256(f"{kind}:{source}->{target}".encode()).hexdigest()[:16]
        self.edges.setdefault(own, {"id": own, "source_id": source, "target_id": target, "edge_type": kind, "weight": 1.0, "file": self.path, "seq": len(self.edges)})

    def declared(self, kind: str, name: str, scope: Scope, first: int, last: int, body: int | None = None) -> str:
        """A node over the tokens first to last; what stands in the brackets at ``body`` calls."""
        own = self._node(kind, name, f"{scope.path}:{name}", scope.id, self.t[first].start, self.t[min(last, len(self.t) - 1)].end)
        self.named[name] = own
        if body is not None:
            self.bodies.append((body, min(self.t[body].pair, len(self.t)), own))
        return own

    def imported(self, name: str, first: int) -> None:
        own = hashlib.sha256(f"external:{name}".encode()).hexdigest()[:16]
        if own not in self.nodes:
            self._node("external", name, name, None, self.t[first].start)
        self._edge("import", self.top.id, own)

    # -- reading

    def read(self) -> tuple[list[dict], list[dict]]:
        rule = getattr(self, f"_{'script' if self.lang in SCRIPTS else 'c' if self.lang == 'cpp' else self.lang}")
        scopes, i = [(len(self.t), self.top)], 0
        while i < len(self.t):
            while i >= scopes[-1][0]:
                scopes.pop()
            i, inner = rule(i, scopes[-1][1])
            if inner:
                scopes.append((min(self.t[inner.open].pair, len(self.t)), inner))
        for first, last, own in self.bodies:
            self._calls(first, last, own)
        return list(self.nodes.values()), list(self.edges.values())

    def _body(self, i: int) -> int | None:
        """The braces that open next, unless a statement ends first."""
        t = self.t
        while i < len(t) and not t.sign(i, ";", "}", ")"):
            if t.sign(i, "{"):
                return i
            i = max(t.angles(i), i + 1) if t.sign(i, "<") else t.after(i)
        return None

    def _type(self, name: str, scope: Scope, first: int, body: int, last: int | None = None) -> Scope:
        own = self.declared("class", name, scope, first, self.t[body].pair if last is None else last)
        self.types[name] = Scope(f"{scope.path}:{name}", own, "class", body)
        return self.types[name]

    def _begins(self, i: int) -> bool:
        """Whether a statement may begin at a token."""
        t = self.t
        return i == 0 or t.sign(i - 1, ";", "{", "}", ")") or t.word(i - 1, "else", "do", "export", "default", "declare") or t.line_break(i) and not (t[i - 1].kind == "sign" and t[i - 1].text in GOES_ON)

    # JavaScript and TypeScript

    def _script(self, i: int, scope: Scope) -> tuple[int, Scope | None]:
        t = self.t
        token = t[i]
        if token.kind == "word" and not t.sign(i - 1, ".", "?."):
            at = i + 1 if token.text == "async" and t.word(i + 1, "function") and not t.line_break(i + 1) else i
            if t.word(at, "function") and t.word(at + 1) and self._begins(i):
                body = self._script_body(at + 2)
                if body is not None:
                    self.declared("function", t[at + 1].text, scope, i, t[body].pair, body)
                    return t[body].pair + 1, None
            if token.text == "class" and (body := self._class_body(i + 1)) is not None:
                if t.word(i + 1) and t[i + 1].text not in ("extends", "implements") and self._begins(i - (t.word(i - 1, "abstract"))):
                    return body + 1, self._type(t[i + 1].text, scope, i, body)
                return body + 1, Scope(scope.path, scope.id, scope.kind, body)
            if token.text == "import" and not t.sign(i + 1, "(", ".") and self._begins(i):
                return self._script_import(i), None
            if token.text in ("const", "let", "var"):
                self._arrows(i + 1, scope)
                return i + 1, None
            if token.text == "interface" and t.word(i + 1) and (body := self._class_body(i + 2)) is not None:
                return t[body].pair + 1, None
        member = token.inside == scope.open and scope.open >= 0 and (t.sign(i - 1, "{", "}", ";") or t.line_break(i) and not (t[i - 1].kind == "sign" and t[i - 1].text in GOES_ON))
        if (member or t.sign(i - 1, "{", ",") and t.sign(token.inside, "{")) and (found := self._member(i)):
            name, body = found
            self.declared("method", name, scope, i, t[body].pair, body)
            return t[body].pair + 1, None
        return i + 1, None

    def _class_body(self, i: int) -> int | None:
        t = self.t
        while i < len(t) and not t.sign(i, ";", "}", ")"):
            if t.sign(i, "{"):
                return i
            i = max(t.angles(i), i + 1) if t.sign(i, "<") else t.after(i)
        return None

    def _script_body(self, i: int) -> int | None:
        """The body of a function whose type parameters or parameters begin at a token."""
        t = self.t
        if t.sign(i, "<"):
            i = t.angles(i)
        if not t.sign(i, "("):
            return None
        i = t.after(i)
        if t.sign(i, ":"):
            i = self._annotation(i + 1)
        return i if t.sign(i, "{") else None

    def _annotation(self, i: int) -> int:
        """What follows a type; braces after a value of it are not part of it."""
        t, open_ = self.t, True
        while i < len(t):
            if t.sign(i, "{"):
                if not open_:
                    return i
                i, open_ = t.after(i), False
            elif t.sign(i, "(", "["):
                i, open_ = t.after(i), False
            elif t.sign(i, "<") and t.angles(i) > i:
                i, open_ = t.angles(i), False
            elif t.sign(i, "|", "&", "=>", ".", "?", ":") or t.word(i, "is", "keyof", "typeof", "extends", "asserts", "readonly", "unique", "infer", "new"):
                i, open_ = i + 1, True
            elif t[i].kind == "sign" or not open_ and t.line_break(i):
                return i
            else:
                i, open_ = i + 1, False
        return i

    def _member(self, i: int) -> tuple[str, int] | None:
        """Name and body of a method that begins at a token."""
        t = self.t
        while t.sign(i, "@") and t.word(i + 1):
            i += 2
            while t.sign(i, ".") and t.word(i + 1):
                i += 2
            if t.sign(i, "("):
                i = t.after(i)
        while t.word(i) and t[i].text in MEMBER_WORDS and not t.sign(i + 1, "(", "=", ";", "<", "?", "!", ":", ",", "}"):
            i += 1
        if t.sign(i, "*"):
            i += 1
        if i >= len(t):
            return None
        if t.sign(i, "["):
            name, i = self.text[t[i].start : t[min(t[i].pair, len(t) - 1)].end], t.after(i)
        elif t[i].kind in ("word", "string", "number") and t[i].text not in NOT_MEMBERS:
            name, i = t[i].text, i + 1
        else:
            return None
        if t.sign(i, "?", "!"):
            i += 1
        body = self._script_body(i)
        return (name, body) if body is not None else None

    def _script_import(self, i: int) -> int:
        t, k = self.t, i + 1
        while k < len(t) and not t.sign(k, ";"):
            if t[k].kind == "string":
                self.imported(t[k].text[1:-1], i)
                return k + 1
            if k > i + 1 and t.line_break(k) and t.word(k) and not t.word(k, "from") and not t.sign(k - 1, ",", "{"):
                break
            if t.sign(k, "{"):
                k = t[k].pair
            k += 1
        return k

    def _arrows(self, i: int, scope: Scope) -> None:
        """Functions without a name of their own that a declaration assigns."""
        t = self.t
        while t.word(i) or t.sign(i, "{", "["):
            name, k = t[i].text, t.after(i)
            if t.sign(k, "!"):
                k += 1
            if t.sign(k, ":"):
                k = self._annotation(k + 1)
            first = k + 1
            if t.sign(k, "=") and t.word(i):
                at = first + 1 if t.word(first, "async") and not t.sign(first + 1, "=>") else first
                if t.sign(at, "<"):
                    at = t.angles(at)
                end = at + 1 if t.word(at) else t.after(at) if t.sign(at, "(") else len(t)
                if t.sign(at, "(") and t.sign(end, ":"):
                    end = self._arrow_sign(end)
                if t.sign(end, "=>"):
                    last = t[end + 1].pair if t.sign(end + 1, "{") else self._expression_end(end + 1) - 1
                    own = self.declared("function", name, scope, first, last)
                    self.bodies.append((at, min(last, len(t) - 1) + 1, own))
            i = self._expression_end(k)
            if not t.sign(i, ","):
                return
            i += 1

    def _arrow_sign(self, i: int) -> int:
        """The arrow after a return type, whose own arrows are in brackets or before it."""
        t, k, found = self.t, i + 1, i
        while k < len(t) and not t.sign(k, ";", ",", ")", "}", "="):
            if t.sign(k, "=>"):
                found = k
                if t.sign(k + 1, "{") or not t.sign(k - 1, ")"):
                    return k
            elif t.sign(k, "{") and found > i:
                return found
            k = max(t.angles(k), k + 1) if t.sign(k, "<") else t.after(k)
        return found

    def _expression_end(self, i: int) -> int:
        """What follows an expression: a sign that ends it, or a line that doesn't go on."""
        t, first = self.t, i
        while i < len(t) and not t.sign(i, ";", ",", ")", "]", "}"):
            if i > first and t.line_break(i) and not (t[i - 1].kind == "sign" and t[i - 1].text in GOES_ON) and not (t[i].kind == "sign" and t[i].text not in ("{", "@", "!", "~")):
                break
            i = t.after(i)
        return i

    # Java

    def _java(self, i: int, scope: Scope) -> tuple[int, Scope | None]:
        t = self.t
        if t.word(i, "import") and scope is self.top:
            end = next((k for k in range(i, len(t)) if t.sign(k, ";")), len(t))
            words = [k for k in range(i + 1, end) if t.word(k) and not t.word(k, "static")]
            if words:
                name = ".".join(t[k].text for k in words)
                self.imported(name if len(words) > 1 else self.text[t[i].start : t[min(end, len(t) - 1)].end][:60], i)
            return end + 1, None
        if t.word(i, "class", "interface", "enum", "record") and t.word(i + 1) and not t.sign(i - 1, ".") and (t.word(i + 1) and t.sign(i + 2, "{", "<", "(") or t.word(i + 2, "extends", "implements", "permits")):
            body = self._body(i + 2)
            if body is None:
                return i + 1, None
            if t.word(i, "record") or t.sign(i - 1, "@"):
                return body + 1, Scope(scope.path, scope.id, "class", body)
            inner = self._type(t[i + 1].text, scope, self._java_first(i), body)
            if t.word(i, "enum"):  # constants come first; theirs are bodies of types without a name
                k = body + 1
                while k < t[body].pair and k < len(t) and not t.sign(k, ";"):
                    k = t.after(k)
                self._anonymous(body + 1, min(k, len(t)), inner)
                return min(k, t[body].pair, len(t)), inner
            return body + 1, inner
        if scope.open >= 0 and t[i].inside == scope.open and t.sign(i - 1, "{", "}", ";"):
            return self._java_member(i, scope)
        return i + 1, None

    def _java_first(self, i: int) -> int:
        """Where the modifiers and annotations before a declaration begin."""
        t = self.t
        while i > 0:
            if t.word(i - 1) and not t.word(i - 1, "package", "import"):
                i -= 1
            elif t.sign(i - 1, "@", "."):
                i -= 1
            elif t.sign(i - 1, ")") and t[i - 1].pair > 1 and t.word(t[i - 1].pair - 1) and self._annotated(t[i - 1].pair - 1):
                i = t[i - 1].pair
            else:
                break
        return i

    def _annotated(self, i: int) -> bool:
        while self.t.sign(i - 1, "."):
            i -= 2
        return self.t.sign(i - 1, "@")

    def _java_member(self, first: int, scope: Scope) -> tuple[int, Scope | None]:
        """A method if the first bracket of a member is that of parameters, else what is read further."""
        t, i = self.t, first
        while i < len(t):
            if t.sign(i, "@") and t.word(i + 1) and not t.word(i + 1, "interface"):
                i += 2
                while t.sign(i, ".") and t.word(i + 1):
                    i += 2
                if t.sign(i, "("):
                    i = t.after(i)
            elif t.word(i, "class", "interface", "enum", "record") and t.word(i + 1) and not t.sign(i + 2, ";", "=", ",") and not (t.sign(i + 2, "(") and not t.word(i, "record")):
                return i, None
            elif t.sign(i, "<"):
                i = max(t.angles(i), i + 1)
            elif t.sign(i, "(") and t.word(i - 1):
                break
            elif t.word(i) or t.sign(i, ".", "[", "@"):
                i = t.after(i)
            else:  # a field, a block
                self._anonymous(i, end := self._statement_end(i), scope)
                return max(end, first + 1), None
        if i >= len(t):
            return len(t), None
        name, k = t[i - 1].text, t.after(i)
        while k < len(t) and not t.sign(k, "{", ";", "}"):
            k = t.after(k)
        last = t[k].pair if t.sign(k, "{") else min(k, len(t) - 1)
        self.declared("method", name, scope, first, last)
        return last + 1, None

    def _statement_end(self, i: int) -> int:
        t = self.t
        while i < len(t) and not t.sign(i, ";", "}"):
            if t.sign(i, "{") and not t.sign(i - 1, "=", "]", ")", ",", "->"):
                return t.after(i)
            i = t.after(i)
        return i + 1 if t.sign(i, ";") else i

    def _anonymous(self, i: int, end: int, scope: Scope) -> None:
        """Methods of types without a name inside an expression; they belong to the scope around it."""
        t = self.t
        while i < min(end, len(t)):
            if t.sign(i, "{") and t.sign(i - 1, ")") and self._constructs(t[i - 1].pair):
                inner, k = Scope(scope.path, scope.id, scope.kind, i), i + 1
                while k < min(t[i].pair, len(t)):
                    k = self._java(k, inner)[0]
                i = k
            i += 1

    def _constructs(self, i: int) -> bool:
        """Whether the bracket at i holds the arguments of ``new``, or of a constant of an enumeration."""
        t, k = self.t, i - 1
        while k > 0 and (t.word(k) or t.sign(k, ".", "<", ">", ",", "?")) and not t.word(k, "new"):
            k -= 1
        return t.word(k, "new") or t.word(i - 1) and t.sign(i - 2, ",", "{")

    # Go

    def _go(self, i: int, scope: Scope) -> tuple[int, Scope | None]:
        t = self.t
        if t[i].inside >= 0:
            return i + 1, None
        if t.word(i, "import"):
            strings = [k for k in range(i + 1, t.after(i + 1) if t.sign(i + 1, "(") else min(i + 3, len(t))) if t[k].kind == "string"]
            if strings:
                self.imported(t[strings[0]].text[1:-1], i)
            return (t.after(i + 1) if t.sign(i + 1, "(") else i + 1), None
        if t.word(i, "type"):
            at = i + 2 if t.sign(i + 1, "(") else i + 1
            kind = t.after(at + 1) if t.sign(at + 1, "[") else at + 1
            if t.word(at) and t.word(kind, "struct") and t.sign(kind + 1, "{"):
                last = t[i + 1].pair if t.sign(i + 1, "(") else t[kind + 1].pair
                self.declared("class", t[at].text, scope, i, last)
                return last + 1, None
            return (t.after(i + 1) if t.sign(i + 1, "(") else i + 1), None
        if t.word(i, "func"):
            method = t.sign(i + 1, "(")
            name = t.after(i + 1) if method else i + 1
            k = t.after(name + 1) if t.sign(name + 1, "[") else name + 1
            if t.word(name) and t.sign(k, "("):
                k = t.after(k)
                while k < len(t) and not t.line_break(k) and not (t.sign(k, "{") and not t.word(k - 1, "struct", "interface")):
                    k = t.after(k)
                body = k if t.sign(k, "{") and not t.line_break(k) else None
                last = t[body].pair if body is not None else k - 1
                self.declared("method" if method else "function", t[name].text, scope, i, last, body)
                return last + 1, None
        return i + 1, None

    # Rust

    def _rust(self, i: int, scope: Scope) -> tuple[int, Scope | None]:
        t = self.t
        if t.sign(i, "#") and t.sign(i + 1, "[", "!"):
            return t.after(i + 1 if t.sign(i + 1, "[") else i + 2) if t.sign(i + 1, "[") or t.sign(i + 2, "[") else i + 1, None
        if t.word(i) and t.sign(i + 1, "!") and not t.sign(i + 2, "="):
            group = i + 3 if t.word(i + 2) else i + 2
            return (t.after(group) if t.sign(group, "(", "[", "{") else i + 2), None
        if t.word(i, "use"):
            end = next((k for k in range(i, len(t)) if t.sign(k, ";")), len(t) - 1)
            self.imported(" ".join(self.text[t[i].end : t[end].start if t.sign(end, ";") else t[end].end].split()), i)
            return end + 1, None
        if t.word(i, "struct", "enum") and t.word(i + 1):
            k = t.angles(i + 2) if t.sign(i + 2, "<") else i + 2
            while k < len(t) and not t.sign(k, "{", ";"):
                k = max(t.angles(k), k + 1) if t.sign(k, "<") else t.after(k)
            last = t[k].pair if t.sign(k, "{") else min(k, len(t) - 1)
            own = self.declared("class", t[i + 1].text, scope, self._rust_first(i), last)
            self.types[t[i + 1].text] = Scope(f"{scope.path}:{t[i + 1].text}", own, "class")
            return last + 1, None
        if t.word(i, "impl") and scope.kind == "module":
            body = self._body(i + 1)
            if body is not None and (name := self._implements(i + 1, body)):
                at = self.types.get(name) or self._type(name, scope, i, body)
                self.types[name] = at
                return body + 1, Scope(at.path, at.id, "class", body)
        if t.word(i, "fn") and t.word(i + 1):
            body = self._body(i + 2)
            if body is None:
                return i + 2, None
            method = scope.kind == "class" and t[i].inside == scope.open
            self.declared("method" if method else "function", t[i + 1].text, scope if method else self.top, self._rust_first(i), t[body].pair, body)
            return t[body].pair + 1, None
        return i + 1, None

    def _rust_first(self, i: int) -> int:
        t = self.t
        while i > 0 and (t.word(i - 1) and t[i - 1].text in RUST_BEFORE or t.sign(i - 1, ")") and t.word(t[i - 1].pair - 1, "pub") or t[i - 1].kind == "string" and t.word(i - 2, "extern")):
            i = t[i - 1].pair if t.sign(i - 1, ")") else i - 1
        return i

    def _implements(self, i: int, body: int) -> str:
        """The name of the type that a block is for, without paths and arguments."""
        t, name = self.t, ""
        if t.sign(i, "<"):
            i = t.angles(i)
        while i < body and not t.word(i, "where"):
            if t.word(i, "for"):
                name = ""
            elif t.word(i) and not t.word(i, "dyn", "mut") and (not name or t.sign(i - 1, "::")):
                name = t[i].text
            i = max(t.angles(i), i + 1) if t.sign(i, "<") else t.after(i)
        return name

    # C and C++

    def _c(self, i: int, scope: Scope) -> tuple[int, Scope | None]:
        t = self.t
        if t[i].kind == "include":
            m = re.search(r"[<\"]([^>\"]+)[>\"]", t[i].text)
            if m:
                self.imported(m[1], i)
            return i + 1, None
        kinds = ("struct",) if self.lang == "c" else ("struct", "class")
        if t.word(i, *kinds) and not t.word(i - 1, "enum") and (found := self._tagged(i)):
            name, body = found
            return body + 1, self._type(name, scope, i, body) if name else Scope(scope.path, scope.id, scope.kind, body)
        if (t[i].kind == "word" or t.sign(i, "[", "~", "::", "*")) and (i == 0 or t.sign(i - 1, ";", "{", "}", ":") or t[i - 1].kind == "include" or t.sign(i - 1, ">") or t.line_break(i)):
            return self._c_definition(i, scope), None
        return i + 1, None

    def _tagged(self, i: int) -> tuple[str, int] | None:
        """Name and body of a type that is defined at its word."""
        t, name, k = self.t, "", i + 1
        while k < len(t):
            if t.sign(k, "{"):
                return name, k
            if t.sign(k, ":") and name:
                body = self._body(k + 1)
                return (name, body) if body is not None else None
            if t.word(k, "__attribute__", "alignas", "__declspec") and t.sign(k + 1, "("):
                k = t.after(k + 1)
            elif t.sign(k, "["):
                k = t.after(k)
            elif t.sign(k, "<") and name:
                k = max(t.angles(k), k + 1)
            elif t.word(k):
                name, k = (name if t.word(k, "final") else t[k].text), k + 1
            elif t.sign(k, "::"):
                k += 1
            else:
                return None
        return None

    def _c_definition(self, i: int, scope: Scope) -> int:
        """A function with a body; else the token to go on from."""
        t, first, k = self.t, i, i
        if t.word(i, "namespace", "extern", "typedef", "using", "enum", "union", "public", "private", "protected", "goto", "case", "default") and not (t.word(i, "extern") and t.word(i + 1)):
            return i + 1
        if t.word(i, "template") and t.sign(i + 1, "<"):
            return max(t.angles(i + 1), i + 1)
        params = None
        while k < len(t) and not t.sign(k, ";", "}", "{"):
            if t.word(k, "struct", "class", "enum", "union") and k > first and self._tagged(k):
                return k
            if t.sign(k, "=") and params is None and not t.word(k - 1, "operator"):
                return k + 1
            if t.sign(k, "(") and params is None and self._parameters(k):
                params = k
            k = max(t.angles(k), k + 1) if t.sign(k, "<") and t.word(k - 1) else t.after(k)
            if params is not None and t.sign(k, ":"):  # members that a constructor sets, with brackets or braces
                k += 1
                while k < len(t) and not t.sign(k, ";", "}") and not (t.sign(k, "{") and t.sign(k - 1, ")", "}")):
                    k = t.after(k)
        if params is None or not t.sign(k, "{"):
            return i + 1
        plain = t.word(params - 1) and not t.sign(params - 2, "::", "~") and not t.word(params - 2, "operator") and t[params - 1].text not in NO_CALL["cpp"]
        if plain and params - 1 > first and scope.kind != "class":
            self.declared("function", t[params - 1].text, scope, first, t[k].pair, k)
        elif plain and params - 1 == first and scope.kind != "class" and t.word(first, "main"):
            self.declared("function", "main", scope, first, t[k].pair, k)
        return t[k].pair + 1

    def _parameters(self, k: int) -> bool:
        t, end = self.t, self.t.after(k)
        if t.word(k - 1, "__attribute__", "__declspec", "alignas", "decltype", "noexcept", "throw", "requires", "asm", "__asm__"):
            return False
        return end < len(t) and (t[end].text in AFTER_PARAMETERS or self.lang == "c" and t.word(end) and not t.sign(end + 1, "("))

    # -- calls

    def _calls(self, first: int, last: int, own: str) -> None:
        """Edges to what is called between two tokens."""
        if self.lang == "java":
            return
        t, patterns = self.t, self._patterns(first, last) if self.lang == "rust" else set()
        i = first
        while i < min(last, len(t)):
            if self.lang == "rust" and t.word(i) and t.sign(i + 1, "!") and t.sign(i + 2, "(", "[", "{"):
                i = t.after(i + 2)
                continue
            if t.sign(i, "(") and i > first and i not in patterns and (name := self._callee(i)):
                self._edge("call", own, self.named.get(name) or self._node("builtin", name, name, None))
            i += 1

    def _patterns(self, first: int, last: int) -> set[int]:
        """Tokens of patterns, whose brackets take apart and don't call."""
        t, out = self.t, set()
        for i in range(first, min(last, len(t))):
            if t.word(i, "let"):
                k = i + 1
                while k < last and k < len(t) and not t.sign(k, "=", ";"):
                    out.update(range(k, min(t.after(k), len(t))))
                    k = t.after(k)
            elif t.sign(i, "=>"):
                k, inside = i - 1, t[i].inside
                while k > inside and not (t.sign(k, ",") and t[k].inside == inside):
                    if t.sign(k, "}") and t[k].inside == inside and t.sign(t[k].pair - 1, "=>"):
                        break
                    k = t[k].pair - 1 if t.sign(k, ")", "]", "}") and t[k].pair >= 0 else k - 1
                guard = next((g for g in range(k + 1, i) if t.word(g, "if") and t[g].inside == inside), i)
                out.update(range(k + 1, guard))
        return out

    def _start(self, i: int) -> int:
        """The first token of the chain of names, members and brackets that ends at a token."""
        t = self.t
        while i > 0:
            if t.sign(i, ")", "]") and t[i].pair > 0:
                i = t[i].pair
                if t.word(i - 1) and t[i - 1].text not in NO_CALL[self.lang] or t.sign(i - 1, ")", "]") or t.sign(i - 1, ">") and self._angles_before(i - 1) > 0:
                    i -= 1
                    continue
            elif t.sign(i, ">"):
                k = self._angles_before(i)
                if k < 1:
                    return i
                i = k - 1
                continue
            if t.sign(i, "::", ".", "?.", "->"):
                i -= 1
            elif t.sign(i - 1, ".", "?.", "->", "::") and i > 1 and not (t.sign(i - 1, "::") and not (t.word(i - 2) or t.sign(i - 2, ">"))):
                i -= 2
            elif t.sign(i - 1, "?") and t.sign(i, "."):
                i -= 1
            else:
                return i
        return i

    def _angles_before(self, i: int) -> int:
        """Where the angle brackets of a name that close at a token open, or -1."""
        t, depth, k = self.t, 0, i
        while k > 0 and not t.sign(k, ";", "{", "}", "(", "[", "&&", "||"):
            depth += t.sign(k, ">") - t.sign(k, "<")
            if not depth:
                return k if t.word(k - 1) or t.sign(k - 1, "::") else -1
            k = t[k].pair - 1 if t.sign(k, ")", "]") and t[k].pair >= 0 else k - 1
        return -1

    def _callee(self, i: int) -> str | None:
        """The name under which the bracket at a token calls something, if it does."""
        t, lang, p = self.t, self.lang, i - 1
        if t.sign(p, "?.") and lang in SCRIPTS:
            p -= 1
        if t.sign(p, ">") and lang != "go":
            start = self._start(p)
            if start == p or lang == "rust" and not any(t.sign(k, "::") for k in range(start, p)):
                return None
            if lang in SCRIPTS:
                p = next((k - 1 for k in range(start, p) if t.sign(k, "<")), p)
        if t.sign(p, ")", "]") and t[p].pair >= 0:
            if t.sign(p, ")") and t.word(t[p].pair - 1) and t[t[p].pair - 1].text in NO_CALL[lang] or lang == "go" and t.sign(p, "]") and not t.word(t[p].pair - 1):
                return None
            if lang == "go" and t.sign(p, "]") and t.word(t[p].pair - 1):
                p = t[p].pair - 1  # of a type's arguments
            elif t.sign(p, ")") and not t.word(t[p].pair - 1) and lang in ("c", "cpp") or t.line_break(i):
                return None
            else:
                start = self._start(p)
                return self.text[t[start].start : t[p].end]
        if not t.word(p) and not t.sign(p, ">"):
            return None
        if t.word(p) and t[p].text in NO_CALL[lang] and not t.sign(p - 1, ".", "?.", "->", "::"):
            return None
        start = self._start(p)
        before = start - 1
        if lang in SCRIPTS:
            simple = all(t.word(k) or t.sign(k, ".") for k in range(start, p + 1))
            if t.word(before, "function") or t.sign(before, "*") and t.word(before - 1, "function") or simple and t.word(before, "new") or t.sign(t.after(i), "{") and not t.line_break(t.after(i)):
                return None
            if t.sign(p - 1, ".", "?.") and not t[p].text.startswith("#"):
                return t[p].text
        elif lang in ("c", "cpp"):
            if t.word(before) and t[before].text not in BEFORE_CALL or lang == "cpp" and t.sign(before, ">") and self._start(before) != before:
                return None
            if t.sign(p - 1, ".", "->"):
                return t[p].text
        elif lang == "rust":
            if t.word(before, "fn"):
                return None
            if t.sign(p - 1, ".") and t.word(p):
                return t[p].text
        elif t.sign(before, "]") or t.word(before, "func"):
            return None
        return re.sub(r"\s+", "" if lang == "go" else " ", self.text[t[start].start : t[p].end])


def scan(path: str, text: str, lang: str) -> tuple[list[dict], list[dict]]:
    """Rows of nodes and edges of one file.

    An empty text is a module and no more; of definitions of one name in one
    scope the last counts; a call goes to the last definition of its name in
    the file, else to a placeholder of that name.
    """
    return Reader(path, text, lang).read()
