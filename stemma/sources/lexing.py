"""Tokens of languages with braces, and which brackets belong together.

A token is a word, a number, a string or a sign; comments are left out, as are
the directives of C but for includes.  Code inside a template literal's ``${}``
is tokens like any other.  What never ends (a quote, a bracket) ends with its
line or with the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

SCRIPTS = ("javascript", "typescript", "tsx")
#: After these a slash divides; after any other sign, or one of the words below, it begins a pattern.
ENDS_VALUE = {")", "]"}
BEFORE_PATTERN = {"return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "throw", "new", "await", "yield", "instanceof"}
CLOSES = {"(": ")", "[": "]", "{": "}", "${": "}"}
_SIGN = re.compile(r"=>|->|::|\?\.(?!\d)|\.\.\.|&&|\|\||\?\?|[^\w\s]")
_WORD = re.compile(r"#?[^\W\d][\w$]*|\$[\w$]*")
_NUMBER = re.compile(r"\.?\d(?:[\w.]|(?<=[eEpP])[+-])*")
_PATTERN = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
_DIRECTIVE = re.compile(r"#[ \t]*(\w+)((?:\\\r?\n|[^\n])*)")
_RAW = {"rust": re.compile(r'b?r(#*)"'), "cpp": re.compile(r'(?:u8|[uUL])?R"([^()\\\s]{0,16})\(')}
_CHAR = re.compile(r"'(?:\\(?:u\{[^}\n]*\}|x[0-9a-fA-F]{2}|.)|[^'\\\n])'")
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Token:
    kind: str  # word, number, string, include, sign
    text: str
    start: int
    end: int
    pair: int = -1  # the bracket that belongs to this one
    inside: int = -1  # the bracket around it


class Tokens(list):
    """The tokens of a text."""

    def __init__(self, text: str, lang: str):
        super().__init__()
        self.source, self.lang = text, lang
        self._scan(0, False)
        self._paired()

    def _add(self, kind: str, start: int, end: int) -> int:
        self.append(Token(kind, self.source[start:end], start, end))
        return end

    def _value_before(self) -> bool:
        """Whether what stands before is a value, so that a slash divides it."""
        if not self:
            return False
        last = self[-1]
        return last.text not in BEFORE_PATTERN if last.kind == "word" else last.kind != "sign" or last.text in ENDS_VALUE

    def _scan(self, at: int, nested: bool) -> int:
        """Tokens from a place on; inside a template up to the brace that ends its code."""
        text, lang, depth = self.source, self.lang, 0
        while at < len(text):
            c, two = text[at], text[at : at + 2]
            if m := _SPACE.match(text, at):
                at = m.end()
            elif two == "//":
                at = (text.find("\n", at) + 1 or len(text) + 1) - 1
            elif two == "/*":
                at = self._comment(at)
            elif c == "#" and lang in ("c", "cpp") and not text[text.rfind("\n", 0, at) + 1 : at].strip():
                m = _DIRECTIVE.match(text, at)
                if m and m[1] == "include":
                    self._add("include", at, m.end())
                at = m.end() if m else at + 1
            elif lang in _RAW and (m := _RAW[lang].match(text, at)):
                stop = ('"' + m[1]) if lang == "rust" else f'){m[1]}"'
                end = text.find(stop, m.end())
                at = self._add("string", at, end + len(stop) if end >= 0 else len(text))
            elif lang == "java" and text.startswith('"""', at):
                end = re.compile(r'(?:\\.|[^\\])*?"""', re.S).match(text, at + 3)
                at = self._add("string", at, end.end() if end else len(text))
            elif c == "`" and lang in SCRIPTS:
                at = self._template(at)
            elif c == "`" and lang == "go":
                at = self._add("string", at, (text.find("`", at + 1) + 1) or len(text))
            elif c == '"' or c == "'" and lang != "rust":
                at = self._quoted(at, c)
            elif c == "'" and (m := _CHAR.match(text, at)):
                at = self._add("string", at, m.end())
            elif c == "'":  # a lifetime
                m = _WORD.match(text, at + 1)
                at = m.end() if m else at + 1
            elif c == "/" and lang in SCRIPTS and not self._value_before() and not (self and self[-1].text == "<") and (m := _PATTERN.match(text, at)):
                at = self._add("string", at, m.end())
            elif (m := _WORD.match(text, at)) and (c != "#" or lang in SCRIPTS):
                at = self._add("word", at, m.end())
            elif m := _NUMBER.match(text, at):
                at = self._add("number", at, m.end())
            else:
                if nested and c in "{}":
                    depth += 1 if c == "{" else -1
                    if depth < 0:
                        return at
                m = _SIGN.match(text, at)
                at = self._add("sign", at, m.end() if m else at + 1)
        return at

    def _comment(self, at: int) -> int:
        depth, mark = 0, re.compile(r"/\*|\*/")
        while m := mark.search(self.source, at):
            depth, at = (depth + 1 if m[0] == "/*" and (self.lang == "rust" or not depth) else depth - (m[0] == "*/")), m.end()
            if not depth:
                return at
        return len(self.source)

    def _quoted(self, at: int, quote: str) -> int:
        m = re.compile(rf"{quote}(?:\\.|[^{quote}\\\n])*{quote}" if self.lang != "rust" else rf"{quote}(?:\\.|[^{quote}\\])*{quote}", re.S).match(self.source, at)
        return self._add("string", at, m.end()) if m else at + 1  # text of markup, such as don't

    def _template(self, at: int) -> int:
        text, start, at = self.source, at, at + 1
        while at < len(text):
            if text[at] == "\\":
                at += 2
            elif text[at] == "`":
                return self._add("string", start, at + 1)
            elif text.startswith("${", at):
                self._add("string", start, at)
                self._add("sign", at, at + 2)
                start = at = self._scan(at + 2, True)
                if at < len(text):
                    start = at = self._add("sign", at, at + 1)
            else:
                at += 1
        return self._add("string", start, len(text))

    def _paired(self) -> None:
        open_: list[int] = []
        for i, t in enumerate(self):
            closing = t.kind == "sign" and t.text in (")", "]", "}")
            if closing:
                at = next((k for k in range(len(open_) - 1, -1, -1) if CLOSES[self[open_[k]].text] == t.text), None)
                if at is not None:
                    for k in open_[at + 1 :]:  # never closed
                        self[k].pair = i
                    t.pair, self[open_[at]].pair = open_[at], i
                    del open_[at:]
            t.inside = open_[-1] if open_ else -1
            if t.kind == "sign" and t.text in CLOSES:
                open_.append(i)
        for k in open_:
            self[k].pair = len(self)

    def sign(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self) and self[i].kind == "sign" and self[i].text in texts

    def word(self, i: int, *texts: str) -> bool:
        """Whether there is a word, one of ``texts`` if any are given."""
        return 0 <= i < len(self) and self[i].kind == "word" and (not texts or self[i].text in texts)

    def after(self, i: int) -> int:
        """What follows a bracket's partner, or any other token."""
        return self[i].pair + 1 if self[i].kind == "sign" and self[i].text in CLOSES else i + 1

    def line_break(self, i: int) -> bool:
        """Whether a token begins on a later line than the one before it ends."""
        return i == 0 or "\n" in self.source[self[i - 1].end : self[i].start]

    def angles(self, i: int) -> int:
        """What follows the angle brackets that open at i; i itself if they don't end as such."""
        depth, k = 0, i
        while k < len(self):
            if self.sign(k, "<"):
                depth += 1
            elif self.sign(k, ">"):
                depth -= 1
                if not depth:
                    return k + 1
            elif self.sign(k, ";", ")", "]", "}"):
                return i
            k = self.after(k)
        return i
