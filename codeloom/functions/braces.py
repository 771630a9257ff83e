"""Symbols of Java, Go, JavaScript, C and C++ files, by a lexer and the structure of their brackets.

Comments, strings of all kinds and regular expressions are told from code first; then brackets are
paired, and what stands before a block or a semicolon is read as a declaration or passed over.
What does not parse costs its own declaration and no other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.python_code import SYMBOL, arrow_rows

# The languages' extensions, and words of their syntax.
EXTENSIONS = {"java": (".java",), "go": (".go",), "javascript": (".js", ".jsx", ".mjs", ".cjs"), "c": (".c", ".h"), "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".hh")}
TYPES = {"class": "class", "interface": "interface", "enum": "enum", "record": "record", "struct": "struct", "union": "struct", "namespace": ""}
NO_NAME = frozenset("if for while switch catch return throw new else do try synchronized sizeof case goto using typedef friend static_assert alignas decltype function await yield typeof in of delete void super this".split())
MODIFIERS = frozenset("public protected private static final abstract synchronized native strictfp default transient volatile sealed non inline virtual extern constexpr explicit friend mutable typename register unsigned signed".split())
BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do => ( , = : [ ! & | ? { } ; + - * % ~ ^ < >".split(" ")) | {None}

_COMMENT = r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))"
_STRING = r"""(?P<string>"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z))"""
_REST = r"(?P<number>\d(?:[\w.]|'(?=\w))*)|(?P<word>[^\W\d]\w*(?:\$\w*)*|\$[\w$]*)|(?P<mark>->|::|=>|\.\.\.|[^\s\w])"
_RAW = {"java": r'(?P<raw>"""(?:\\.|[^\\])*?(?:"""|\Z))|', "go": r"(?P<raw>`[^`]*(?:`|\Z))|", "cpp": r'(?P<raw>R"(?P<d>[^()\\\s]{0,16})\(.*?(?:\)(?P=d)"|\Z))|', "c": "", "javascript": ""}
_LINE = r"(?P<directive>(?m:^)[ \t]*\#(?:\\\r?\n|[^\n])*)|"
LEXER = {lang: re.compile(f"{_COMMENT}|{_LINE if lang in ('c', 'cpp') else ''}{_RAW[lang]}{_STRING}|{_REST}", re.S) for lang in EXTENSIONS}
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
TEMPLATE = re.compile(r"\\.|`|\$\{|[{}]|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)


@dataclass(slots=True)
class Token:
    text: str
    kind: str
    start: int
    line: int
    doc: str | None = None


def _template_end(text: str, at: int) -> int:
    """Where a JavaScript template that begins at ``at`` ends; templates and blocks may lie inside its expressions."""
    open_ = ["`"]
    at += 1
    while open_ and (m := TEMPLATE.search(text, at)):
        s, at = m.group(), m.end()
        if open_[-1] == "`" and s not in ("`", "${"):
            at = m.start() + (2 if s[0] == "\\" else 1)
        elif s == "`":
            open_.pop() if open_[-1] == "`" else open_.append("`")
        elif s in ("${", "{"):
            open_.append("{")
        elif s == "}":
            open_.pop()
    return at if not open_ else len(text)


def tokens(text: str, lang: str) -> list[Token]:
    """Words, marks and literals with their lines; a comment right before a token is its doc."""
    out: list[Token] = []
    at, line, counted, doc = 0, 1, 0, None
    while m := LEXER[lang].search(text, at):
        kind, start, end = m.lastgroup if m.lastgroup != "d" else "raw", m.start(), m.end()
        if lang == "javascript" and m.group() == "`":
            kind, end = "string", _template_end(text, start)
        elif lang == "javascript" and m.group() == "/" and (out[-1].text if out else None) in BEFORE_REGEX and (r := REGEX.match(text, start)):
            kind, end = "string", r.end()
        line, counted = line + text.count("\n", counted, start), start
        at = max(end, start + 1)
        if kind == "comment":
            doc = text[start:end]
        elif kind != "directive":
            out.append(Token(text[start:end], kind, start, line, doc))
            doc = None
    return out


def pairs(own: list[Token]) -> dict[int, int]:
    """For every opening bracket the place of the one that closes it; without one, the end."""
    out, open_ = {}, []
    for i, t in enumerate(own):
        if t.kind != "mark":
            continue
        if t.text in "([{":
            open_.append(i)
        elif t.text in ")]}":
            wanted = "([{"[")]}".index(t.text)]
            if any(own[j].text == wanted for j in open_[-64:]):
                while own[open_[-1]].text != wanted:
                    out[open_.pop()] = i
                out[open_.pop()] = i
    return out | dict.fromkeys(open_, len(own))


@dataclass
class Symbol:
    kind: str
    name: str
    full_name: str
    owner: str | None
    start: int
    end: int
    first: int
    last: int
    doc: str | None
    params: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    returns: list[str] = field(default_factory=list)
    bases: list[str] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)


class Parser:
    """The symbols of one file, in ``found``."""

    def __init__(self, text: str, lang: str):
        self.text, self.lang = text, lang
        self.own = tokens(text, lang)
        self.close = pairs(self.own)
        self.found: list[Symbol] = []
        self.package = ""
        {"go": self.go, "javascript": self.javascript}.get(lang, lambda: self.members(0, len(self.own), [], None))()

    def end_of(self, i: int) -> int:
        return min(self.close.get(i, i), len(self.own) - 1)

    def said(self, i: int, j: int) -> str:
        """The tokens from i to before j, with blanks only between words."""
        out = ""
        for t in self.own[i:j]:
            out += (" " if out and t.kind != "mark" and (out[-1].isalnum() or out[-1] in "_*&>])") and not (out[-1] in "*&]" and self.lang == "go") else "") + t.text
        return out

    def add(self, kind: str, name: str, path: list[str], i: int, last: int, **more) -> Symbol:
        """A symbol from token i to token ``last``."""
        start, end = self.own[i], self.own[min(last, len(self.own) - 1)]
        stop = end.start + len(end.text)
        full = ".".join([*([self.package] if self.package else []), *path, name])
        s = Symbol(kind, name, full, path[-1] if path else None, start.start, stop, start.line, end.line + end.text.count("\n"), start.doc, **more)
        self.found.append(s)
        return s

    def split(self, i: int, j: int, angles: bool = True) -> list[tuple[int, int]]:
        """Ranges between commas that are in no bracket."""
        out, first, depth = [], i, 0
        while i < j:
            x = self.own[i].text
            if x in ("(", "[", "{"):
                i = self.close.get(i, i)
            elif x == "<" and angles:
                depth += 1
            elif x == ">" and angles:
                depth = max(0, depth - 1)
            elif x == "," and not depth:
                out.append((first, i))
                first = i + 1
            i += 1
        return [r for r in [*out, (first, j)] if r[0] < r[1]]

    def header(self, i: int, j: int) -> list[int]:
        """The tokens before a block without what brackets hold, annotations, template parameters and modifiers."""
        out = []
        while i < j:
            t = self.own[i]
            if t.text == "@" and i + 1 < j and self.own[i + 1].text != "interface":
                i += 2
                while i + 1 < j and self.own[i].text == ".":
                    i += 2
                if i < j and self.own[i].text == "(":
                    i = self.close.get(i, i) + 1
                continue
            if t.text == "<" and (not out or self.own[out[-1]].text == "template" or self.lang == "java" and self.own[out[-1]].kind != "word"):
                depth = 1
                while depth and i + 1 < j:
                    i += 1
                    depth += {"<": 1, ">": -1}.get(self.own[i].text, 0)
                out = out[:-1] if out else out
            elif t.text not in MODIFIERS or t.text in ("unsigned", "signed"):
                out.append(i)
                if t.text in ("(", "["):
                    i = self.close.get(i, i)
            i += 1
        return out

    def parameter(self, i: int, j: int) -> tuple[str, str]:
        """(name, type) of one parameter of Java, C or C++."""
        own = self.header(i, j)
        stop = next((n for n, k in enumerate(own) if self.own[k].text == "="), len(own))
        own = own[:stop]
        words = [n for n, k in enumerate(own) if self.own[k].kind == "word"]
        inner = next((k for k in own if self.own[k].text == "("), None)
        if inner is not None and self.close.get(inner, inner) < j:  # a pointer to a function
            names = [t.text for t in self.own[inner : self.close[inner]] if t.kind == "word"]
            return (names[-1] if names else ""), self.said(i, j)
        if not words:
            return "", "".join(self.own[k].text for k in own)
        last = words[-1]
        named = last > 0 and not (len(words) == 1 and self.lang != "java" or self.own[own[last - 1]].text in ("::", ".") or self.own[own[last]].text in ("int", "char", "long", "short", "float", "double", "bool", "void", "const"))
        kept = own[:last] if named else own
        if self.lang == "java":
            cut = next((n for n, k in enumerate(kept) if self.own[k].text in ("<", "[", "...")), len(kept))
            kept = kept[:cut]
        out = ""
        for k in kept:
            x = self.own[k]
            out += (" " if out and x.kind == "word" and (out[-1].isalnum() or out[-1] in "_*&>") else "") + (self.text[x.start : self.own[self.close[k]].start + 1] if x.text == "[" and self.close.get(k, len(self.own)) < len(self.own) else x.text)
        return (self.own[own[last]].text if named else ""), out

    def members(self, i: int, hi: int, path: list[str], inside: str | None) -> list[str]:
        """Declarations between i and hi, in a body of kind ``inside`` or at the top; the names of fields."""
        fields: list[str] = []
        if inside == "enum" and self.lang == "java":
            i = self.constants(i, hi, fields)
        first = i
        while i < hi:
            t = self.own[i]
            if t.text == ";":
                self.statement(first, i, path, inside, fields)
                first = i + 1
            elif t.text in ("(", "["):
                i = self.close.get(i, i)
            elif t.text == "{":
                if self.block(first, i, path, inside):
                    first = self.close.get(i, hi) + 1
                    if self.lang != "java" and first < hi and self.own[first].text == ";":
                        first += 1
                i = max(self.close.get(i, i), first - 1)
            elif t.text == "}":
                first = i + 1
            elif t.text == ":" and first < i and self.own[i - 1].text in ("public", "private", "protected") and self.lang == "cpp":
                first = i + 1
            i += 1
        return fields

    def constants(self, i: int, hi: int, fields: list[str]) -> int:
        """The names of an enum's constants; what follows the semicolon after them."""
        end = i
        while end < hi and self.own[end].text != ";":
            end = self.close.get(end, end) + 1 if self.own[end].text in ("(", "[", "{") else end + 1
        for a, b in self.split(i, min(end, hi), angles=False):
            own = self.header(a, b)
            fields += [self.own[own[0]].text] if own and self.own[own[0]].kind == "word" else []
        return end + 1

    def statement(self, i: int, end: int, path: list[str], inside: str | None, fields: list[str]) -> None:
        own = self.header(i, end)
        if not own:
            return
        words = [self.own[k].text for k in own]
        if words[0] == "package" and self.lang == "java":
            self.package = "".join(words[1:])
        elif words[0] not in ("import", "package", "using", "typedef", "return", "friend", "goto", "throw"):
            if self.function(own, i, end, None, path, inside) or not inside or inside == "enum" and self.lang != "java":
                return
            for n, (a, b) in enumerate(self.split(own[0], end)):
                piece = self.header(a, b)
                stop = next((m for m, k in enumerate(piece) if self.own[k].text in ("=", "[", ":", "{")), len(piece))
                names = [self.own[k].text for k in piece[:stop] if self.own[k].kind == "word"]
                if names and (n or len(piece[:stop]) > 1):
                    fields.append(names[-1])

    def block(self, i: int, at: int, path: list[str], inside: str | None) -> bool:
        """Read a block with what stands before it; False where it belongs to a longer statement."""
        own = self.header(i, at)
        words = [self.own[k].text for k in own]
        before = words[: words.index("(")] if "(" in words else words
        kind = next((w for n, w in enumerate(before) if w in TYPES and (w != "record" or n + 1 < len(words) and words[-1] != "=" and "(" in words)), None)
        if "=" in words and "operator" not in words and (not kind or words.index("=") < words.index(kind)):
            return False
        end = self.end_of(at)
        if len(words) == 1 and self.own[own[0]].kind == "string":  # extern "C"
            self.members(at + 1, end, path, None)
        elif kind and (self.lang == "java" or "(" not in before):
            n = words.index(kind)
            if kind == "enum" and words[n + 1 : n + 2] in (["class"], ["struct"]):
                n += 1
            name = next((w for k, w in zip(own[n + 1 :], words[n + 1 :], strict=True) if self.own[k].kind == "word" and w != "final"), "")
            if not TYPES[kind]:
                self.members(at + 1, end, [*path, *([name] if name else [])], None)
                return True
            if not name and self.lang in ("c", "cpp"):
                name = self.own[end + 1].text if end + 1 < len(self.own) and self.own[end + 1].kind == "word" else ""
            place = len(self.found)
            if kind == "enum" and self.lang != "java":
                fields = [self.own[a].text for a, _ in self.split(at + 1, end) if self.own[a].kind == "word"]
            else:
                fields = self.members(at + 1, end, [*path, name], kind)
            if kind == "record" and "(" in words[n:]:
                p = own[n + words[n:].index("(")]
                fields = [self.parameter(a, b)[0] for a, b in self.split(p + 1, self.close[p])] + fields
            if name:
                self.add(TYPES[kind], name, path, i, end, attributes=fields, bases=self.bases(own[n + 2 :]))
                self.found.insert(place, self.found.pop())
        else:
            self.function(own, i, end, at, path, inside)
        return True

    def bases(self, own: list[int]) -> list[str]:
        """The names after ``extends``, ``implements`` or a colon, without what angles or brackets hold."""
        out, depth, on = [], 0, False
        for k in own:
            t = self.own[k]
            depth += {"<": 1, ">": -1}.get(t.text, 0)
            if not depth and t.text in ("extends", "implements", "permits", ":"):
                on = t.text != "permits"
            elif on and not depth and t.kind == "word":
                out = [*out[:-1], out[-1] + "." + t.text] if out and self.own[k - 1].text in (".", "::") else [*out, t.text]
        return out

    def function(self, own: list[int], i: int, end: int, at: int | None, path: list[str], inside: str | None) -> bool:
        """A function from its header; ``at`` is where its body begins."""
        words = [self.own[k].text for k in own]
        n = next((n for n, w in enumerate(words) if w == "(" and n and (self.own[own[n - 1]].kind == "word" or "operator" in words[max(0, n - 3) : n])), None)
        if n is None or "=" in words[:n] and "operator" not in words[:n]:
            return False
        name, first = words[n - 1], n - 1
        if "operator" in words[:n]:
            first = words.index("operator")
            name = "".join(words[first:n])
        if name in NO_NAME or self.lang == "java" and (not inside or name == path[-1] or n < 2):
            return False
        if at is None and (self.lang == "c" or self.lang == "cpp") and first == 0 and not inside:
            return False
        if first and words[first - 1] == "~":
            name, first = "~" + name, first - 1
        outer: list[str] = []
        while first > 1 and words[first - 1] == "::":
            outer, first = [words[first - 2], *outer], first - 2
        path = [*path, *outer]
        ranges = self.split(own[n] + 1, self.close.get(own[n], end))
        params = [p for p in (self.parameter(a, b) for a, b in ranges) if p != ("", "void")]
        returns = [w for w in words[:first] if w not in ("static", "const", "inline")]
        text = ""
        for w in returns[: returns.index("<")] if "<" in returns and self.lang == "java" else returns:
            text += (" " if text and w[0].isalnum() and (text[-1].isalnum() or text[-1] in "*&") else "") + w
        if "->" in words[n:]:
            text = "".join(words[words.index("->", n) + 1 :])
        text = text.replace("[", "") if self.lang == "java" else text
        if not name.startswith("_"):
            self.add("method" if inside or outer else "function", name, path, i, end, params=[p for p, _ in params], types=[t for _, t in params], returns=[text] if text else ["void"])
        return True

    def go(self) -> None:
        i = 0
        while i < len(self.own):
            t = self.own[i]
            if t.text == "package" and i + 1 < len(self.own) and not self.package:
                self.package = self.own[i + 1].text
            elif t.text == "func":
                i = self.go_function(i)
            elif t.text == "type" and i + 1 < len(self.own):
                if self.own[i + 1].text == "(":
                    j, end = i + 2, self.end_of(i + 1)
                    while j < end:
                        j = self.go_type(j, j) + 1
                    i = end
                else:
                    i = self.go_type(i + 1, i)
            elif t.text in ("(", "[", "{"):
                i = self.close.get(i, i)
            i += 1

    def line_end(self, i: int) -> int:
        """The last token of what begins at i: brackets go over lines."""
        while i + 1 < len(self.own) and self.own[i + 1].text != ";":
            i = self.end_of(i) if self.own[i].text in ("(", "[", "{") else i
            if i + 1 >= len(self.own) or self.own[i + 1].line > self.own[i].line + self.own[i].text.count("\n") and self.own[i].text not in (",", ".", "|", "=", "*"):
                break
            i += 1
        return i

    def go_params(self, at: int) -> tuple[list[str], list[str]]:
        """Names and types: with names, a name without a type has that of the next one."""
        ranges = self.split(at + 1, self.close.get(at, at), angles=False)
        named = any(b - a > 1 and self.own[a].kind == "word" and self.own[a].text not in ("map", "chan", "func", "struct", "interface") and self.own[a + 1].text != "." for a, b in ranges)
        if not named:
            return [], [self.said(a, b) for a, b in ranges]
        names, types = [], []
        for a, b in reversed(ranges):
            names.append(self.own[a].text)
            types.append(self.said(a + 1, b) if b - a > 1 else types[-1] if types else "")
        return names[::-1], types[::-1]

    def go_function(self, i: int, method: bool = False) -> int:
        j, owner = i + 1, []
        if j < len(self.own) and self.own[j].text == "(":
            receiver = [t.text for t in self.own[j + 1 : self.end_of(j)] if t.kind == "word"]
            cut = next((n for n, t in enumerate(self.own[j + 1 : self.end_of(j)]) if t.text == "["), None)
            words = [t.text for t in self.own[j + 1 : j + 1 + cut] if t.kind == "word"] if cut else receiver
            owner, method, j = words[-1:], True, self.end_of(j) + 1
        if j + 1 >= len(self.own) or self.own[j].kind != "word":
            return i
        name, j = self.own[j].text, j + 1
        if self.own[j].text == "[":
            j = self.end_of(j) + 1
        if j >= len(self.own) or self.own[j].text != "(":
            return i
        params, types = self.go_params(j)
        j = self.end_of(j) + 1
        result, line = j, self.own[min(j, len(self.own)) - 1].line
        while j < len(self.own) and self.own[j].line == line and self.own[j].text not in ("{", ";"):
            j = self.end_of(j) + 1 if self.own[j].text in ("(", "[") else j + 2 if self.own[j].text in ("struct", "interface") and j + 1 < len(self.own) and self.own[j + 1].text == "{" else j + 1
            line = self.own[j - 1].line if j - 1 < len(self.own) else line
        returns = self.go_params(result)[1] if result < j and self.own[result].text == "(" else [self.said(result, j)] if result < j else []
        end = self.end_of(j) if j < len(self.own) and self.own[j].text == "{" and self.own[j].line == line else j - 1
        if not name.startswith("_"):
            self.add("method" if method else "function", name, owner, i, end, params=params, types=types, returns=returns or ["void"])
        return end

    def go_type(self, i: int, begin: int) -> int:
        """A struct or an interface whose name is at i; any other type is passed over."""
        j = i + 1
        if j + 1 < len(self.own) and self.own[j].text == "[" and self.own[j + 1].kind == "word":
            j = self.end_of(j) + 1
        if j + 1 >= len(self.own) or self.own[j].text not in ("struct", "interface") or self.own[j + 1].text != "{":
            return self.line_end(i)
        end, place, fields = self.end_of(j + 1), len(self.found), []
        k = j + 2
        while k < end:
            last = min(self.line_end(k), end - 1)
            if self.own[k].text == ";":
                last = k
            elif self.own[j].text == "interface":
                if k + 1 <= last and self.own[k + 1].text == "(":
                    params, types = self.go_params(k + 1)
                    after = self.end_of(k + 1) + 1
                    returns = self.go_params(after)[1] if after <= last and self.own[after].text == "(" else [self.said(after, last + 1)] if after <= last else []
                    self.add("method", self.own[k].text, [self.own[i].text], k, last, params=params, types=types, returns=returns or ["void"])
            else:
                stop = last + 1 - (self.own[last].kind in ("string", "raw"))
                own = self.split(k, stop, angles=False)
                if len(own) > 1 or own and own[0][1] - own[0][0] > 1 and self.own[k].kind == "word" and self.own[k + 1].text != ".":
                    kind = self.said(own[-1][0] + 1, own[-1][1])
                    fields += [f"{self.own[a].text}:{kind}" for a, _ in own]
                elif own:
                    name = [t.text for t in self.own[k:stop] if t.kind == "word"][-1:]
                    fields += [f"{n}:{self.said(k, stop)}" for n in name]
            k = last + 1
        self.add(self.own[j].text, self.own[i].text, [], begin, end, attributes=fields)
        self.found.insert(place, self.found.pop())
        return end

    def javascript(self) -> None:
        """Function and class declarations at any depth, and the classes' methods."""
        for i, t in enumerate(self.own):
            after = self.own[i - 1].text if i else ";"
            if t.text == "function" and (after in (";", "}", "{", ")", "async", "default", "export") or after not in NO_NAME and self.own[i - 1].kind != "mark"):
                j = i + 1 + (i + 1 < len(self.own) and self.own[i + 1].text == "*")
                if j + 1 < len(self.own) and self.own[j].kind == "word" and self.own[j + 1].text == "(":
                    self.js_function(i - (after == "async"), j, [])
            elif t.text == "class" and after not in (".", "=", "(", ",", "return", ":") and i + 1 < len(self.own) and self.own[i + 1].kind == "word" and self.own[i + 1].text != "extends":
                at = next((k for k in range(i + 2, len(self.own)) if self.own[k].text == "{"), None)
                if at is not None:
                    self.js_class(i, at)

    def js_function(self, begin: int, at: int, path: list[str]) -> int:
        name, p = self.own[at].text, at + 1
        body = self.end_of(p) + 1
        end = self.end_of(body) if body < len(self.own) and self.own[body].text == "{" else self.end_of(p)
        params = [self.own[a + (self.own[a].text == "...")].text if self.own[a].text not in ("{", "[") else self.said(a, self.end_of(a) + 1) for a, _ in self.split(p + 1, self.close.get(p, p), angles=False)]
        if not name.startswith("_"):
            self.add("method" if path else "function", name, path, begin, end, params=params, types=["Any"] * len(params), returns=["void"])
        return end

    def js_class(self, i: int, at: int) -> None:
        name, end, place, fields = self.own[i + 1].text, self.end_of(at), len(self.found), []
        bases = [self.said(i + 3, at)] if self.own[i + 2].text == "extends" else []
        j = first = at + 1
        while j < end:
            t = self.own[j]
            if t.text == "(" and self.own[j - 1].kind in ("word", "string") and self.close.get(j, end) + 1 < end and self.own[self.close[j] + 1].text == "{":
                j = self.js_function(first, j - 1, [name])
                first = j + 1
            elif t.text == "=" or t.text == ";" and j > first:
                fields += [self.own[j - 1].text] if self.own[j - 1].kind == "word" else []
                while j < end and self.own[j].text != ";" and not (self.own[j + 1].line > self.own[j].line and self.own[j].kind != "mark"):
                    j = self.end_of(j) if self.own[j].text in ("(", "[", "{") else j
                    if j + 1 < end and self.own[j + 1].line > self.own[j].line and self.own[j].text in (")", "]", "}"):
                        break
                    j += 1
                first = j + 1
            elif t.text in ("{", "["):
                j = self.end_of(j)
                first = j + 1 if t.text == "{" else first
            j += 1
        if not name.startswith("_"):
            self.add("class", name, [], i, end, attributes=fields, bases=bases)
            self.found.insert(place, self.found.pop())


def language_of(path: str) -> str | None:
    return next((lang for lang, ends in EXTENSIONS.items() if path.lower().endswith(ends)), None)


def read(text: str | None, lang: str) -> list[Symbol]:
    return Parser(text or "", lang).found


def rows_of(path: str, text: str | None) -> Iterator[tuple]:
    lang = language_of(path or "")
    for s in read(text, lang) if lang else ():
        kinds = "" if s.kind not in ("method", "function") else f"({', '.join(s.types)}) -> {s.returns[0]}"
        doc = re.sub(r"(?m)^\s*(?:/\*+|\*+/|\*|//+)[ \t]?|\s*\*+/\s*$", "", s.doc).strip() if s.doc else None
        yield path, s.kind, s.name, s.full_name, s.owner, s.name + kinds, s.params, s.types, s.returns, s.bases, s.attributes, doc, text[s.start : s.end], s.first, s.last, []


def symbols(files: DataFrame) -> DataFrame:
    """(path, symbol columns) of the Java, Go, JavaScript, C and C++ files among (path, content), told by their extension; overloads are rows of their own.

    Names that begin with an underscore are left out, as are Java's constructors. Null and empty
    files, and files of other kinds, have no symbols.
    """
    known = F.lower("path").rlike("(" + "|".join(re.escape(e) for ends in EXTENSIONS.values() for e in ends) + ")$")
    return arrow_rows(files.where(known), rows_of, f"path string, {SYMBOL}")
