"""JSON as models write it: read as far as it goes, with what was meant where that is plain."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Words for constants, and the escapes of one character.
CONSTANTS = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None, "undefined": None, "NaN": None}
ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’"}
NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?\Z")
LOOSE_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\Z")
BLANK = re.compile(r"(?:[\s\ufeff]+|//[^\n]*|/\*.*?(?:\*/|\Z)|#[^\n]*)+", re.S)
#: What may follow a string: a mark, the end, or, where a comma is missing, another key.
AFTER_STRING = re.compile(r"""\s*(?:[,:}\]]|\Z|"[^"\n]*"\s*:|'[^'\n]*'\s*:)""")
WORD = re.compile(r"[^\s,:{}\[\]\"']+(?:[ \t]+[^\s,:{}\[\]\"']+)*")
NOTHING = object()


@dataclass
class Repaired:
    """``status`` is valid, repaired, truncated (the text ended inside the value, which is closed here) or failed (there is no value); ``at`` is the place of the first repair or of the end."""

    value: object
    status: str
    at: int


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.first: int | None = None  # the first repair
        self.open_end = False

    def mend(self, at: int) -> None:
        self.first = at if self.first is None else self.first

    def blank(self) -> None:
        if m := BLANK.match(self.text, self.at):
            if m.group().strip(" \t\n\r"):
                self.mend(self.at)
            self.at = m.end()

    def string(self) -> str:
        """A string in any quotes; a quote that nothing fitting follows belongs to it."""
        quote, start = QUOTES[self.text[self.at]], self.at
        if self.text[self.at] != '"':
            self.mend(start)
        self.at += 1
        out = []
        while self.at < len(self.text):
            c = self.text[self.at]
            self.at += 1
            if c == "\\":
                e = self.text[self.at : self.at + 1]
                self.at += 1
                if e == "u":
                    code = self.text[self.at : self.at + 4]
                    if re.fullmatch(r"[0-9a-fA-F]{4}", code):
                        out.append(chr(int(code, 16)))
                        self.at += 4
                    elif self.at + len(code) < len(self.text):
                        self.mend(self.at)
                        out.append("\\u")
                    else:
                        self.at = len(self.text)
                else:
                    if e and e not in "\"\\/bfnrt":
                        self.mend(self.at - 1)
                    out.append(ESCAPES.get(e, e))
            elif c == quote and AFTER_STRING.match(self.text, self.at):
                return self.joined(out)
            else:
                if c == quote or c < " ":
                    self.mend(self.at - 1)
                out.append(c)
        self.open_end = True
        return self.joined(out)

    @staticmethod
    def joined(parts: list[str]) -> str:
        """Pairs of surrogates are one character, and a half by itself is none."""
        return "".join(parts).encode("utf-16", "surrogatepass").decode("utf-16", "replace")

    def word(self):
        """A constant, a number, or else a string without quotes; NOTHING where the text ended within."""
        m = WORD.match(self.text, self.at)
        if not m:
            return NOTHING
        word, start, self.at = m.group(), self.at, m.end()
        ended = self.at == len(self.text)
        if NUMBER.match(word):
            return float(word) if re.search(r"[.eE]", word) else int(word)
        if word in CONSTANTS:
            if word not in ("true", "false", "null"):
                self.mend(start)
            return CONSTANTS[word]
        if ended and (any(x.startswith(word) for x in ("true", "false", "null")) or re.fullmatch(r"-?(?:\d+(?:\.\d*)?(?:[eE][+-]?)?)?", word)):
            self.open_end = True
            return NOTHING
        self.mend(start)
        return float(word) if LOOSE_NUMBER.match(word) else word


def repair(text: str) -> Repaired:
    """Read a value: keys and strings may lack quotes or have others, commas may be missing or too many, comments are passed over, and what is open at the end is closed.

    Depth is limited by memory alone. What follows the value is left, and counts as a repair.
    """
    r = _Reader(text)
    root: object = NOTHING
    stack: list = []  # open lists, and objects with the key that waits for its value
    r.blank()
    while r.at < len(text):
        top = stack[-1] if stack else None
        c = text[r.at]
        value: object = NOTHING
        if top is not None and c in "}]":
            wanted = dict if c == "}" else list
            if any(isinstance(s[0], wanted) for s in stack):
                while not isinstance(stack[-1][0], wanted):
                    r.mend(r.at)
                    stack.pop()
                own, key, comma = stack.pop()
                if key is not NOTHING:
                    own[key] = None
                if key is not NOTHING or comma:
                    r.mend(r.at)
            else:
                r.mend(r.at)
            r.at += 1
            if not stack:
                break
            r.blank()
            continue
        if top is not None and c == ",":
            if top[1] is not NOTHING:
                top[0][top[1]] = None
                top[1] = NOTHING
                r.mend(r.at)
            elif top[2] or not top[0]:
                r.mend(r.at)
            top[2] = True
            r.at += 1
            r.blank()
            continue
        if top is not None and top[0] and not top[2] and top[1] is NOTHING:
            r.mend(r.at)  # a comma is missing
        if top is not None and isinstance(top[0], dict) and top[1] is NOTHING:
            start = r.at
            if c in QUOTES:
                key = r.string()
            else:
                m = WORD.match(text, r.at)
                key = m.group() if m else None
                r.mend(r.at)
                r.at = m.end() if m else r.at + 1
            top[2] = False
            r.blank()
            if key is not None:
                if text[r.at : r.at + 1] == ":":
                    top[1] = key
                    r.at += 1
                elif r.at < len(text):
                    r.mend(start)
                    top[0][key] = None
            r.blank()
            continue
        if c in "{[":
            value = {} if c == "{" else []
            r.at += 1
        elif c in QUOTES:
            value = r.string()
        else:
            value = r.word()
            if value is NOTHING and not r.open_end:
                r.mend(r.at)
                r.at += 1
                r.blank()
                continue
        if value is not NOTHING:
            if top is None:
                root = value
            elif isinstance(top[0], list):
                top[0].append(value)
                top[2] = False
            else:
                top[0][top[1]] = value
                top[1], top[2] = NOTHING, False
            if isinstance(value, dict | list):
                stack.append([value, NOTHING, False])
            elif top is None:
                break
        r.blank()
    if stack or r.open_end:
        for own, key, _ in stack:
            if key is not NOTHING:
                own.setdefault(key, None)
        return Repaired(None if root is NOTHING else root, "truncated", len(text))
    if root is NOTHING:
        return Repaired(None, "failed", r.first or 0)
    end = r.at
    r.blank()
    if r.at < len(text):
        r.mend(end)
    return Repaired(root, "valid" if r.first is None else "repaired", len(text) if r.first is None else r.first)
