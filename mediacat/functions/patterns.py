"""Regular expressions in RE2 syntax, rewritten for the JVM's engine.

What RE2 rejects is rejected here, what the two engines read differently is spelled out: ends of text and lines, the dot,
white space and word borders, classes, flags, names of groups.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import SparkSession

# Named classes.
NAMED_CLASSES = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t\x20", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": r"\x21-\x7E", "lower": "a-z",
    "print": r"\x20-\x7E", "punct": r"\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E", "space": r"\t\n\x0B\f\r\x20", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
LETTER_CLASSES = {"d": "0-9", "w": "0-9A-Za-z_", "s": r"\t\n\f\r\x20"}
CONTROLS = {"a": 7, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11}
WORD = "[0-9A-Za-z_]"
BORDER = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
INSIDE = f"(?:(?<={WORD})(?={WORD})|(?<!{WORD})(?!{WORD}))"
ANY = "(?s:.)"
MOST_REPEATS = 1000
REPEAT = re.compile(r"[*+?]|\{([0-9]+)(?:(,)([0-9]*))?\}")
GROUP = re.compile(r"\(\?(?:P?<(?P<name>[0-9A-Za-z_]+)>|(?P<on>[imsU]*)(?P<off>-[imsU]+)?(?P<end>[:)]))")


class PatternError(ValueError):
    """The pattern is not RE2 syntax."""


def literal(code: int) -> str:
    c = chr(code)
    return c if c.isascii() and c.isalnum() else f"\\x{{{code:X}}}"


class _Translation:
    def __init__(self, text: str) -> None:
        self.text, self.at, self.out, self.groups = text, 0, [], 0
        self.names: set[str] = set()
        self.flags: frozenset[str] = frozenset()

    def run(self) -> str:
        outer: list[frozenset[str]] = []
        repeatable = False  # whether the last item may be repeated
        while self.at < len(self.text):
            c = self.text[self.at]
            if self.text.startswith("\\Q", self.at):
                end = self.text.find("\\E", self.at)
                quoted = self.text[self.at + 2 : end if end >= 0 else None]
                self.out += [literal(ord(x)) for x in quoted]
                self.at = end + 2 if end >= 0 else len(self.text)
                repeatable = repeatable or bool(quoted)
            elif (m := REPEAT.match(self.text, self.at)) is not None:
                if not repeatable:
                    raise PatternError("nothing to repeat")
                self._repeat(m)
                repeatable = False
            elif c == "(":
                opened = self._open()
                if opened is not None:
                    outer.append(opened)
                repeatable = False
            elif c == ")":
                if not outer:
                    raise PatternError("a bracket is closed that was not opened")
                self.flags, repeatable = outer.pop(), True
                self._put(")", 1)
            elif c == "|":
                self._put("|", 1)
                repeatable = False
            else:
                self._item(c)
                repeatable = True
        if outer:
            raise PatternError("a bracket is not closed")
        return "".join(self.out)

    def _put(self, java: str, length: int) -> None:
        self.out.append(java)
        self.at += length

    def _repeat(self, m: re.Match) -> None:
        if m[1] is not None:
            low, high = int(m[1]), int(m[3] or m[1])
            if max(low, high) > MOST_REPEATS or high < low:
                raise PatternError("a repetition out of range")
        lazy = self.text.startswith("?", m.end())
        self._put(m[0] + ("?" if lazy != ("U" in self.flags) else ""), len(m[0]) + lazy)

    def _open(self) -> frozenset[str] | None:
        """Opens a group and returns the flags that hold after it, or sets flags and returns None."""
        before = self.flags
        if not self.text.startswith("(?", self.at):
            self.groups += 1
            self._put("(", 1)
            return before
        m = GROUP.match(self.text, self.at)
        if m is None or m["end"] == ")" and not m["on"] and not m["off"]:
            raise PatternError("an unknown kind of group")
        if m["name"]:
            if m["name"] in self.names:
                raise PatternError("two groups of one name")
            self.names.add(m["name"])
            self.groups += 1
            self._put("(", len(m[0]))
            return before
        self.flags = (before | set(m["on"])) - set((m["off"] or "")[1:])
        case = "" if ("i" in self.flags) == ("i" in before) else "iu" if "i" in self.flags else "-iu"
        if m["end"] == ")":
            self._put(f"(?{case})" if case else "", len(m[0]))
            return None
        self._put(f"(?{case}:", len(m[0]))
        return before

    def _item(self, c: str) -> None:
        if c == ".":
            self._put(ANY if "s" in self.flags else r"[^\n]", 1)
        elif c == "^":
            self._put(r"(?<![^\n])" if "m" in self.flags else r"\A", 1)
        elif c == "$":
            self._put(r"(?![^\n])" if "m" in self.flags else r"\z", 1)
        elif c == "[":
            self._class()
        elif c == "\\":
            two = self.text[self.at : self.at + 2]
            if two[1:] in ("A", "z"):
                self._put(two, 2)
            elif two[1:] in ("b", "B"):
                self._put(BORDER if two == "\\b" else INSIDE, 2)
            else:
                kind, value = self._escape()
                self.out.append(f"[{value}]" if kind == "set" else literal(value))
        else:
            self._put(literal(ord(c)), 1)

    def _escape(self) -> tuple[str, object]:
        """('code', code point) or ('set', inside of a class) of the escape at this place, which is passed."""
        rest = self.text[self.at + 1 :]
        if not rest:
            raise PatternError("a backslash at the end")
        c = rest[0]
        if c.lower() in LETTER_CLASSES:
            self.at += 2
            inside = LETTER_CLASSES[c.lower()]
            return "set", inside if c.islower() else f"[^{inside}]"
        if m := re.match(r"[pP](?:\{(\^?)(\w+)\}|(\w))", rest):
            self.at += 1 + len(m[0])
            name, inverse = m[2] or m[3], (c == "P") != bool(m[1])
            if name == "Any":
                return "set", r"\x{0}-\x{10FFFF}" if not inverse else r"[^\x{0}-\x{10FFFF}]"
            return "set", f"\\{'P' if inverse else 'p'}{{{name if len(name) <= 2 else 'script=' + name}}}"
        if m := re.match(r"x(?:([0-9A-Fa-f]{2})|\{([0-9A-Fa-f]+)\})|(0[0-7]{0,2}|[1-7][0-7]{1,2})", rest):
            code = int(m[3], 8) if m[3] else int(m[1] or m[2], 16)
            if code <= 0x10FFFF:
                self.at += 1 + len(m[0])
                return "code", code
        if c in CONTROLS:
            self.at += 2
            return "code", CONTROLS[c]
        if c.isascii() and not c.isalnum():
            self.at += 2
            return "code", ord(c)
        raise PatternError(f"an unknown escape \\{c}")

    def _class(self) -> None:
        self.at += 1
        inverse = self.text.startswith("^", self.at)
        self.at += inverse
        parts, first = [], True
        while first or not self.text.startswith("]", self.at):
            first = False
            if self.at >= len(self.text):
                raise PatternError("a class is not closed")
            if m := re.match(r"\[:(\^?)(\w+):\]", self.text[self.at :]):
                if m[2] not in NAMED_CLASSES:
                    raise PatternError(f"an unknown class {m[2]}")
                parts.append(f"[^{NAMED_CLASSES[m[2]]}]" if m[1] else NAMED_CLASSES[m[2]])
                self.at += len(m[0])
                continue
            kind, low = self._member()
            if kind == "set":
                parts.append(low)
                continue
            high = low
            if self.text.startswith("-", self.at) and not self.text.startswith("-]", self.at):
                self.at += 1
                kind, high = self._member()
                if kind == "set" or high < low:
                    raise PatternError("a bad range in a class")
            parts.append(f"\\x{{{low:X}}}" + (f"-\\x{{{high:X}}}" if high > low else ""))
        self.at += 1
        inside = f"[{''.join(parts)}]"
        self.out.append(f"(?:(?!{inside}){ANY})" if inverse else inside)  # not [^...]: it would not hold for classes inside

    def _member(self) -> tuple[str, object]:
        if self.at >= len(self.text):
            raise PatternError("a class is not closed")
        if self.text[self.at] == "\\":
            return self._escape()
        self.at += 1
        return "code", ord(self.text[self.at - 1])


@functools.lru_cache(maxsize=1024)
def to_java(pattern: str) -> tuple[str, int]:
    """The pattern for the JVM and its number of groups; PatternError if it is not RE2 syntax."""
    t = _Translation(pattern)
    return t.run(), t.groups


def compiles(java: str) -> bool:
    """Whether the JVM takes a pattern (it knows which scripts and categories there are)."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("patterns are compiled by the JVM of the active session; there is none")
    try:
        spark._jvm.java.util.regex.Pattern.compile(java)
    except Exception as e:
        if re.search("PatternSyntax|IllegalArgument", f"{type(e).__name__} {e}"):
            return False
        raise
    return True
