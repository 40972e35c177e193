"""Regular expressions of the web's dialect (ECMAScript's grammar with its annex for browsers) in Java's and Python's.

Both engines agree on what is printed: classes as explicit ranges, anchors and word boundaries as look-around over
explicit sets, groups without names. What only Python's engine can run (look-behind without a greatest length, references
to groups that may not take part, script extensions) has no text for Java.
"""

from __future__ import annotations

import re
from functools import lru_cache


class JsPatternError(ValueError):
    """Not in the grammar, or outside what either engine can run."""


TOP, MOST = 0x10FFFF, (1 << 31) - 1
#: Line ends, digits, word characters and white space of the dialect.
LINE_ENDS = [(0x0A, 0x0A), (0x0D, 0x0D), (0x2028, 0x2029)]
DIGITS = [(0x30, 0x39)]
WORDS = [(0x30, 0x39), (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A)]
SPACES = [(0x09, 0x0D), (0x20, 0x20), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF)]
#: What case folding takes for i, k or s beside A to Z.
FOLDED = [(0x130, 0x131), (0x17F, 0x17F), (0x212A, 0x212A)]
#: General categories by their long names.
CATEGORIES = {
    "Letter": "L", "Cased_Letter": "LC", "Uppercase_Letter": "Lu", "Lowercase_Letter": "Ll", "Titlecase_Letter": "Lt", "Modifier_Letter": "Lm", "Other_Letter": "Lo",
    "Mark": "M", "Combining_Mark": "M", "Nonspacing_Mark": "Mn", "Spacing_Mark": "Mc", "Enclosing_Mark": "Me",
    "Number": "N", "Decimal_Number": "Nd", "digit": "Nd", "Letter_Number": "Nl", "Other_Number": "No",
    "Punctuation": "P", "punct": "P", "Connector_Punctuation": "Pc", "Dash_Punctuation": "Pd", "Open_Punctuation": "Ps", "Close_Punctuation": "Pe", "Initial_Punctuation": "Pi", "Final_Punctuation": "Pf", "Other_Punctuation": "Po",
    "Symbol": "S", "Math_Symbol": "Sm", "Currency_Symbol": "Sc", "Modifier_Symbol": "Sk", "Other_Symbol": "So",
    "Separator": "Z", "Space_Separator": "Zs", "Line_Separator": "Zl", "Paragraph_Separator": "Zp",
    "Other": "C", "Control": "Cc", "cntrl": "Cc", "Format": "Cf", "Surrogate": "Cs", "Private_Use": "Co", "Unassigned": "Cn",
}
#: Properties of yes and no that both engines know, by long and short name.
BINARY = {"Alphabetic": "Alphabetic", "Alpha": "Alphabetic", "Lowercase": "Lowercase", "Lower": "Lowercase", "Uppercase": "Uppercase", "Upper": "Uppercase", "White_Space": "White_Space", "space": "White_Space", "Ideographic": "Ideographic", "Ideo": "Ideographic"}
_SHORT = frozenset(CATEGORIES.values())
_SYNTAX = frozenset("^$\\.*+?()[]{}|/")
_CONTROL = {"f": 12, "n": 10, "r": 13, "t": 9, "v": 11}
_QUANTIFIER = re.compile(r"(?:([*+?])|\{(\d+)(?:(,)(\d*))?\})(\??)")
_NAME = re.compile(r"(?:[^\W\d]|\$|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]+\})(?:[\w$\u200c\u200d]|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]+\})*")
_MODIFIERS = re.compile(r"\(\?([ims]*)(?:-([ims]*))?:")
_HEX4 = re.compile(r"[0-9A-Fa-f]{4}")

Ranges = list[tuple[int, int]]


def _merged(ranges: Ranges) -> Ranges:
    out: Ranges = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _without(ranges: Ranges) -> Ranges:
    """All code points but those."""
    out, at = [], 0
    for lo, hi in _merged(ranges):
        if lo > at:
            out.append((at, lo - 1))
        at = hi + 1
    return out + ([(at, TOP)] if at <= TOP else [])


def _in_class(code: int) -> str:
    c = chr(code)
    if code < 0x20 or code == 0x7F:
        return f"\\x{code:02x}"
    if 0xD800 <= code < 0xE000:
        return f"\\u{code:04x}"
    return c if code >= 0x80 or c.isalnum() else "\\" + c


def _printed(ranges: Ranges) -> str:
    return "".join(_in_class(lo) if lo == hi else f"{_in_class(lo)}-{_in_class(hi)}" for lo, hi in _merged(ranges))


def _plain(code: int) -> str:
    """A character for itself."""
    if 0xD800 <= code < 0xE000:
        return f"\\u{code:04x}"
    c = chr(code)
    return "\\" + c if c in _SYNTAX and c != "/" else c


_WORD = f"[{_printed(WORDS)}]"
_LINE = f"[^{_printed(LINE_ENDS)}]"
_BOUNDARY = {"b": f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))", "B": f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"}


class _Printer:
    """Reads one pattern and prints it for one engine. ``native`` ends False where Java can't run it."""

    def __init__(self, source: str, flags: str, java: bool) -> None:
        self.s, self.k, self.java, self.native = source, 0, java, True
        self.unicode, self.sets = "u" in flags or "v" in flags, "v" in flags
        self.fold, self.lines, self.dots = "i" in flags, "m" in flags, "s" in flags
        self.groups, self.behind = 0, 0
        self.open: set[int] = set()
        #: Closed groups: that took part for sure, that are another alternative's, that may keep a loop's older text.
        self.sure: set[int] = set()
        self.other: set[int] = set()
        self.stale: set[int] = set()
        self.asked: list[int] = []
        self.names: dict[str, list[int]] = {}
        self.taken: set[str] = set()
        self._count()

    def _count(self) -> None:
        """Groups of the whole pattern, since a reference may stand before its group."""
        self.total, self.known, in_class, k = 0, [], False, 0
        while k < len(self.s):
            c = self.s[k]
            if c == "\\":
                k += 1
            elif c == "[":
                in_class = True
            elif c == "]":
                in_class = False
            elif c == "(" and not in_class:
                named = self.s.startswith("(?<", k) and self.s[k + 3 : k + 4] not in ("=", "!")
                if named or self.s[k + 1 : k + 2] != "?":
                    self.total += 1
                    self.known.append(self._name_at(k + 3)[0] if named else None)
            k += 1

    def _name_at(self, k: int) -> tuple[str, int]:
        m = _NAME.match(self.s, k)
        if not m or self.s[m.end() : m.end() + 1] != ">":
            raise JsPatternError("invalid group name")
        name = re.sub(r"\\u\{?([0-9A-Fa-f]+)\}?", lambda h: chr(min(int(h[1], 16), TOP)), m[0])
        return name, m.end() + 1

    def _at(self, text: str) -> bool:
        return self.s.startswith(text, self.k)

    def _eat(self, text: str) -> bool:
        found = self._at(text)
        self.k += len(text) * found
        return found

    def whole(self) -> str:
        out = self._disjunction()
        if self.k < len(self.s):
            raise JsPatternError("unmatched )")
        return out

    def _disjunction(self) -> str:
        sure, taken, other, parts = self.sure, self.taken, self.other, []
        sures, names, inner = None, set(), set()
        while True:
            first = self.groups
            self.sure, self.taken, self.other = set(sure), set(taken), other | inner
            parts.append(self._alternative())
            sures = self.sure if sures is None else sures & self.sure
            names |= self.taken
            inner |= set(range(first + 1, self.groups + 1))
            if not self._eat("|"):
                break
        self.sure, self.taken, self.other = sures, names, other
        return "|".join(parts)

    def _alternative(self) -> str:
        out = []
        while self.k < len(self.s) and self.s[self.k] not in "|)":
            out.append(self._term())
        return "".join(out)

    def _term(self) -> str:
        before, first, asked = set(self.sure), self.groups, len(self.asked)
        atom, may_repeat = self._atom()
        m = _QUANTIFIER.match(self.s, self.k)
        if not m:
            return atom
        if not may_repeat:
            raise JsPatternError("nothing to repeat")
        self.k = m.end()
        least = int(m[2]) if m[2] else int(m[1] == "+")
        most = {"?": 1}.get(m[1]) if m[1] else int(m[4]) if m[4] else None if m[3] else least
        if most is not None and least > most:
            raise JsPatternError("numbers of a quantifier out of order")
        self.native &= not (self.behind and most is None)
        if most is None or most > 1:
            if any(n > first for n in self.asked[asked:]):
                raise JsPatternError("a reference within a loop to a group of it that may not take part can't be run")
            self.stale |= set(range(first + 1, self.groups + 1)) - self.sure
        if least == 0:
            self.sure = before
        least, top = min(least, MOST), "" if most is None else str(min(most, MOST))
        return atom + (m[1] or (f"{{{least}}}" if not m[3] else f"{{{least},{top}}}")) + m[5]

    def _atom(self) -> tuple[str, bool]:
        """What stands here, and whether it may be repeated."""
        c = self.s[self.k]
        if c == "(":
            return self._group()
        if c == "[":
            self.k += 1
            return self._class(), True
        if c == "\\":
            return self._escape()
        if c in "*+?" or c == "{" and (self.unicode or _QUANTIFIER.match(self.s, self.k)):
            raise JsPatternError("nothing to repeat")
        if c in "]}" and self.unicode:
            raise JsPatternError(f"lone {c}")
        self.k += 1
        if c == "^":
            return (f"(?<!{_LINE})" if self.lines else "^"), False
        if c == "$":
            return (f"(?!{_LINE})" if self.lines else "(?![\\s\\S])"), False
        if c == ".":
            return ("[\\s\\S]" if self.dots else _LINE), True
        return _plain(ord(c)), True

    def _group(self) -> tuple[str, bool]:
        for opening in ("(?=", "(?!", "(?<=", "(?<!"):
            if self._eat(opening):
                behind, before = "<" in opening, set(self.sure)
                self.behind += behind
                inside = self._disjunction()
                self.behind -= behind
                if "!" in opening:
                    self.sure = before
                self._close()
                return f"(?:{opening}{inside}))", not behind and not self.unicode
        fold, lines, dots, number = self.fold, self.lines, self.dots, 0
        if self._eat("(?:"):
            start = "(?:"
        elif self._at("(?<"):
            name, self.k = self._name_at(self.k + 3)
            if name in self.taken:
                raise JsPatternError(f"two groups are called {name}")
            self.taken.add(name)
            number = self._opened()
            self.names.setdefault(name, []).append(number)
            start = "("
        elif self._at("(?"):
            m = _MODIFIERS.match(self.s, self.k)
            given = (m[1] + (m[2] or "")) if m else ""
            if not given or len(set(given)) < len(given):
                raise JsPatternError("invalid group")
            self.k = m.end()
            on, off = m[1], m[2] or ""
            self.fold, self.lines, self.dots = ((f in on or was) and f not in off for f, was in (("i", fold), ("m", lines), ("s", dots)))
            start = "(?iu:" if "i" in on else "(?-i:" if "i" in off else "(?:"
        else:
            self.k += 1
            number, start = self._opened(), "("
        inside = self._disjunction()
        self.fold, self.lines, self.dots = fold, lines, dots
        if number:
            self.open.discard(number)
            self.sure.add(number)
        self._close()
        return start + inside + ")", True

    def _opened(self) -> int:
        self.groups += 1
        self.open.add(self.groups)
        return self.groups

    def _close(self) -> None:
        if not self._eat(")"):
            raise JsPatternError("unterminated group")

    def _reference(self, n: int) -> str:
        """A group that took no part fits everything in this dialect, and nothing in the two engines."""
        if n in self.open or n > self.groups or n in self.other:
            return "(?:)"
        self.native &= not self.behind
        if n in self.sure:
            return f"(?:\\{n})"
        if n in self.stale:
            raise JsPatternError("a reference to a group that a loop may leave out can't be run")
        self.native = False
        self.asked.append(n)
        return f"(?({n})\\{n})"

    def _escape(self) -> tuple[str, bool]:
        self.k += 1
        c = self.s[self.k : self.k + 1]
        if c in ("b", "B"):
            self.k += 1
            return _BOUNDARY[c], False
        if c and c in "123456789":
            m = re.compile(r"\d+").match(self.s, self.k)
            if int(m[0]) <= self.total:
                self.k = m.end()
                return self._reference(int(m[0])), True
            if self.unicode:
                raise JsPatternError("reference to no group")
        if c == "k" and (self.unicode or any(self.known)):
            if not self._eat("k<"):
                raise JsPatternError("invalid reference")
            name, self.k = self._name_at(self.k)
            numbers = [n + 1 for n, known in enumerate(self.known) if known == name]
            if not numbers:
                raise JsPatternError("reference to no group")
            able = [n for n in numbers if n <= self.groups and n not in self.open and n not in self.other]
            if len(able) > 1:
                raise JsPatternError("a reference to one of several groups can't be run")
            return self._reference(able[0] if able else numbers[0]), True
        ranges = self._set_escape()
        if ranges is not None:
            body, negated = ranges
            return (f"[{'^' * negated}{body}]" if body else "(?!)"), True
        return _plain(self._character(False)), True

    def _set_escape(self) -> tuple[str, bool] | None:
        """The body of a class for d, D, s, S, w, W, p and P, and whether it is negated."""
        c = self.s[self.k : self.k + 1]
        kinds = {"d": DIGITS, "s": SPACES, "w": WORDS}
        if c and c.lower() in kinds:
            self.k += 1
            kind = kinds[c.lower()]
            if c.lower() == "w" and self.fold and self.unicode:
                kind = kind + FOLDED[1:]
            if c.islower():
                return _printed(kind), False
            # A class that folds would let these stand for plain letters.
            return _printed(_without(kind + (FOLDED if c == "W" and self.fold else []))), False
        if c in ("p", "P") and self.unicode:
            m = re.compile(r"[pP]\{(?:(\w+)=)?(\w+)\}").match(self.s, self.k)
            if not m:
                raise JsPatternError("invalid property")
            self.k = m.end()
            return self._property(m[1], m[2], c == "P"), False
        return None

    def _property(self, key: str | None, value: str, negated: bool) -> str:
        sign = "P" if negated else "p"
        if key in (None, "General_Category", "gc"):
            short = CATEGORIES.get(value, value if value in _SHORT else None)
            if short == "LC":
                if negated:
                    raise JsPatternError("all but LC can't be run")
                return "\\p{Lu}\\p{Ll}\\p{Lt}"
            if short:
                return f"\\{sign}{{{short}}}"
        if key in ("Script", "sc", "Script_Extensions", "scx"):
            self.native &= key[:3] != "scx" and key != "Script_Extensions"
            name = "scx" if key in ("Script_Extensions", "scx") else "script"
            return f"\\{sign}{{{name}={value}}}"
        if key is None and value in ("Any", "ASCII"):
            ranges = [(0, TOP if value == "Any" else 0x7F)]
            return _printed(_without(ranges) if negated else ranges)
        if key is None and value == "Assigned":
            return f"\\{'p' if negated else 'P'}{{Cn}}"
        if key is None and value in BINARY:
            return f"\\{sign}{{{'Is' if self.java else ''}{BINARY[value]}}}"
        raise JsPatternError(f"unknown property {value}")

    def _octal(self) -> int:
        m = re.compile(r"[0-3][0-7]{0,2}|[4-7][0-7]?").match(self.s, self.k)
        self.k = m.end()
        return int(m[0], 8)

    def _character(self, in_class: bool) -> int:
        """The code point that an escape stands for; what is before is the backslash."""
        c = self.s[self.k : self.k + 1]
        if not c:
            raise JsPatternError("\\ at the end")
        if c.isdigit() and c.isascii():
            if c == "0" and not self.s[self.k + 1 : self.k + 2].isdigit():
                self.k += 1
                return 0
            if self.unicode:
                raise JsPatternError("invalid decimal escape")
            if c < "8":
                return self._octal()
        elif c in _CONTROL:
            self.k += 1
            return _CONTROL[c]
        elif c == "c":
            letter = self.s[self.k + 1 : self.k + 2]
            if letter.isascii() and (letter.isalpha() or in_class and not self.unicode and letter and (letter.isdigit() or letter == "_")):
                self.k += 2
                return ord(letter) % 32
            if self.unicode:
                raise JsPatternError("invalid control escape")
            return ord("\\")  # the c stands for itself
        elif c == "x":
            m = re.compile(r"[0-9A-Fa-f]{2}").match(self.s, self.k + 1)
            if m:
                self.k = m.end()
                return int(m[0], 16)
        elif c == "u":
            code = self._unicode_escape()
            if code is not None:
                return code
        if self.unicode:
            if not (c in _SYNTAX or in_class and c == "-"):
                raise JsPatternError(f"invalid escape \\{c}")
        elif c == "k" and any(self.known):
            raise JsPatternError("invalid reference")
        self.k += 1
        return ord(c)

    def _unicode_escape(self) -> int | None:
        m = re.compile(r"u\{([0-9A-Fa-f]+)\}").match(self.s, self.k) if self.unicode else None
        if m:
            if int(m[1], 16) > TOP:
                raise JsPatternError("code point out of range")
            self.k = m.end()
            return int(m[1], 16)
        m = _HEX4.match(self.s, self.k + 1)
        if not m:
            return None
        self.k, high = m.end(), int(m[0], 16)
        low = _HEX4.match(self.s, self.k + 2) if 0xD800 <= high < 0xDC00 and self._at("\\u") else None
        if low and 0xDC00 <= int(low[0], 16) < 0xE000:
            self.k = low.end()
            return 0x10000 + ((high - 0xD800) << 10) + int(low[0], 16) - 0xDC00
        return high

    def _class(self) -> str:
        negated, ranges, more = self._eat("^"), [], ""
        while not self._eat("]"):
            low = self._class_atom()
            if self._at("-") and not self._at("-]") and self.k + 1 < len(self.s):
                self.k += 1
                high = self._class_atom()
                if isinstance(low, int) and isinstance(high, int):
                    if low > high:
                        raise JsPatternError("range out of order in a class")
                    ranges.append((low, high))
                    continue
                if self.unicode:
                    raise JsPatternError("a range needs characters")
                parts = (low, ord("-"), high)
            else:
                parts = (low,)
            ranges += [(x, x) for x in parts if isinstance(x, int)]
            more += "".join(x for x in parts if isinstance(x, str))
        body = _printed(ranges) + more
        return (f"[{'^' * negated}{body}]") if body else "[\\s\\S]" if negated else "(?!)"

    def _class_atom(self) -> int | str:
        """A code point, or the body of a class."""
        if self.k >= len(self.s):
            raise JsPatternError("unterminated class")
        if self.sets and (self._at("[") or self._at("--") or self._at("&&") or self._at("\\q")):
            raise JsPatternError("nested classes and operations on them can't be run")
        c = self.s[self.k]
        self.k += 1
        if c != "\\":
            return ord(c)
        if self._eat("b"):
            return 8
        found = self._set_escape()
        return self._character(True) if found is None else found[0]


@lru_cache(maxsize=512)
def translated(source: str, flags: str) -> tuple[str, str | None]:
    """The pattern for Python's and for Java's engine; JsPatternError where it isn't one."""
    if len(set(flags)) < len(flags) or set(flags) - set("dgimsuvy") or {"u", "v"} <= set(flags):
        raise JsPatternError(f"invalid flags {flags!r}")
    out = []
    for java in (False, True):
        printer = _Printer(source, flags, java)
        text = printer.whole()
        if "y" in flags:
            text = f"(?<![\\s\\S])(?:{text})"
        out.append(None if java and not printer.native else ("(?iu)" if "i" in flags else "") + text)
    return out[0], out[1]
