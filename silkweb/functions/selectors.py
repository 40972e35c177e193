"""CSS selectors on parsed pages: compounds, combinators, lists, and pseudo-classes of structure, content and negation.

A selector is compiled to tests, a compound's against one element, read from right to left. Places among siblings are
counted once for each parent and page.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from silkweb.functions.htmltree import Comment, Node

_NAME = r"(?:[\w\-]|[^\x00-\x7f]|\\(?:[0-9a-fA-F]{1,6}\s?|.))+"
_SIMPLE = re.compile(
    rf"""(?P<any>\*)|\#(?P<id>{_NAME})|\.(?P<cls>{_NAME})|::?(?P<pseudo>[\w\-]+)(?P<call>\()?|(?P<tag>{_NAME})
    |\[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~|^$*!]?=)\s*(?:"(?P<dq>(?:[^"\\]|\\.)*)"|'(?P<sq>(?:[^'\\]|\\.)*)'|(?P<bare>{_NAME}))\s*(?P<case>[iIsS])?\s*)?\]""",
    re.X,
)
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")
_STEP = re.compile(r"(?i)\s*(?:(?P<word>odd|even)|(?P<a>[+-]?\d*)n(?:\s*(?P<sign>[+-])\s*(?P<b>\d+))?|(?P<only>[+-]?\d+))\s*(?:of\s+(?P<of>.+))?$", re.S)
#: Values of attributes that HTML compares without regard to case.
_ANY_CASE = set("align charset checked color compact content-type dir direction disabled face enctype http-equiv lang language link media method multiple rel rev rules scope selected shape target type valign valuetype".split())


class SelectorError(ValueError):
    """The selector isn't among those that are understood."""


class Siblings:
    """Places among siblings, counted for a parent when first asked for."""

    def __init__(self) -> None:
        self.rows: dict[int, tuple[list[Node], dict[int, int]]] = {}

    def of(self, node: Node) -> tuple[list[Node], int]:
        """(the elements that share the node's parent, its place among them)"""
        if node.parent is None:
            return [node], 0
        known = self.rows.get(id(node.parent))
        if known is None:
            row = [c for c in node.parent.children if isinstance(c, Node)]
            known = self.rows[id(node.parent)] = row, {id(c): k for k, c in enumerate(row)}
        return known[0], known[1][id(node)]


Test = Callable[[Node, Siblings], bool]


def _unescaped(name: str) -> str:
    return re.sub(r"\\(?:([0-9a-fA-F]{1,6})\s?|(.))", lambda m: chr(int(m[1], 16)) if m[1] else m[2], name)


def _attr_test(name: str, op: str | None, want: str, fold: bool) -> Test:
    want = want.lower() if fold else want

    def test(node: Node, _) -> bool:
        have = node.attrs.get(name)
        if op == "!=":
            return have is None or (have.lower() if fold else have) != want
        if have is None or op is None:
            return have is not None
        have = have.lower() if fold else have
        if op == "=":
            return have == want
        if op == "~=":
            return bool(want) and want in have.split()
        if op == "|=":
            return have == want or have.startswith(want + "-")
        return bool(want) and (have.startswith(want) if op == "^=" else have.endswith(want) if op == "$=" else want in have)

    return test


def text_below(node: Node) -> str:
    """All text in an element, comments aside."""
    out, stack = [], list(reversed(node.children))
    while stack:
        child = stack.pop()
        if isinstance(child, Node):
            stack.extend(reversed(child.children))
        elif not isinstance(child, Comment):
            out.append(child)
    return "".join(out)


def _steps(text: str) -> tuple[int, int, str | None]:
    """(a, b, of) of ``an+b of selector``."""
    m = _STEP.match(text)
    if not m:
        raise SelectorError(text)
    if m["word"]:
        return 2, int(m["word"].lower() == "odd"), m["of"]
    if m["only"]:
        return 0, int(m["only"]), m["of"]
    a = int(m["a"] + "1") if m["a"] in ("", "+", "-") else int(m["a"])
    return a, int((m["sign"] or "+") + (m["b"] or "0")), m["of"]


def _on_step(place: int, a: int, b: int) -> bool:
    return place == b if a == 0 else (place - b) % a == 0 and (place - b) // a >= 0


def _nth(argument: str, last: bool, same_type: bool) -> Test:
    a, b, of = _steps(argument)
    if of and same_type:
        raise SelectorError(argument)
    among = compile_selector(of) if of else None

    def test(node: Node, siblings: Siblings) -> bool:
        row, at = siblings.of(node)
        if among and not fits_any(node, among, siblings):
            return False
        before = row[at + 1 :] if last else row[:at]
        if same_type:
            before = [n for n in before if n.tag == node.tag]
        elif among:
            before = [n for n in before if fits_any(n, among, siblings)]
        return _on_step(len(before) + 1, a, b)

    return test


def _has(argument: str) -> Test:
    relative = [_complex(part, True) for part in _listed(argument)]

    def test(node: Node, siblings: Siblings) -> bool:
        for first, chain in relative:
            if first in ("+", "~"):
                row, at = siblings.of(node)
                heads = row[at + 1 : at + 2] if first == "+" else row[at + 1 :]
                found = [*heads, *(n for h in heads for n in h.elements())]
            else:
                found = node.elements()
            if any(_fits(n, chain, siblings, 0, (node, first)) for n in found):
                return True
        return False

    return test


def _pseudo(name: str, argument: str | None) -> Test:
    name = name.lower()
    if argument is not None:
        if name in ("is", "where", "matches", "any"):
            among = compile_selector(argument)
            return lambda n, s: fits_any(n, among, s)
        if name == "not":
            among = compile_selector(argument)
            return lambda n, s: not fits_any(n, among, s)
        if name == "has":
            return _has(argument)
        if name in ("contains", "icontains"):
            want = _unescaped(argument.strip()[1:-1] if argument.strip()[:1] in "\"'" and argument.strip() else argument)
            if name == "icontains":
                return lambda n, _, want=want.lower(): want in text_below(n).lower()
            return lambda n, _: want in text_below(n)
        if name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type"):
            return _nth(argument, "last" in name, name.endswith("type"))
        raise SelectorError(name)
    if name in ("first-child", "last-child", "first-of-type", "last-of-type"):
        return _nth("1", name.startswith("last"), name.endswith("type"))
    if name in ("only-child", "only-of-type"):
        first, last = _nth("1", False, name.endswith("type")), _nth("1", True, name.endswith("type"))
        return lambda n, s: first(n, s) and last(n, s)
    plain: dict[str, Test] = {
        "root": lambda n, _: n.parent is not None and n.parent.tag == "#document",
        "empty": lambda n, _: all(isinstance(c, Comment) or c == "" for c in n.children),
        "parent": lambda n, _: any(not isinstance(c, Comment) and c != "" for c in n.children),
        "link": lambda n, _: n.tag in ("a", "area", "link") and "href" in n.attrs,
        "any-link": lambda n, _: n.tag in ("a", "area", "link") and "href" in n.attrs,
        "checked": lambda n, _: "checked" in n.attrs or n.tag == "option" and "selected" in n.attrs,
        "selected": lambda n, _: n.tag == "option" and "selected" in n.attrs,
        "disabled": lambda n, _: "disabled" in n.attrs,
        "enabled": lambda n, _: n.tag in ("button", "input", "select", "textarea", "option", "optgroup", "fieldset") and "disabled" not in n.attrs,
        "required": lambda n, _: n.tag in ("input", "select", "textarea") and "required" in n.attrs,
        "optional": lambda n, _: n.tag in ("input", "select", "textarea") and "required" not in n.attrs,
        "header": lambda n, _: n.tag in ("h1", "h2", "h3", "h4", "h5", "h6"),
        "button": lambda n, _: n.tag == "button" or n.tag == "input" and n.attrs.get("type") == "button",
        "input": lambda n, _: n.tag in ("input", "textarea", "select", "button"),
    }
    if name not in plain:
        raise SelectorError(name)
    return plain[name]


def _closing(text: str, at: int) -> int:
    """Place of the bracket that closes the one before ``at``."""
    depth, quote = 1, ""
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 1
        elif quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if not depth:
                return at
        at += 1
    raise SelectorError(text)


def _listed(selector: str) -> list[str]:
    """The alternatives of a list, commas within brackets and quotes aside."""
    out, at, begin, text = [], 0, 0, selector
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 1
        elif c in "([":
            at = _closing(text, at + 1)
        elif c in "\"'":
            at = text.find(c, at + 1)
            if at < 0:
                raise SelectorError(selector)
        elif c == ",":
            out.append(text[begin:at].strip())
            begin = at + 1
        at += 1
    out.append(text[begin:].strip())
    if not all(out):
        raise SelectorError(selector)
    return out


def _compound(text: str, at: int) -> tuple[list[Test], int]:
    tests: list[Test] = []
    begin = at
    while at < len(text) and (m := _SIMPLE.match(text, at)):
        if (m["tag"] or m["any"]) and at > begin:
            raise SelectorError(text)
        at = m.end()
        if m["tag"]:
            tests.append(lambda n, _, tag=_unescaped(m["tag"]).lower(): n.tag == tag)
        elif m["id"]:
            tests.append(lambda n, _, want=_unescaped(m["id"]): n.attrs.get("id") == want)
        elif m["cls"]:
            tests.append(lambda n, _, want=_unescaped(m["cls"]): want in n.attrs.get("class", "").split())
        elif m["attr"]:
            want = next((m[g] for g in ("dq", "sq", "bare") if m[g] is not None), "")
            name, case = _unescaped(m["attr"]).lower(), (m["case"] or "").lower()
            tests.append(_attr_test(name, m["op"], _unescaped(want), case == "i" or not case and name in _ANY_CASE))
        elif m["pseudo"]:
            argument = None
            if m["call"]:
                end = _closing(text, at)
                argument, at = text[at:end], end + 1
            tests.append(_pseudo(m["pseudo"], argument))
    if at == begin:
        raise SelectorError(text)
    return tests, at


def _complex(text: str, relative: bool = False) -> tuple[str, list]:
    """(combinator before the first compound, [(combinator to the right, tests), ...] from right to left)"""
    first, at = " ", 0
    if relative and (m := re.match(r"\s*([>+~])\s*", text)):
        first, at = m[1], m.end()
    pieces: list[tuple[str | None, list[Test]]] = []
    how: str | None = None
    while True:
        tests, at = _compound(text, at)
        pieces.append((how, tests))
        if at == len(text):
            break
        m = _COMBINATOR.match(text, at)
        if not m:
            raise SelectorError(text)
        how, at = m[1] or " ", m.end()
    # Each compound is reached from the one to its right, so the combinator moves over by one.
    return first, [(pieces[k + 1][0] if k + 1 < len(pieces) else None, pieces[k][1]) for k in range(len(pieces) - 1, -1, -1)]


@lru_cache(maxsize=512)
def compile_selector(selector: str) -> tuple:
    """A list of alternatives, each [(combinator, tests), ...] from right to left. SelectorError if not understood."""
    return tuple(_complex(part)[1] for part in _listed(selector.strip()))


def fits_any(node: Node, alternatives: tuple, siblings: Siblings) -> bool:
    return any(_fits(node, chain, siblings) for chain in alternatives)


def _fits(node: Node, chain: list, siblings: Siblings, at: int = 0, scope: tuple[Node, str] | None = None) -> bool:
    if not all(test(node, siblings) for test in chain[at][1]):
        return False
    if at + 1 == len(chain):
        if scope is None:
            return True
        root, how = scope
        if how == ">":
            return node.parent is root
        if how == "+" or how == "~":
            row, place = siblings.of(node)
            return any(n is root for n in (row[place - 1 : place] if how == "+" else row[:place]))
        return node is not root
    how = chain[at + 1][0]
    if how == ">":
        return node.parent is not None and _fits(node.parent, chain, siblings, at + 1, scope)
    if how == "+" or how == "~":
        row, place = siblings.of(node)
        return any(_fits(n, chain, siblings, at + 1, scope) for n in reversed(row[max(0, place - 1) : place] if how == "+" else row[:place]))
    up = node.parent
    while up is not None:
        if _fits(up, chain, siblings, at + 1, scope):
            return True
        up = up.parent
    return False


_PLAIN = re.compile(r"[A-Za-z][A-Za-z0-9]*")
_OF_ATTRIBUTE = re.compile(r"\[\s*([A-Za-z\-]+)\s*(?:[~|^$*]?=[^\]]*)?\]")


@lru_cache(maxsize=512)
def _indexed(selector: str) -> tuple[frozenset, tuple, tuple]:
    """A selector's plain tags, its alternatives of one attribute under the attribute's name, and the others."""
    tags, of_attribute, others = set(), [], []
    for text in _listed(selector.strip()):
        if _PLAIN.fullmatch(text):
            tags.add(text.lower())
        elif m := _OF_ATTRIBUTE.fullmatch(text):
            of_attribute.append((m[1].lower(), *compile_selector(text)))
        else:
            others += compile_selector(text)
    return frozenset(tags), tuple(of_attribute), tuple(others)


def select(root: Node, selector: str) -> list[Node]:
    """Elements that fit the selector, in document order. Plain tags and missing attributes are settled by look-up."""
    tags, of_attribute, others = _indexed(selector)
    siblings, out = Siblings(), []
    for n in root.elements():
        if n.tag in tags or (n.attrs and any(name in n.attrs and _fits(n, chain, siblings) for name, chain in of_attribute)) or (others and fits_any(n, others, siblings)):
            out.append(n)
    return out
