"""HTML pages to trees by the standard's algorithm: tokens, insertion modes, misnested formatting, foster parents.

Scripting counts as on, as it does for crawlers that read pages like a browser: ``noscript`` holds plain text. Documents
without a doctype are in quirks mode; legacy public identifiers are not looked at.
"""

from __future__ import annotations

import re
from html import unescape

VOID = set("area base br col embed hr img input link meta param source track wbr basefont bgsound frame keygen".split())
_SPECIAL = set(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form "
    "frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext "
    "pre script search section select source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp".split()
)
_FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: A start tag ends an open paragraph; an end tag ends what is open within the element.
_BLOCKS = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul".split())
_CLOSABLE = (_BLOCKS | set("button listing pre".split())) - {"p"}
_IN_HEAD = set("base basefont bgsound link meta noframes script style template title".split())
_RAW_TEXT = set("iframe noembed noframes noscript style xmp".split())
_IMPLIED = set("dd dt li optgroup option p rb rp rt rtc".split())
_ALL_IMPLIED = _IMPLIED | set("caption colgroup tbody td tfoot th thead tr".split())
_SCOPE = set("applet caption html table td th marquee object template".split())
_SCOPES = {"": _SCOPE, "list": _SCOPE | {"ol", "ul"}, "button": _SCOPE | {"button"}, "table": {"html", "table", "template"}}
_TABLE_PARTS = set("caption col colgroup tbody td tfoot th thead tr".split())
_ROW_GROUPS = {"tbody", "tfoot", "thead"}
_FOSTERING = {"table", "tr"} | _ROW_GROUPS
_MARKED = {"applet", "marquee", "object"}
#: Elements of MathML and SVG in which HTML goes on, and tags of HTML that end such content.
_MATH_TEXT, _HTML_IN_SVG = {"mi", "mo", "mn", "ms", "mtext"}, {"foreignobject", "desc", "title"}
_BREAKS_OUT = set(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
_WHITE = "\t\n\f\r "

_NAME = re.compile(r"[^\t\n\f\r />]+")
_ATTRIBUTE = re.compile(r"""[\t\n\f\r /]*([^\t\n\f\r />][^\t\n\f\r />=]*)(?:[\t\n\f\r ]*=[\t\n\f\r ]*(?:"([^"]*)"|'([^']*)'|(?!["'])([^\t\n\f\r >]*)))?""")
_OPEN_VALUE = re.compile(r"""[\t\n\f\r ]*=[\t\n\f\r ]*["']""")
_TAG_END = re.compile(r"[\t\n\f\r /]*>")
_COMMENT_END = re.compile(r"--!?>")
_LETTER = re.compile("[A-Za-z]")
#: In attributes, a name without semicolon stays as it is before a letter, a digit or an equals sign.
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*(?:;|(?!=)))")


def _attribute_value(text: str) -> str:
    return _REFERENCE.sub(lambda m: _named(m[0]), text) if "&" in text else text


def _named(reference: str) -> str:
    plain = unescape(reference)
    if reference[1] == "#" or reference.endswith(";") and plain[-1:] != ";":
        return plain
    return plain if len(plain) == 1 or not plain[-1:].isalnum() else reference  # part of a longer name


class Comment(str):
    """A comment among an element's children."""

    __slots__ = ()


class Node:
    """An element; children are elements, texts and comments. ``space`` is math or svg for what isn't HTML. The contents
    of a template hang below a node called #content, which belongs to no document."""

    __slots__ = ("tag", "attrs", "parent", "children", "space")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, space: str = "") -> None:
        self.tag, self.attrs, self.parent, self.space = tag, attrs, parent, space
        self.children: list[Node | str] = []

    def elements(self):
        """Elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            if node.tag != "#content":
                yield node
                stack.extend(c for c in reversed(node.children) if isinstance(c, Node))


class _Tree:
    """The tree under construction and the rules of the insertion modes."""

    def __init__(self) -> None:
        self.root = Node("#document", {}, None)
        self.open: list[Node] = []
        self.formatting: list[Node | None] = []  # None: a marker
        self.head: Node | None = None
        self.form: Node | None = None
        self.frames_allowed, self.fostering, self.quirks, self.skip_line_feed = True, False, True, False
        self.template_modes: list[str] = []
        self.mode = "initial"
        self.raw: str | None = None  # name of the element whose text the tokenizer reads, or "plaintext"

    # --- nodes ---------------------------------------------------------------------------------------------------------

    def _place(self, target: Node | None = None) -> tuple[Node, int]:
        """Parent and position of what is inserted next."""
        target = target or self.open[-1]
        if self.fostering and target.tag in _FOSTERING and not target.space:
            for k in range(len(self.open) - 1, -1, -1):
                node = self.open[k]
                if node.tag == "template" and not node.space:
                    return node.children[0], len(node.children[0].children)
                if node.tag == "table" and not node.space:
                    if node.parent is not None:
                        return node.parent, next(i for i, c in enumerate(node.parent.children) if c is node)
                    target = self.open[k - 1]
                    break
            else:
                target = self.open[0]
        if target.tag == "template" and not target.space:
            target = target.children[0]
        return target, len(target.children)

    def insert(self, tag: str, attrs: dict[str, str], space: str = "") -> Node:
        parent, at = self._place() if self.open else (self.root, len(self.root.children))
        node = Node(tag, attrs, parent, space)
        parent.children.insert(at, node)
        if tag == "template" and not space:
            node.children.append(Node("#content", {}, node))
        self.open.append(node)
        return node

    def _write(self, data: str) -> None:
        parent, at = self._place()
        siblings = parent.children
        if at and type(siblings[at - 1]) is str:
            siblings[at - 1] += data
        else:
            siblings.insert(at, data)

    @staticmethod
    def _detach(node: Node) -> None:
        if node.parent is not None:
            node.parent.children = [c for c in node.parent.children if c is not node]
            node.parent = None

    def _in_scope(self, tags: set[str], scope: str = "") -> bool:
        stops = _SCOPES[scope]
        for node in reversed(self.open):
            if node.space:
                if scope != "table" and (node.tag in _MATH_TEXT or node.tag in _HTML_IN_SVG or node.tag == "annotation-xml"):
                    return False
            elif node.tag in tags:
                return True
            elif node.tag in stops:
                return False
        return False

    def _is_open(self, tag: str) -> bool:
        return any(n.tag == tag and not n.space for n in self.open)

    def _pop_until(self, tags: set[str]) -> None:
        while self.open:
            node = self.open.pop()
            if node.tag in tags and not node.space:
                return

    def _pop_to(self, tags: set[str]) -> None:
        """Pop until one of the tags, a template or the root is on top."""
        while self.open[-1].tag not in tags and self.open[-1].tag not in ("template", "html"):
            self.open.pop()

    def _imply_ends(self, but: str = "", tags: set[str] = _IMPLIED) -> None:
        while self.open[-1].tag in tags and self.open[-1].tag != but:
            self.open.pop()

    def _close_p(self) -> None:
        if self._in_scope({"p"}, "button"):
            self._imply_ends("p")
            self._pop_until({"p"})

    # --- formatting elements -------------------------------------------------------------------------------------------

    def _remember(self, node: Node) -> None:
        same = []
        for k in range(len(self.formatting) - 1, -1, -1):
            entry = self.formatting[k]
            if entry is None:
                break
            if entry.tag == node.tag and entry.attrs == node.attrs:
                same.append(k)
        if len(same) >= 3:
            del self.formatting[same[-1]]
        self.formatting.append(node)

    def _reopen(self) -> None:
        """Open again the formatting elements that were closed by what they stood in."""
        listed = self.formatting
        if not listed or listed[-1] is None or any(n is listed[-1] for n in self.open):
            return
        k = len(listed) - 1
        while k and listed[k - 1] is not None and not any(n is listed[k - 1] for n in self.open):
            k -= 1
        for k in range(k, len(listed)):
            listed[k] = self.insert(listed[k].tag, dict(listed[k].attrs))

    def _clear_to_marker(self) -> None:
        while self.formatting and self.formatting.pop() is not None:
            pass

    def _index(self, nodes: list, node: Node) -> int:
        return next((k for k, n in enumerate(nodes) if n is node), -1)

    def _end_formatting(self, tag: str) -> None:
        """The end tag of a formatting element: what it can't hold is split off and formatted again inside."""
        if self.open[-1].tag == tag and self._index(self.formatting, self.open[-1]) < 0:
            self.open.pop()
            return
        for _ in range(8):
            element = None
            for entry in reversed(self.formatting):
                if entry is None:
                    break
                if entry.tag == tag:
                    element = entry
                    break
            if element is None:
                self._end_other(tag)
                return
            at = self._index(self.open, element)
            if at < 0:
                self.formatting.remove(element)
                return
            if not self._in_scope({tag}) or not self._reachable(element):
                return
            furthest = next((k for k in range(at + 1, len(self.open)) if self.open[k].tag in _SPECIAL and not self.open[k].space), None)
            if furthest is None:
                del self.open[at:]
                self.formatting.remove(element)
                return
            block, above = self.open[furthest], self.open[at - 1]
            bookmark, last, k, rounds = self._index(self.formatting, element), block, furthest, 0
            while True:
                k, rounds = k - 1, rounds + 1
                node = self.open[k]
                if node is element:
                    break
                listed = self._index(self.formatting, node)
                if listed >= 0 and rounds > 3:
                    del self.formatting[listed]
                    bookmark -= listed < bookmark
                    listed = -1
                if listed < 0:
                    del self.open[k]
                    continue
                copy = Node(node.tag, dict(node.attrs), None)
                self.formatting[listed] = self.open[k] = copy
                if last is block:
                    bookmark = listed + 1
                self._move(last, copy)
                last = copy
            parent, place = self._place_for(above)
            self._detach(last)
            place = min(place, len(parent.children))
            last.parent = parent
            parent.children.insert(place, last)
            copy = Node(element.tag, dict(element.attrs), None)
            copy.children, block.children = block.children, []
            for child in copy.children:
                if isinstance(child, Node):
                    child.parent = copy
            block.children.append(copy)
            copy.parent = block
            old = self._index(self.formatting, element)
            del self.formatting[old]
            self.formatting.insert(bookmark - (old < bookmark), copy)
            del self.open[self._index(self.open, element)]
            self.open.insert(self._index(self.open, block) + 1, copy)

    def _reachable(self, element: Node) -> bool:
        for node in reversed(self.open):
            if node is element:
                return True
            if not node.space and node.tag in _SCOPE:
                return False
        return False

    def _place_for(self, target: Node) -> tuple[Node, int]:
        was, self.fostering = self.fostering, True
        found = self._place(target)
        self.fostering = was
        return found

    def _move(self, node: Node, parent: Node) -> None:
        self._detach(node)
        node.parent = parent
        parent.children.append(node)

    def _end_other(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            node = self.open[k]
            if node.tag == tag and not node.space:
                self._imply_ends(tag)
                del self.open[self._index(self.open, node) :]
                return
            if node.tag in _SPECIAL and not node.space:
                return

    # --- tokens --------------------------------------------------------------------------------------------------------

    def start(self, tag: str, attrs: dict[str, str], closed: bool = False) -> None:
        self.skip_line_feed = False
        if self.open and self.open[-1].space and not self._html_goes_on(tag):
            self._start_foreign(tag, attrs, closed)
        else:
            getattr(self, f"_{self.mode}_start")(tag, attrs, closed)

    def end(self, tag: str) -> None:
        self.skip_line_feed = False
        if self.open and self.open[-1].space:
            self._end_foreign(tag)
        else:
            getattr(self, f"_{self.mode}_end")(tag)

    def text(self, data: str) -> None:
        if self.skip_line_feed:
            self.skip_line_feed = False
            data = data[1:] if data[0] == "\n" else data
        if data:
            if self.open and self.open[-1].space:
                self._write(data.replace("\0", "\ufffd"))
                self.frames_allowed &= not data.strip(_WHITE)
            else:
                getattr(self, f"_{self.mode}_text", self._body_text)(data)

    def comment(self, data: str) -> None:
        self.skip_line_feed = False
        if self.mode == "after_body" and self.open:
            parent = self.open[0]
        elif not self.open or self.mode in ("after_after_body", "after_after_frameset"):
            parent = self.root
        else:
            parent, at = self._place()
            parent.children.insert(at, Comment(data))
            return
        parent.children.append(Comment(data))

    def finish(self) -> Node:
        for _ in range(8):
            if self.mode in ("initial", "before_html", "before_head", "in_head", "after_head"):
                getattr(self, f"_{self.mode}_else")()
        return self.root

    def _again(self, kind: str, *token) -> None:
        """Take a token by the rules of the mode that now holds."""
        getattr(self, f"_{self.mode}_{kind}")(*token)

    # --- before the body -----------------------------------------------------------------------------------------------

    def doctype(self, name: str) -> None:
        if self.mode == "initial":
            self.quirks, self.mode = name.lower() != "html", "before_html"

    def _initial_else(self) -> None:
        self.mode = "before_html"

    def _before_html_else(self) -> None:
        self.insert("html", {})
        self.mode = "before_head"

    def _before_head_else(self) -> None:
        self.head = self.insert("head", {})
        self.mode = "in_head"

    def _in_head_else(self) -> None:
        self.open.pop()
        self.mode = "after_head"

    def _after_head_else(self) -> None:
        self.insert("body", {})
        self.mode = "body"

    def _early_text(self, data: str) -> None:
        data = data.lstrip(_WHITE)
        if data:
            getattr(self, f"_{self.mode}_else")()
            self._again("text", data)

    _initial_text = _before_html_text = _before_head_text = _early_text

    def _head_text(self, data: str) -> None:
        rest = data.lstrip(_WHITE)
        if len(rest) < len(data):
            self._write(data[: len(data) - len(rest)])
        if rest:
            getattr(self, f"_{self.mode}_else")()
            self._again("text", rest)

    _in_head_text = _after_head_text = _head_text

    def _initial_start(self, tag: str, attrs: dict, closed: bool) -> None:
        self.mode = "before_html"
        self._before_html_start(tag, attrs, closed)

    def _before_html_start(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag == "html":
            self.insert(tag, attrs)
            self.mode = "before_head"
        else:
            self._before_html_else()
            self._before_head_start(tag, attrs, closed)

    def _before_head_start(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag == "html":
            self._body_start(tag, attrs, closed)
        elif tag == "head":
            self.head = self.insert(tag, attrs)
            self.mode = "in_head"
        else:
            self._before_head_else()
            self._in_head_start(tag, attrs, closed)

    def _early_end(self, tag: str) -> None:
        if tag in ("head", "body", "html", "br"):
            getattr(self, f"_{self.mode}_else")()
            self._again("end", tag)

    _initial_end = _before_html_end = _before_head_end = _early_end

    def _in_head_start(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag == "html":
            self._body_start(tag, attrs, closed)
        elif tag in ("noscript", "title") or tag in _IN_HEAD:
            self._head_element(tag, attrs)
        elif tag != "head":
            self._in_head_else()
            self._after_head_start(tag, attrs, closed)

    def _head_element(self, tag: str, attrs: dict) -> None:
        self.insert(tag, attrs)
        if tag in VOID:
            self.open.pop()
        elif tag == "template":
            self.formatting.append(None)
            self.frames_allowed = False
            self.mode = "in_template"
            self.template_modes.append("in_template")
        else:
            self.raw = tag

    def _in_head_end(self, tag: str) -> None:
        if tag == "head":
            self._in_head_else()
        elif tag in ("body", "html", "br"):
            self._in_head_else()
            self._after_head_end(tag)
        elif tag == "template":
            self._end_template()

    def _end_template(self) -> None:
        if self._is_open("template"):
            self._imply_ends(tags=_ALL_IMPLIED)
            self._pop_until({"template"})
            self._clear_to_marker()
            self.template_modes.pop()
            self._reset()

    def _after_head_start(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag == "html":
            self._body_start(tag, attrs, closed)
        elif tag == "body":
            self.insert(tag, attrs)
            self.frames_allowed, self.mode = False, "body"
        elif tag == "frameset":
            self.insert(tag, attrs)
            self.mode = "in_frameset"
        elif tag in _IN_HEAD:
            self.open.append(self.head)
            self._head_element(tag, attrs)
            del self.open[self._index(self.open, self.head)]
        elif tag != "head":
            self._after_head_else()
            self._body_start(tag, attrs, closed)

    def _after_head_end(self, tag: str) -> None:
        if tag == "template":
            self._end_template()
        elif tag in ("body", "html", "br"):
            self._after_head_else()
            self._body_end(tag)

    # --- the body ------------------------------------------------------------------------------------------------------

    def _body_text(self, data: str) -> None:
        data = data.replace("\0", "")
        if data:
            self._reopen()
            self._write(data)
            if self.frames_allowed and data.strip(_WHITE):
                self.frames_allowed = False

    def _body_start(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag in _BLOCKS:
            self._close_p()
            self.insert(tag, attrs)
        elif tag in _FORMATTING:
            if tag == "a":
                held = next((e for e in self._since_marker() if e.tag == "a"), None)
                if held is not None:
                    self._end_formatting("a")
                    for nodes in (self.formatting, self.open):
                        if (k := self._index(nodes, held)) >= 0:
                            del nodes[k]
            self._reopen()
            if tag == "nobr" and self._in_scope({"nobr"}):
                self._end_formatting("nobr")
                self._reopen()
            self._remember(self.insert(tag, attrs))
        elif tag in ("li", "dd", "dt"):
            self._start_item({"li"} if tag == "li" else {"dd", "dt"})
            self.insert(tag, attrs)
        elif tag in _HEADINGS:
            self._close_p()
            if self.open[-1].tag in _HEADINGS:
                self.open.pop()
            self.insert(tag, attrs)
        elif tag in _IN_HEAD:
            self._head_element(tag, attrs)
        elif tag == "html" or tag == "body":
            node = self.open[0] if tag == "html" else self.open[1] if len(self.open) > 1 and self.open[1].tag == "body" else None
            if node is not None and not self._is_open("template"):
                node.attrs.update({k: v for k, v in attrs.items() if k not in node.attrs})
                self.frames_allowed &= tag == "html"
        elif tag == "table":
            if not self.quirks:
                self._close_p()
            self.insert(tag, attrs)
            self.frames_allowed, self.mode = False, "in_table"
        elif tag in ("pre", "listing"):
            self._close_p()
            self.insert(tag, attrs)
            self.skip_line_feed, self.frames_allowed = True, False
        elif tag == "form":
            if self.form is None or self._is_open("template"):
                self._close_p()
                node = self.insert(tag, attrs)
                if not self._is_open("template"):
                    self.form = node
        elif tag == "button":
            if self._in_scope({"button"}):
                self._imply_ends()
                self._pop_until({"button"})
            self._reopen()
            self.insert(tag, attrs)
            self.frames_allowed = False
        elif tag in _MARKED:
            self._reopen()
            self.insert(tag, attrs)
            self.formatting.append(None)
            self.frames_allowed = False
        elif tag in ("param", "source", "track"):
            self.insert(tag, attrs)
            self.open.pop()
        elif tag == "hr":
            self._close_p()
            self.insert(tag, attrs)
            self.open.pop()
            self.frames_allowed = False
        elif tag in VOID and tag not in ("col", "frame") or tag == "image":
            self._reopen()
            self.insert("img" if tag == "image" else tag, attrs)
            self.open.pop()
            self.frames_allowed &= tag == "input" and attrs.get("type", "").lower() == "hidden"
        elif tag == "textarea" or tag in _RAW_TEXT:
            if tag == "xmp":
                self._close_p()
                self._reopen()
            self.insert(tag, attrs)
            self.raw, self.skip_line_feed = tag, tag == "textarea"
            self.frames_allowed &= tag in ("noembed", "noscript")
        elif tag == "plaintext":
            self._close_p()
            self.insert(tag, attrs)
            self.raw = tag
        elif tag == "select":
            self._reopen()
            self.insert(tag, attrs)
            self.frames_allowed = False
            self.mode = "in_select_in_table" if self.mode in ("in_table", "in_caption", "in_table_body", "in_row", "in_cell") else "in_select"
        elif tag in ("optgroup", "option"):
            if self.open[-1].tag == "option":
                self.open.pop()
            self._reopen()
            self.insert(tag, attrs)
        elif tag in ("rb", "rtc", "rp", "rt"):
            if self._in_scope({"ruby"}):
                self._imply_ends("rtc" if tag in ("rp", "rt") else "")
            self.insert(tag, attrs)
        elif tag in ("math", "svg"):
            self._reopen()
            self.insert(tag, attrs, tag)
            if closed:
                self.open.pop()
        elif tag == "frameset":
            if self.frames_allowed and len(self.open) > 1 and self.open[1].tag == "body":
                self._detach(self.open[1])
                del self.open[1:]
                self.insert(tag, attrs)
                self.mode = "in_frameset"
        elif tag not in _TABLE_PARTS and tag not in ("frame", "head"):
            self._reopen()
            self.insert(tag, attrs)

    def _since_marker(self):
        for entry in reversed(self.formatting):
            if entry is None:
                return
            yield entry

    def _start_item(self, tags: set[str]) -> None:
        self.frames_allowed = False
        for node in reversed(self.open):
            if node.space:
                break
            if node.tag in tags:
                self._imply_ends(node.tag)
                self._pop_until({node.tag})
                break
            if node.tag in _SPECIAL and node.tag not in ("address", "div", "p"):
                break
        self._close_p()

    def _body_end(self, tag: str) -> None:
        if tag in _CLOSABLE:
            if self._in_scope({tag}):
                self._imply_ends()
                self._pop_until({tag})
        elif tag in _FORMATTING:
            self._end_formatting(tag)
        elif tag == "p":
            if not self._in_scope({"p"}, "button"):
                self.insert("p", {})
            self._close_p()
        elif tag in ("li", "dd", "dt"):
            if self._in_scope({tag}, "list" if tag == "li" else ""):
                self._imply_ends(tag)
                self._pop_until({tag})
        elif tag in _HEADINGS:
            if self._in_scope(_HEADINGS):
                self._imply_ends()
                self._pop_until(_HEADINGS)
        elif tag in ("body", "html"):
            if self._in_scope({"body"}):
                self.mode = "after_body"
                if tag == "html":
                    self._after_body_end(tag)
        elif tag == "form":
            self._end_form()
        elif tag in _MARKED:
            if self._in_scope({tag}):
                self._imply_ends()
                self._pop_until({tag})
                self._clear_to_marker()
        elif tag == "br":
            self._body_start("br", {}, False)
        elif tag == "template":
            self._end_template()
        else:
            self._end_other(tag)

    def _end_form(self) -> None:
        if self._is_open("template"):
            if self._in_scope({"form"}):
                self._imply_ends()
                self._pop_until({"form"})
            return
        node, self.form = self.form, None
        if node is not None and self._index(self.open, node) >= 0 and self._in_scope({"form"}):
            self._imply_ends()
            del self.open[self._index(self.open, node)]

    def _after_body_text(self, data: str) -> None:
        if data.strip(_WHITE):
            self.mode = "body"
        self._body_text(data)

    def _after_body_start(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag != "html":
            self.mode = "body"
        self._body_start(tag, attrs, closed)

    def _after_body_end(self, tag: str) -> None:
        if tag == "html":
            self.mode = "after_after_body"
        else:
            self.mode = "body"
            self._body_end(tag)

    _after_after_body_text, _after_after_body_start = _after_body_text, _after_body_start

    def _after_after_body_end(self, tag: str) -> None:
        self.mode = "body"
        self._body_end(tag)

    # --- tables --------------------------------------------------------------------------------------------------------

    def _table_text(self, data: str) -> None:
        if self.open[-1].tag not in _FOSTERING:
            self._body_text(data)
        elif data.strip(_WHITE + "\0"):
            self._fostered(self._body_text, data)
        elif data := data.replace("\0", ""):
            self._write(data)

    _in_table_text = _in_table_body_text = _in_row_text = _table_text

    def _fostered(self, rule, *token) -> None:
        self.fostering = True
        rule(*token)
        self.fostering = False

    def _in_table_start(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag in _TABLE_PARTS:
            self._pop_to({"table"})
            if tag == "caption":
                self.formatting.append(None)
                self.insert(tag, attrs)
                self.mode = "in_caption"
            elif tag in ("colgroup", "col"):
                self.insert("colgroup", attrs if tag == "colgroup" else {})
                self.mode = "in_column_group"
                if tag == "col":
                    self._in_column_group_start(tag, attrs, closed)
            else:
                self.insert(tag if tag in _ROW_GROUPS else "tbody", attrs if tag in _ROW_GROUPS else {})
                self.mode = "in_table_body"
                if tag not in _ROW_GROUPS:
                    self._in_table_body_start(tag, attrs, closed)
        elif tag == "table":
            if self._in_scope({"table"}, "table"):
                self._pop_until({"table"})
                self._reset()
                self._again("start", tag, attrs, closed)
        elif tag in ("style", "script", "template"):
            self._head_element(tag, attrs)
        elif tag == "input" and attrs.get("type", "").lower() == "hidden":
            self.insert(tag, attrs)
            self.open.pop()
        elif tag == "form":
            if self.form is None and not self._is_open("template"):
                self.form = self.insert(tag, attrs)
                self.open.pop()
        else:
            self._fostered(self._body_start, tag, attrs, closed)

    def _in_table_end(self, tag: str) -> None:
        if tag == "table":
            if self._in_scope({"table"}, "table"):
                self._pop_until({"table"})
                self._reset()
        elif tag == "template":
            self._end_template()
        elif tag not in _TABLE_PARTS and tag not in ("body", "html"):
            self._fostered(self._body_end, tag)

    def _end_caption(self) -> bool:
        if not self._in_scope({"caption"}, "table"):
            return False
        self._imply_ends()
        self._pop_until({"caption"})
        self._clear_to_marker()
        self.mode = "in_table"
        return True

    def _in_caption_start(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag in _TABLE_PARTS or tag == "table":
            if self._end_caption():
                self._in_table_start(tag, attrs, closed)
        else:
            self._body_start(tag, attrs, closed)

    def _in_caption_end(self, tag: str) -> None:
        if tag in ("caption", "table"):
            if self._end_caption() and tag == "table":
                self._in_table_end(tag)
        elif tag not in _TABLE_PARTS and tag not in ("body", "html"):
            self._body_end(tag)

    def _in_column_group_text(self, data: str) -> None:
        rest = data.lstrip(_WHITE)
        if len(rest) < len(data):
            self._write(data[: len(data) - len(rest)])
        if rest and self._end_column_group():
            self._in_table_text(rest)

    def _end_column_group(self) -> bool:
        if self.open[-1].tag != "colgroup":
            return False
        self.open.pop()
        self.mode = "in_table"
        return True

    def _in_column_group_start(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag == "html":
            self._body_start(tag, attrs, closed)
        elif tag == "col":
            self.insert(tag, attrs)
            self.open.pop()
        elif tag == "template":
            self._head_element(tag, attrs)
        elif self._end_column_group():
            self._in_table_start(tag, attrs, closed)

    def _in_column_group_end(self, tag: str) -> None:
        if tag == "template":
            self._end_template()
        elif tag != "col" and self._end_column_group() and tag != "colgroup":
            self._in_table_end(tag)

    def _in_table_body_start(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag in ("tr", "td", "th"):
            self._pop_to(_ROW_GROUPS)
            self.insert("tr", attrs if tag == "tr" else {})
            self.mode = "in_row"
            if tag != "tr":
                self._in_row_start(tag, attrs, closed)
        elif tag in _TABLE_PARTS:
            if self._end_rows():
                self._in_table_start(tag, attrs, closed)
        else:
            self._in_table_start(tag, attrs, closed)

    def _end_rows(self) -> bool:
        if not self._in_scope(_ROW_GROUPS, "table"):
            return False
        self._pop_to(_ROW_GROUPS)
        self.open.pop()
        self.mode = "in_table"
        return True

    def _in_table_body_end(self, tag: str) -> None:
        if tag in _ROW_GROUPS:
            if self._in_scope({tag}, "table"):
                self._end_rows()
        elif tag == "table":
            if self._end_rows():
                self._in_table_end(tag)
        elif tag not in _TABLE_PARTS and tag not in ("body", "html"):
            self._in_table_end(tag)

    def _in_row_start(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag in ("td", "th"):
            self._pop_to({"tr"})
            self.insert(tag, attrs)
            self.mode = "in_cell"
            self.formatting.append(None)
        elif tag in _TABLE_PARTS:
            if self._end_row():
                self._in_table_body_start(tag, attrs, closed)
        else:
            self._in_table_start(tag, attrs, closed)

    def _end_row(self) -> bool:
        if not self._in_scope({"tr"}, "table"):
            return False
        self._pop_to({"tr"})
        self.open.pop()
        self.mode = "in_table_body"
        return True

    def _in_row_end(self, tag: str) -> None:
        if tag == "tr":
            self._end_row()
        elif tag == "table" or tag in _ROW_GROUPS and self._in_scope({tag}, "table"):
            if self._end_row():
                self._in_table_body_end(tag)
        elif tag not in _TABLE_PARTS and tag not in ("body", "html"):
            self._in_table_end(tag)

    def _end_cell(self) -> None:
        self._imply_ends()
        self._pop_until({"td", "th"})
        self._clear_to_marker()
        self.mode = "in_row"

    def _in_cell_start(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag in _TABLE_PARTS:
            if self._in_scope({"td", "th"}, "table"):
                self._end_cell()
                self._in_row_start(tag, attrs, closed)
        else:
            self._body_start(tag, attrs, closed)

    def _in_cell_end(self, tag: str) -> None:
        if tag in ("td", "th"):
            if self._in_scope({tag}, "table"):
                self._imply_ends()
                self._pop_until({tag})
                self._clear_to_marker()
                self.mode = "in_row"
        elif tag in ("table", "tr") or tag in _ROW_GROUPS:
            if self._in_scope({tag}, "table"):
                self._end_cell()
                self._in_row_end(tag)
        elif tag not in ("body", "caption", "col", "colgroup", "html"):
            self._body_end(tag)

    # --- select, template, frames --------------------------------------------------------------------------------------

    def _in_select_text(self, data: str) -> None:
        if data := data.replace("\0", ""):
            self._write(data)

    def _in_select_start(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag == "html":
            self._body_start(tag, attrs, closed)
        elif tag in ("option", "optgroup", "hr"):
            if self.open[-1].tag == "option":
                self.open.pop()
            if tag != "option" and self.open[-1].tag == "optgroup":
                self.open.pop()
            self.insert(tag, attrs)
            if tag == "hr":
                self.open.pop()
        elif tag in ("select", "input", "keygen", "textarea"):
            if self._in_select():
                self._end_select()
                if tag != "select":
                    self._again("start", tag, attrs, closed)
        elif tag in ("script", "template"):
            self._head_element(tag, attrs)

    def _in_select(self) -> bool:
        for node in reversed(self.open):
            if node.tag == "select":
                return True
            if node.tag not in ("optgroup", "option"):
                return False
        return False

    def _end_select(self) -> None:
        self._pop_until({"select"})
        self._reset()

    def _in_select_end(self, tag: str) -> None:
        if tag == "optgroup":
            if len(self.open) > 1 and self.open[-1].tag == "option" and self.open[-2].tag == "optgroup":
                self.open.pop()
            if self.open[-1].tag == "optgroup":
                self.open.pop()
        elif tag == "option":
            if self.open[-1].tag == "option":
                self.open.pop()
        elif tag == "select":
            if self._in_select():
                self._end_select()
        elif tag == "template":
            self._end_template()

    _in_select_in_table_text = _in_select_text

    def _in_select_in_table_start(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag in ("caption", "table", "tr", "td", "th") or tag in _ROW_GROUPS:
            self._end_select()
            self._again("start", tag, attrs, closed)
        else:
            self._in_select_start(tag, attrs, closed)

    def _in_select_in_table_end(self, tag: str) -> None:
        if tag in ("caption", "table", "tr", "td", "th") or tag in _ROW_GROUPS:
            if self._in_scope({tag}, "table"):
                self._end_select()
                self._again("end", tag)
        else:
            self._in_select_end(tag)

    def _in_template_start(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag in _IN_HEAD:
            self._head_element(tag, attrs)
            return
        kinds = {"col": "in_column_group", "tr": "in_table_body", "td": "in_row", "th": "in_row"}
        self.mode = self.template_modes[-1] = kinds.get(tag, "in_table" if tag in _TABLE_PARTS else "body")
        self._again("start", tag, attrs, closed)

    def _in_template_end(self, tag: str) -> None:
        if tag == "template":
            self._end_template()

    def _in_frameset_text(self, data: str) -> None:
        if kept := "".join(c for c in data if c in _WHITE):
            self._write(kept)

    _after_frameset_text = _after_after_frameset_text = _in_frameset_text

    def _in_frameset_start(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag in ("frameset", "frame"):
            self.insert(tag, attrs)
            if tag == "frame":
                self.open.pop()
        else:
            self._after_frameset_start(tag, attrs, closed)

    def _in_frameset_end(self, tag: str) -> None:
        if tag == "frameset" and len(self.open) > 1:
            self.open.pop()
            if self.open[-1].tag != "frameset":
                self.mode = "after_frameset"

    def _after_frameset_start(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag == "html":
            self._body_start(tag, attrs, closed)
        elif tag == "noframes":
            self._head_element(tag, attrs)

    _after_after_frameset_start = _after_frameset_start

    def _after_frameset_end(self, tag: str) -> None:
        if tag == "html":
            self.mode = "after_after_frameset"

    def _after_after_frameset_end(self, tag: str) -> None:
        pass

    def _reset(self) -> None:
        """The mode that the open elements ask for."""
        modes = {"td": "in_cell", "th": "in_cell", "tr": "in_row", "caption": "in_caption", "colgroup": "in_column_group", "table": "in_table", "body": "body", "frameset": "in_frameset", "head": "in_head"}
        for k in range(len(self.open) - 1, -1, -1):
            tag = "" if self.open[k].space else self.open[k].tag
            if tag == "select":
                above = next((n.tag for n in reversed(self.open[:k]) if n.tag in ("table", "template")), "")
                self.mode = "in_select_in_table" if above == "table" else "in_select"
                return
            if tag == "template":
                self.mode = self.template_modes[-1]
                return
            if tag == "html":
                self.mode = "before_head" if self.head is None else "after_head"
                return
            if tag in modes or tag in _ROW_GROUPS:
                self.mode = modes.get(tag, "in_table_body")
                return
        self.mode = "body"

    # --- MathML and SVG ------------------------------------------------------------------------------------------------

    def _html_goes_on(self, tag: str) -> bool:
        at = self.open[-1]
        if at.space == "svg":
            return at.tag in _HTML_IN_SVG
        if at.tag in _MATH_TEXT:
            return tag not in ("mglyph", "malignmark")
        encoding = at.attrs.get("encoding", "").lower()
        return at.tag == "annotation-xml" and (tag == "svg" or encoding in ("text/html", "application/xhtml+xml"))

    def _start_foreign(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag in _BREAKS_OUT or tag == "font" and attrs.keys() & {"color", "face", "size"}:
            while self.open[-1].space and not (self.open[-1].tag in _MATH_TEXT or self.open[-1].tag in _HTML_IN_SVG):
                self.open.pop()
            self._again("start", tag, attrs, closed)
            return
        self.insert(tag, attrs, self.open[-1].space)
        if closed:
            self.open.pop()

    def _end_foreign(self, tag: str) -> None:
        if tag in ("br", "p"):
            while self.open[-1].space and not (self.open[-1].tag in _MATH_TEXT or self.open[-1].tag in _HTML_IN_SVG):
                self.open.pop()
            self._again("end", tag)
            return
        for k in range(len(self.open) - 1, 0, -1):
            if not self.open[k].space:
                self._again("end", tag)
                return
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    # For the texts of elements that hold nothing else: they are written where they are.
    def raw_text(self, data: str) -> None:
        if self.skip_line_feed:
            self.skip_line_feed = False
            data = data[1:] if data[:1] == "\n" else data
        if data:
            self._write(data.replace("\0", "\ufffd"))

    def raw_end(self) -> None:
        self.open.pop()
        self.raw = None


def _script_end(text: str, at: int) -> re.Match | None:
    """Where a script ends: not within a comment in which another script begins."""
    look = re.compile(r"(?i)<!--|-->|<(/?)script(?=[\t\n\f\r />])")
    comment = inner = False
    for m in look.finditer(text, at):
        if m[0] == "<!--":
            comment = True
        elif m[0] == "-->":
            comment = inner = False
        elif not m[1]:
            inner = inner or comment
        elif inner:
            inner = False
        else:
            return m
    return None


_ENDS: dict[str, re.Pattern] = {}


def parse_html(text: str) -> Node:
    """The document's tree: html with head and body, or a frameset."""
    text = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
    tree, at, n, held = _Tree(), 0, len(text), []

    def flush() -> None:
        if held:
            tree.text("".join(held))
            held.clear()

    while at < n:
        if tree.raw:
            name = tree.raw
            if name == "plaintext":
                tree.raw_text(text[at:])
                break
            end = _script_end(text, at) if name == "script" else _ENDS.setdefault(name, re.compile(rf"(?i)</{name}(?=[\t\n\f\r />])")).search(text, at)
            body = text[at : end.start() if end else n]
            tree.raw_text(unescape(body) if name in ("textarea", "title") and "&" in body else body)
            tree.raw_end()
            if end is None:
                break
            at = _attributes(text, end.end())[1]
            if at < 0:
                break
            continue
        mark = text.find("<", at)
        if mark < 0:
            mark = n
        if mark > at:
            part = text[at:mark]
            held.append(unescape(part) if "&" in part else part)
            at = mark
            if at == n:
                break
        nxt = text[at + 1 : at + 2]
        if _LETTER.match(nxt):
            m = _NAME.match(text, at + 1)
            attrs, to, closed = _attributes(text, m.end())
            if to < 0:  # the text ends within a tag
                break
            flush()
            tree.start(m[0].lower().replace("\0", "\ufffd"), attrs, closed)
            at = to
        elif nxt == "/" and at + 2 < n:
            if _LETTER.match(text[at + 2]):
                m = _NAME.match(text, at + 2)
                to = _attributes(text, m.end())[1]
                if to < 0:
                    break
                flush()
                tree.end(m[0].lower())
                at = to
            elif text[at + 2] == ">":
                at += 3
            else:
                at = _bogus(tree, text, at + 2, flush)
        elif nxt == "!":
            if text.startswith("--", at + 2):
                flush()
                if short := re.match("-?>", text[at + 4 : at + 6]):
                    tree.comment("")
                    at += 4 + short.end()
                    continue
                end = _COMMENT_END.search(text, at + 4)
                tree.comment(text[at + 4 : end.start() if end else n])
                at = end.end() if end else n
            elif text[at + 2 : at + 9].lower() == "doctype":
                flush()
                to = text.find(">", at)
                to = n if to < 0 else to
                tree.doctype((text[at + 9 : to].split() or [""])[0])
                at = to + 1
            elif text.startswith("[CDATA[", at + 2) and tree.open and tree.open[-1].space:
                to = text.find("]]>", at)
                held.append(text[at + 9 : to if to >= 0 else n])
                at = to + 3 if to >= 0 else n
            else:
                at = _bogus(tree, text, at + 2, flush)
        elif nxt == "?":
            at = _bogus(tree, text, at + 1, flush)
        else:
            held.append("<")
            at += 1
    flush()
    return tree.finish()


def _bogus(tree: _Tree, text: str, at: int, flush) -> int:
    flush()
    to = text.find(">", at)
    to = len(text) if to < 0 else to
    tree.comment(text[at:to])
    return to + 1


def _attributes(text: str, at: int) -> tuple[dict[str, str], int, bool]:
    """(attributes, place after the tag, whether a slash ends it); the place is -1 where the text ends first."""
    out: dict[str, str] = {}
    while True:
        if end := _TAG_END.match(text, at):
            return out, end.end(), end[0][-2:-1] == "/"
        m = _ATTRIBUTE.match(text, at)
        if not m:
            return out, -1, False
        name = m[1].lower()
        if name not in out:
            value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
            out[name] = _attribute_value(value)
        at = m.end()
        if m[2] is None and m[3] is None and m[4] is None and _OPEN_VALUE.match(text, at):
            return out, -1, False  # a quoted value that never ends
