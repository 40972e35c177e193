"""Tree construction by the standard's own examples and public vectors; selectors with pseudo-classes."""

import pytest

from silkweb.functions.html import extract_text, parse_html, select
from silkweb.functions.htmltree import Comment, Node
from silkweb.functions.selectors import SelectorError


def dump(node):
    """tag{attributes}(children), texts quoted, comments in angle brackets."""
    out = []
    for c in node.children:
        if isinstance(c, Comment):
            out.append(f"<{c}>")
        elif isinstance(c, str):
            out.append(repr(c))
        else:
            inner = dump(c.children[0] if c.tag == "template" and not c.space else c)
            attrs = "{" + ",".join(f"{k}={v}" for k, v in sorted(c.attrs.items())) + "}" if c.attrs else ""
            out.append((c.space + " " if c.space else "") + c.tag + attrs + (f"({inner})" if inner else ""))
    return " ".join(out)


def body(text):
    html = next(c for c in parse_html(text).children if isinstance(c, Node))
    return dump(next(c for c in html.children if isinstance(c, Node) and c.tag == "body"))


@pytest.mark.parametrize(
    "page, want",
    [
        ("Test", "'Test'"),
        ("<p>One<p>Two", "p('One') p('Two')"),
        ("a<br>b</br>c", "'a' br 'b' br 'c'"),
        ("<b><p></b>TEST", "b p(b 'TEST')"),
        ("<p id=a><b><p id=b></b>TEST", "p{id=a}(b) p{id=b}('TEST')"),
        ("<p>1<b>2<i>3</b>4</i>5</p>", "p('1' b('2' i('3')) i('4') '5')"),
        ("<b>1<p>2</b>3</p>", "b('1') p(b('2') '3')"),
        ("<a><p>X<a>Y</a>Z</p></a>", "a p(a('X') a('Y') 'Z')"),
        ("<b><button>foo</b>bar", "b button(b('foo') 'bar')"),
        ("<font><p>hello<b>cruel</font>world", "font p(font('hello' b('cruel')) b('world'))"),
        ("<DIV> abc <B> def <I> ghi <P> jkl </B> mno </I> pqr </P> stu", "div(' abc ' b(' def ' i(' ghi ')) i p(i(b(' jkl ') ' mno ') ' pqr ') ' stu')"),
        ("<nobr>1<nobr>2", "nobr('1') nobr('2')"),
        ("<b><b><b><b>x</b></b></b></b>y", "b(b(b(b('x')))) 'y'"),
        ("<p><b><b><b><b><p>x", "p(b(b(b(b)))) p(b(b(b('x'))))"),
        ("<li>a<ul><li>b</ul><li>c", "li('a' ul(li('b'))) li('c')"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "dl(dt('a') dd('b') dt('c'))"),
        ("<h1>a<h2>b</h1>c", "h1('a') h2('b') 'c'"),
        ("<body></p>x", "p 'x'"),
        ("<div></p>x</div>", "div(p 'x')"),
        ("<form>a<form>b</form>c", "form('ab') 'c'"),
        ("<pre>\n\nfoo</pre>", "pre('\\nfoo')"),
        ("<ruby>a<rb>b<rt>c<rp>d", "ruby('a' rb('b') rt('c') rp('d'))"),
        ("<object><b>x</object>y", "object(b('x')) 'y'"),
        # tables
        ("<table><b><tr><td>aaa</td></tr>bbb</table>ccc", "b b('bbb') table(tbody(tr(td('aaa')))) b('ccc')"),
        ('<a href="blah">aba<table><a href="foo">br<tr><td></td></tr>x</table>aoe', "a{href=blah}('aba' a{href=foo}('br') a{href=foo}('x') table(tbody(tr(td)))) a{href=foo}('aoe')"),
        ("<table><tr><tr><td><td><span><th><span>X</table>", "table(tbody(tr tr(td td(span) th(span('X')))))"),
        ("<table>x <td> y", "'x ' table(tbody(tr(td(' y'))))"),
        ("<table> <tr> <td>1</table>2", "table(' ' tbody(tr(' ' td('1')))) '2'"),
        ("<table><col><caption>c</caption><tbody><td>a<tfoot><td>b", "table(colgroup(col) caption('c') tbody(tr(td('a'))) tfoot(tr(td('b'))))"),
        ("<table><td><table><td>x</table>y</table>z", "table(tbody(tr(td(table(tbody(tr(td('x')))) 'y')))) 'z'"),
        ("<table><form><input type=hidden><input></table>", "input table(form input{type=hidden})"),
        ("<p><table></table>", "p(table)"),
        ("<!doctype html><p><table></table>", "p table"),
        ("<div><table><div>a</div></table>b</div>", "div(div('a') table 'b')"),
        # select
        ("<select><option>A<select><option>B</select>", "select(option('A')) option('B')"),
        ("<select><optgroup><option>a<optgroup><option>b<div>c</select>d", "select(optgroup(option('a')) optgroup(option('bc'))) 'd'"),
        ("<table><tr><td><select><option>x<td>y", "table(tbody(tr(td(select(option('x'))) td('y'))))"),
        # texts of elements that hold nothing else
        ("<textarea><b>x</b></textarea>y", "textarea('<b>x</b>') 'y'"),
        ("<textarea>\n&lt;</textareax></TEXTAREA >y", "textarea('<</textareax>') 'y'"),
        ("<body><script>a<b></script >c", "script('a<b>') 'c'"),
        ("<body><script><!--<script></script></script>c", "script('<!--<script></script>') 'c'"),
        ("<body><noscript><p>x</noscript>y", "noscript('<p>x') 'y'"),
        ("<xmp><b>x</xmp>", "xmp('<b>x')"),
        ("<plaintext><b>x</plaintext>", "plaintext('<b>x</plaintext>')"),
        # tokens
        ("&lt;&amp&notit;&notin;&#65;&#x42", "'<&\xacit;\u2209AB'"),
        ("<a href='?a=1&copy=2&amp;b&lt'>", "a{href=?a=1&copy=2&b<}"),
        ("<a b=1 B=2 c='x>y' d=it's e>z", "a{b=1,c=x>y,d=it's,e=}('z')"),
        ("a<b x='y", "'a'"),
        ("a < b <3 </ c></>d", "'a < b <3 ' < c> 'd'"),
        ("x<!--a--!>y<!-->z<!--q", "'x' <a> 'y' <> 'z' <q>"),
        ("x<?php y?><!z>", "'x' <?php y?> <z>"),
        ("a\0b\r\nc\rd", "'ab\\nc\\nd'"),
        # SVG and MathML
        ("<svg><title><p>x</p></title><path/></svg>y", "svg svg(svg title(p('x')) svg path) 'y'"),
        ("<svg><g>a<p>b", "svg svg(svg g('a')) p('b')"),
        ("<svg><![CDATA[a<b]]></svg>", "svg svg('a<b')"),
        ("<math><mi><b>x</b></mi></math>", "math math(math mi(b('x')))"),
        # template
        ("<body><template><tr><td>x</template>y", "template(tr(td('x'))) 'y'"),
        # after the body
        ("<body>a</body> b", "'a b'"),
        ("<body>a</body></html><p>b", "'a' p('b')"),
        ("<body x=1><body x=2 y=3>", ""),
    ],
)
def test_trees(page, want):
    assert body(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("", "html(head body)"),
        ("<title>a&amp;b</title><meta>c", "html(head(title('a&b') meta) body('c'))"),
        ("<!-- x --><html a=b><head></head> <script>s</script>y", "< x > html{a=b}(head(script('s')) ' ' body('y'))"),
        ("<frameset><frame></frameset>x", "html(head frameset(frame))"),
        ("<body></body><!-- x --></html><!-- y -->", "html(head body < x >) < y >"),
        ("<html><body x=1><body x=2 y=3>", "html(head body{x=1,y=3})"),
    ],
)
def test_documents(page, want):
    assert dump(parse_html(page)) == want


PAGE = parse_html(
    """<ul id=u><li class=a>one<li class="a b">two<!-- c --><li><b>three</b><li lang=EN>four</ul>
    <div><p>x</p><span></span><p>y <i>z</i></p></div><form><input type=Checkbox checked><input disabled></form>"""
)


@pytest.mark.parametrize(
    "selector, want",
    [
        ("li:first-child", ["one"]),
        ("li:last-child", ["four"]),
        ("li:nth-child(2)", ["two"]),
        ("li:nth-child(odd)", ["one", "three"]),
        ("li:nth-child(2n)", ["two", "four"]),
        ("li:nth-child(-n + 2)", ["one", "two"]),
        ("li:nth-last-child(1)", ["four"]),
        ("li:nth-child(1 of .b)", ["two"]),
        ("li:not(.a)", ["three", "four"]),
        ("li:not(.b, :has(b))", ["one", "four"]),
        ("li:has(> b)", ["three"]),
        ("li:has(+ li > b)", ["two"]),
        ("li:has(~ .b)", ["one"]),
        (":is(li.b, p:nth-of-type(2))", ["two", "y z"]),
        ("p:first-of-type", ["x"]),
        ("p:last-of-type i", ["z"]),
        ("i:only-child", ["z"]),
        ("span:empty", [""]),
        ("li:contains('hre')", ["three"]),
        ('li:icontains("TW")', ["two"]),
        ("#u > li + .b", ["two"]),
        ("li ~ li:not([lang])", ["two", "three"]),
        ("[lang=en]", ["four"]),
        ("li[class!=a]:not(:has(*))", ["two", "four"]),
        ("input:checked, input:disabled", ["", ""]),
        ("input[type=checkbox]", [""]),
        ("div > p:nth-child(3) , li:nth-child(4)", ["four", "y z"]),
    ],
)
def test_selectors(selector, want):
    from silkweb.functions.selectors import text_below

    assert [text_below(n) for n in select(PAGE, selector)] == want


@pytest.mark.parametrize("selector", ["", "a,,b", ":nope", "a:nth-child(x)", "a > > b", "a >", "[x", ":not(", "a:hover(b)", "p:nth-of-type(1 of b)"])
def test_selectors_that_are_refused(selector):
    with pytest.raises(SelectorError):
        select(PAGE, selector)


def test_text_of_faulty_pages():
    assert extract_text("<textarea><b>x</b></textarea>") == "<b>x</b>"
    assert extract_text("<table>a<tr><td>b</table>c") == "a b c"
    assert extract_text("<template>a</template>b<p>c", ["p:first-of-type"]) == "b"
    assert extract_text("<ul><li>a<li>b<li>c</ul>", ["li:not(:first-child)"], root="ul") == "a"
    assert extract_text("<b>" * 3000 + "x<p>y" + "</b>" * 3000) == "x y"
