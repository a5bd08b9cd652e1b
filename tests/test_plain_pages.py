"""Pages of plain mark-up are cut without the parser, with its result."""

import random
from html.parser import HTMLParser

from offerloom.operators import dom


class Parsed(dom._Reader):
    def _read_plain(self, page):
        return False


def nodes(reader, page):
    reader.read(page)
    return reader.tag, reader.parent, reader.last, reader.text, [list(a) for a in reader.attrs]


def test_plain_page_needs_no_parser(monkeypatch):
    def feed(self, data):
        raise AssertionError("the parser was asked")

    monkeypatch.setattr(HTMLParser, "feed", feed)
    page = '<!DOCTYPE html><title>T</title><script>if (a<b && c) x="</p>";</script><ul class="a  b"><li>One &amp; two<br/><li><a href="/x">y</a></ul><!-- c -->z'
    tags, parents, _, texts, attrs = nodes(dom._Reader(frozenset(), frozenset()), page)
    assert tags == ["title", "", "script", "ul", "li", "", "br", "li", "a", "", ""]
    assert [t for t in texts if t] == ["T", "One & two", "y", "z"]
    assert parents[3:6] == [-1, 3, 4] and attrs[3] == [("class", "a b")] and attrs[8] == [("href", "/x")]


def test_reader_equals_parser():
    pieces = ["<div>", "</div>", "<p class='a  b'>", "</p>", '<a href="q?a=1&amp;b">', "</a>", "x", "&amp;", "&copy", "<br/>", "<!-- c -->", "<!-->", "<!-- > -->",
              "<!--a--b-->", "<!DOCTYPE html>", "<script>", "</script>", "<SCRIPT>", "</script x>", "a<b", "<style>", "</style>", "<title>", "</title>", "<textarea>",
              "</textarea>", "<nav>", "</nav>", "</", "<", ">", "<p", "<p a=1>", '<p a="1"b="2">', '<P A="1" a="2" class="">', '<p a="x>y">', "<?pi x>", "</>", "<plaintext>", "<a:b>", "\x00"]
    dice = random.Random(3)
    for tags, classes in (((), ()), (("nav", "style"), ("a",))):
        reader, parser = dom._Reader(frozenset(tags), frozenset(classes)), Parsed(frozenset(tags), frozenset(classes))
        for _ in range(20_000):
            page = "".join(dice.choices(pieces, k=dice.randint(1, 12)))
            assert nodes(reader, page) == nodes(parser, page), page
