"""Pages as arrays of nodes.

One Arrow job turns ``html`` into ``nodes``: elements and text pieces in document
order.  ``pos`` is the index in the array, ``last`` the index of the last
descendant, so a subtree is a plain slice and every selection after that is a
built-in array expression on the JVM side.
"""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser
from typing import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import once

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(("script", "style", "template"))
PAGES_PER_BATCH = 256
KNOWN_TAGS, LONG_TAG = 20_000, 200  # tags that are kept with what they say, and how long such a tag may be

# Mark-up that can be cut at "<" and ">" with the result of the parser; a page with anything else goes through that.
RAW = frozenset("script style title textarea xmp iframe noembed noframes plaintext".split())
_ATTR = r"""[ \t\r\n\f]+([A-Za-z][A-Za-z0-9_:.\-]*)(?:(=)(?:"([^"<>&]*)"|'([^'<>&]*)'))?"""
_ATTRS = re.compile(_ATTR)
_START = re.compile(rf"([A-Za-z][A-Za-z0-9]*)((?:{_ATTR})*)[ \t\r\n\f]*(/?)")
_END = re.compile(r"/([A-Za-z][A-Za-z0-9]*)[ \t\r\n\f]*")
_ASIDE = re.compile(r"!--(?!-)(?:[^\-]|-(?!-))*--|!(?i:doctype) [A-Za-z0-9 ]*")

NODE = T.StructType([
    T.StructField("pos", T.IntegerType()),
    T.StructField("last", T.IntegerType()),
    T.StructField("parent", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text", T.StringType()),
])


def _attributes(attrs: list) -> tuple[list, list]:
    """Names with values, and the classes among them."""
    values = dict(attrs)
    classes = (values.get("class") or "").split()
    if classes:
        values["class"] = " ".join(classes)
    return [(k, v or "") for k, v in values.items()], classes


def _plain_tag(inner: str) -> tuple | None:
    """("" or "/" or "!", name, attributes, classes) of a tag without its angle brackets; None if it is not plain."""
    start = _START.fullmatch(inner)
    if start is not None:
        attrs = [(name.lower(), (one or other) if given else None) for name, given, one, other in _ATTRS.findall(start[2])]
        tag = start[1].lower()
        if start[7] and tag not in VOID:
            return None
        return "", tag, *_attributes(attrs)
    end = _END.fullmatch(inner)
    if end is not None:
        return "/", end[1].lower(), [], []
    return ("!", "", [], []) if _ASIDE.fullmatch(inner) is not None else None


class _Reader(HTMLParser):
    """Collects nodes column by column; unclosed elements stay open until an ancestor closes."""

    def __init__(self, prune_tags: frozenset, prune_classes: frozenset):
        super().__init__(convert_charrefs=True)
        self._prune_tags, self._prune_classes = prune_tags, prune_classes
        self._known: dict[str, tuple | None] = {}

    def read(self, page: str) -> int:
        """Parse one page into the column lists and return its node count."""
        self._begin()
        if not self._read_plain(page):
            self._begin()
            self.reset()
            self.feed(page)
            self.close()
        self._flush()
        while self._open:
            self._close()
        return len(self.tag)

    def _begin(self) -> None:
        self.tag, self.parent, self.last, self.text, self.attrs = [], [], [], [], []
        self._open: list[tuple[str, int]] = []
        self._hidden = self._silent = 0
        self._data: list[str] = []

    def _read_plain(self, page: str) -> bool:
        """Read a page of plain mark-up without the parser; False, part way, if it holds anything else."""
        known, raw = self._known, None  # the open element whose text is taken as it is
        first, *pieces = page.split("<")
        if first:
            self._data.append(html.unescape(first) if "&" in first else first)
        for piece in pieces:
            unseen = raw in SILENT  # the text of such an element is not kept, whatever it holds
            if unseen and piece[:1] != "/":
                continue
            inner, closed, text = piece.partition(">")
            if not closed:
                return False
            if inner in known:
                told = known[inner]
            else:
                told = _plain_tag(inner)
                if len(inner) <= LONG_TAG:
                    if len(known) >= KNOWN_TAGS:
                        known.clear()
                    known[inner] = told
            if told is None:
                return False
            kind, tag, attrs, classes = told
            if raw is not None and (kind != "/" or tag != raw):
                if unseen and kind == "/":
                    continue
                return False
            raw = None
            if kind == "":
                self._start(tag, attrs, classes)
                if tag in RAW:
                    if tag == "plaintext" or tag not in SILENT and "&" in text:
                        return False
                    raw = tag
            elif kind == "/":
                self.handle_endtag(tag)
            else:
                self._flush()
            if text:
                self._data.append(html.unescape(text) if "&" in text else text)
        return raw is None

    def _add(self, tag: str, attrs: list, text: str | None) -> int:
        pos = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self._open[-1][1] if self._open else -1)
        self.last.append(pos)
        self.text.append(text)
        self.attrs.append(attrs)
        return pos

    def _flush(self) -> None:
        if self._data:
            piece = "".join(self._data).strip()
            self._data.clear()
            if piece and not self._hidden and not self._silent:
                self._add("", [], piece)

    def handle_starttag(self, tag, attrs):
        self._start(tag, *_attributes(attrs))

    def _start(self, tag: str, attrs: list, classes: list) -> None:
        self._flush()
        hidden = tag in self._prune_tags or not self._prune_classes.isdisjoint(classes)
        pos = -1 if hidden or self._hidden else self._add(tag, attrs, None)
        if tag not in VOID:
            self._open.append((tag, pos))
            self._hidden += pos < 0
            self._silent += tag in SILENT

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self) -> str:
        tag, pos = self._open.pop()
        if pos < 0:
            self._hidden -= 1
        else:
            self.last[pos] = len(self.tag) - 1
        self._silent -= tag in SILENT
        return tag

    def handle_endtag(self, tag):
        self._flush()
        if any(name == tag for name, _ in self._open):
            while self._close() != tag:
                pass

    def handle_data(self, data):
        self._data.append(data)

    def updatepos(self, i, j):
        """Line numbers are not wanted; counting them costs time on every tag."""
        return j

    def _boundary(self, _data):
        self._flush()

    handle_comment = handle_decl = handle_pi = unknown_decl = _boundary


def _nodes_of(pages: list[str | None], reader: _Reader) -> pa.Array:
    """Node lists of a batch of pages, built as columns."""
    ends, pos, tag, parent, last, text = [0], [], [], [], [], []
    attr_ends, names, values = [0], [], []
    for page in pages:
        count = reader.read(page or "")
        ends.append(ends[-1] + count)
        pos.extend(range(count))
        tag.extend(reader.tag)
        parent.extend(reader.parent)
        last.extend(reader.last)
        text.extend(reader.text)
        for attrs in reader.attrs:
            for name, value in attrs:
                names.append(name)
                values.append(value)
            attr_ends.append(len(names))
    attrs = pa.MapArray.from_arrays(
        pa.array(attr_ends, pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.string()))
    fields = [pa.array(pos, pa.int32()), pa.array(last, pa.int32()), pa.array(parent, pa.int32()),
              pa.array(tag, pa.string()), attrs, pa.array(text, pa.string())]
    struct = pa.StructArray.from_arrays(fields, names=NODE.fieldNames())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)


def flatten(pages: DataFrame, html_col: str = "html", prune_tags=(), prune_classes=()) -> DataFrame:
    """Replace the page text by its ``nodes``; pruned elements go with all they hold."""
    kept = [c for c in pages.columns if c != html_col]
    tags, classes = frozenset(prune_tags), frozenset(prune_classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(tags, classes)
        for batch in batches:
            # Short slices bound what the node columns of one output batch can hold.
            for start in range(0, batch.num_rows, PAGES_PER_BATCH):
                part = batch.slice(start, PAGES_PER_BATCH)
                nodes = _nodes_of(part.column(html_col).to_pylist(), reader)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [nodes], names=kept + ["nodes"])

    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField("nodes", T.ArrayType(NODE))])
    return pages.select(*kept, html_col).mapInArrow(run, schema)


# --- selections ---------------------------------------------------------------

def attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def has_class(node: Column, name: str) -> Column:
    padded = F.concat(F.lit(" "), F.coalesce(attr(node, "class"), F.lit("")), F.lit(" "))
    return F.contains(padded, F.lit(f" {name} "))


def is_tag(node: Column, *names: str) -> Column:
    return node["tag"].isin(*names) if len(names) > 1 else node["tag"] == names[0]


def holds(outer: Column, inner: Column) -> Column:
    """True when ``inner`` is a proper descendant of ``outer``."""
    return (inner["pos"] > outer["pos"]) & (inner["pos"] <= outer["last"])


def subtree(nodes: Column, node: Column) -> Column:
    def cut(n: Column) -> Column:
        start = n["pos"] - F.get(nodes, F.lit(0))["pos"] + F.lit(1)
        return F.slice(nodes, start, n["last"] - n["pos"] + F.lit(1))

    return once(node, cut)


def find(nodes: Column, test: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(nodes, test), F.lit(0))


def find_last(nodes: Column, test: Callable[[Column], Column]) -> Column:
    return F.try_element_at(F.filter(nodes, test), F.lit(-1))


def text_in(nodes: Column, separator: str = " ") -> Column:
    pieces = F.transform(F.filter(nodes, lambda n: n["tag"] == ""), lambda n: n["text"])
    return F.array_join(pieces, separator)


def text_of(nodes: Column, node: Column, separator: str = " ") -> Column:
    return text_in(subtree(nodes, node), separator)


def ancestor(nodes: Column, node: Column, tag: str) -> Column:
    """Nearest enclosing element of that name."""
    return once(node, lambda inner: find_last(
        nodes, lambda n: is_tag(n, tag) & (n["pos"] < inner["pos"]) & (n["last"] >= inner["pos"])))


def under_class(nodes: Column, node: Column, name: str) -> Column:
    return F.exists(nodes, lambda n: has_class(n, name) & holds(n, node))
