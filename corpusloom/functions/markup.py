"""Selector rules over HTML, one Arrow-batched pass per page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset(("script", "style"))
#: Pages whose records are held as objects at once.
PAGES = 64

_BLOCKS = (
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul"
).split()
_CELLS = ("caption", "html", "table", "td", "th", "button", "object", "template")
#: By start tag: the open elements it ends, and the elements beyond which it ends none (the rules of HTML).
IMPLIED = {
    **{tag: ((("p",), _CELLS),) for tag in _BLOCKS},
    "li": ((("li",), ("ul", "ol", "menu", "dir")), (("p",), _CELLS)),
    "dt": ((("dt", "dd"), ("dl",)), (("p",), _CELLS)),
    "dd": ((("dt", "dd"), ("dl",)), (("p",), _CELLS)),
    "td": ((("td", "th"), ("tr", "table")),),
    "th": ((("td", "th"), ("tr", "table")),),
    "tr": ((("tr",), ("table",)),),
    **{tag: ((("thead", "tbody", "tfoot"), ("table",)),) for tag in ("thead", "tbody", "tfoot")},
    "option": ((("option",), ("select", "datalist")),),
    "optgroup": ((("option",), ("select",)), (("optgroup",), ("select",))),
}
SIMPLE = re.compile(r"""(?P<tag>[\w*-]+)?(?P<marks>(?:[.#][\w-]+)*)(?:\[(?P<attr>[\w-]+)(?P<op>\$?=)["'](?P<val>[^"']*)["']\])?$""")


@dataclass(frozen=True)
class Rule:
    """Values of one field: ``take`` is ``text`` (whole text of an element), ``own``
    (its direct text pieces) or ``@name`` (an attribute). ``anywhere`` looks at the
    page and not only inside the scope element."""

    field: str
    selector: str
    take: str = "text"
    anywhere: bool = False


def _parse(selector: str) -> list[list[tuple]]:
    """Alternatives (``a, b``) of parts; a part says whether it is a child (``a > b``) of the one before."""
    alternatives = []
    for one in re.split(r",(?![^\[]*\])", selector):
        parts, child = [], False
        for piece in re.sub(r">(?![^\[]*\])", " > ", one).split():
            if piece == ">":
                child = True
                continue
            m = SIMPLE.match(piece)
            if not m:
                raise ValueError(f"unsupported selector {piece!r}")
            marks = re.findall(r"[.#][\w-]+", m["marks"] or "")
            parts.append((m["tag"] or "*", marks, m["attr"], m["op"], m["val"], child))
            child = False
        if not parts or child:
            raise ValueError(f"unsupported selector {one!r}")
        alternatives.append(parts)
    return alternatives


def _fits(part: tuple, element: tuple) -> bool:
    tag, marks, attr, op, val, _ = part
    name, attrs = element
    if tag not in ("*", name):
        return False
    classes = (attrs.get("class") or "").split()
    if any((m[1:] not in classes) if m[0] == "." else (attrs.get("id") != m[1:]) for m in marks):
        return False
    if attr is None:
        return True
    have = attrs.get(attr)
    return have is not None and (have == val if op == "=" else have.endswith(val))


def _ends(parts: list[tuple], path: list[tuple]) -> bool:
    """True when the last element of ``path`` fits the last part, and its ancestors the parts before."""
    if not parts:
        return True
    if not path or not _fits(parts[-1], path[-1]):
        return False
    if parts[-1][-1] or len(parts) == 1:
        return _ends(parts[:-1], path[:-1])
    return any(_ends(parts[:-1], path[:i]) for i in range(len(path) - 1, 0, -1))


def _selects(alternatives: list[list[tuple]], path: list[tuple]) -> bool:
    return any(_ends(parts, path) for parts in alternatives)


class _Collector(HTMLParser):
    """Feeds every record the values its rules select while the page streams by."""

    def __init__(self, scope: list[list[tuple]] | None, rules: list[tuple[Rule, list[list[tuple]]]]):
        super().__init__(convert_charrefs=True)
        self.scope, self.rules = scope, rules
        self.path: list[tuple] = []
        self.records: list[dict] = []
        self.live: list[tuple[int, dict]] = []
        self.page: dict = {r.field: [] for r, _ in rules}
        self.whole: list[tuple[int, list, list]] = []
        self.own: list[tuple[int, list]] = []
        if scope is None:
            self._open_record(0)

    def _open_record(self, depth: int) -> None:
        record = {r.field: [] for r, _ in self.rules}
        self.records.append(record)
        self.live.append((depth, record))

    def _take(self, rule: Rule, values: list, attrs: dict) -> None:
        depth = len(self.path)
        if rule.take.startswith("@"):
            if attrs.get(rule.take[1:]) is not None:
                values.append(attrs[rule.take[1:]])
        elif rule.take == "own":
            self.own.append((depth, values))
        else:
            slot = len(values)
            values.append("")
            self.whole.append((depth, values, [slot]))

    def _imply_ends(self, tag: str) -> None:
        """Closes what the start of ``tag`` ends though its own end tag is left out."""
        for closed, limits in IMPLIED.get(tag, ()):
            for depth in range(len(self.path) - 1, -1, -1):
                if self.path[depth][0] in closed:
                    self._close(depth)
                    break
                if self.path[depth][0] in limits:
                    break

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        self._imply_ends(tag)
        self.path.append((tag, attrs))
        if self.scope and _selects(self.scope, self.path):
            self._open_record(len(self.path) - 1)
        for rule, parts in self.rules:
            if rule.anywhere:
                if _selects(parts, self.path):
                    self._take(rule, self.page[rule.field], attrs)
                continue
            for depth, record in self.live:
                if _selects(parts, self.path[depth:]):
                    self._take(rule, record[rule.field], attrs)
        if tag in VOID:
            self._close(len(self.path) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(len(self.path) - 1)

    def handle_endtag(self, tag):
        for depth in range(len(self.path) - 1, -1, -1):
            if self.path[depth][0] == tag:
                self._close(depth)
                break

    def _close(self, depth: int) -> None:
        del self.path[depth:]
        self.live = [x for x in self.live if x[0] < depth or self.scope is None]
        self.own = [x for x in self.own if x[0] <= depth]
        for opened, values, pieces in self.whole:
            if opened > depth:
                values[pieces[0]] = "".join(pieces[1:])
        self.whole = [x for x in self.whole if x[0] <= depth]

    def handle_data(self, data):
        if self.path and self.path[-1][0] in SILENT:
            return
        for _, _, pieces in self.whole:
            pieces.append(data)
        for depth, values in self.own:
            if depth == len(self.path):
                values.append(data)

    def finish(self, html: str) -> list[dict]:
        self.feed(html)
        self.close()
        self._close(0)
        for record in self.records:
            for rule, _ in self.rules:
                if rule.anywhere:
                    record[rule.field] = self.page[rule.field]
        return self.records


def extract_records(html: Column, rules: list[Rule], scope: str | None = None) -> Column:
    """Array of records, one per ``scope`` element (one per page without a scope).

    Each field is the array of all values its rule selects, in page order. All rules
    of a page share the one pass. Pages are parsed and returned a few at a time, however many come in a batch.
    """
    parsed = [(rule, _parse(rule.selector)) for rule in rules]
    scope_parts = _parse(scope) if scope else None
    record = T.StructType([T.StructField(r.field, T.ArrayType(T.StringType())) for r in rules])

    lists = pa.list_(pa.struct([(r.field, pa.list_(pa.string())) for r in rules]))

    @F.arrow_udf(T.ArrayType(record))
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for first_page in range(0, len(batch), PAGES):
                pages = batch.slice(first_page, PAGES)
                yield pa.array([None if p is None else _Collector(scope_parts, parsed).finish(p) for p in pages.to_pylist()], lists)

    return extract(html)


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in SILENT

    def handle_endtag(self, tag):
        if tag in SILENT and self.silent:
            self.silent -= 1

    def handle_data(self, data):
        if not self.silent:
            self.pieces.append(data)


def html_to_text(html: Column) -> Column:
    """Text of a page or fragment: tags, comments, scripts and styles gone, entities decoded."""

    @F.pandas_udf(T.StringType())
    def text(pages: pd.Series) -> pd.Series:
        def one(page):
            if page is None:
                return None
            parser = _Text()
            parser.feed(page)
            parser.close()
            return "".join(parser.pieces)

        return pages.map(one)

    return text(html)


def first(values: Column) -> Column:
    """First selected value, or NULL."""
    return F.try_element_at(values, F.lit(1))
