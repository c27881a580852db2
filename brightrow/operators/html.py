"""Text, tables and selected elements of HTML held in a table column.

Parsing is per page and runs in Arrow batches inside the tasks; the pages stay
spread as Spark read them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from brightrow.columns import ref

# Elements whose text is not shown, and elements without an end tag.
HIDDEN = frozenset({"script", "style", "template", "rt", "rp"})
VOID = frozenset(
    {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
)


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden.append(tag)

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA["):
            self.handle_data(data[6:])


def page_text(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    return "".join(parser.parts)


@F.pandas_udf(T.StringType())
def visible_text(pages: pd.Series) -> pd.Series:
    """Text content of markup: tags dropped, entities decoded, hidden elements left out."""
    return pages.map(page_text, na_action="ignore")


class _Elements(HTMLParser):
    """Collects the text of elements that match one of several simple selectors."""

    def __init__(self, selectors: Sequence[str]):
        super().__init__(convert_charrefs=True)
        self.wanted = [[_simple(part) for part in s.split()] for s in selectors]
        self.stack: list[tuple[str, dict]] = []
        self.open: list[tuple[int, int, int]] = []  # selector, depth, place in found
        self.found: list[tuple[int, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        self.stack.append((tag, dict(attrs)))
        for i, parts in enumerate(self.wanted):
            if _matches(parts, self.stack):
                self.open.append((i, len(self.stack), len(self.found)))
                self.found.append((i, []))
        if tag in VOID:
            self._close(len(self.stack) - 1)

    def handle_endtag(self, tag):
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] == tag:
                self._close(depth)
                break

    def _close(self, depth):
        del self.stack[depth:]
        self.open = [o for o in self.open if o[1] <= depth]

    def handle_data(self, data):
        for _, _, place in self.open:
            self.found[place][1].append(data)


def _simple(part: str) -> tuple[str, str, frozenset]:
    found = re.fullmatch(r"([\w-]*)(?:#([\w-]+))?((?:\.[\w-]+)*)", part)
    if not found or not part:
        raise ValueError(f"selector part {part!r} is not a tag, .class or #id")
    return found.group(1).lower(), found.group(2) or "", frozenset(filter(None, found.group(3).split(".")))


def _matches(parts, stack) -> bool:
    def fits(part, element):
        tag, ident, classes = part
        attrs = element[1]
        return (
            tag in ("", element[0])
            and ident in ("", attrs.get("id"))
            and classes <= set((attrs.get("class") or "").split())
        )

    if not fits(parts[-1], stack[-1]):
        return False
    above = iter(reversed(stack[:-1]))
    return all(any(fits(part, element) for element in above) for part in reversed(parts[:-1]))


def html_select(df: DataFrame, html_col: str, key: str, selectors: Sequence[str]) -> DataFrame:
    """Rows (key, selector, position, text): stripped text of every matching element.

    Selectors combine tag, ``.class`` and ``#id``, with spaces for descendants.
    """
    for s in selectors:
        [_simple(part) for part in s.split()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, html in zip(batch["key"], batch["html"]):
                parser = _Elements(selectors)
                parser.feed(html or "")
                parser.close()
                seen = [0] * len(selectors)
                for i, parts in parser.found:
                    rows.append((k, selectors[i], seen[i], "".join(parts).strip()))
                    seen[i] += 1
            yield pd.DataFrame(rows, columns=["key", "selector", "position", "text"])

    kind = df.schema[key].dataType.simpleString()
    pages = df.select(ref(key).alias("key"), ref(html_col).alias("html"))
    out = pages.mapInPandas(run, f"key {kind}, selector string, position int, text string")
    return out.withColumnRenamed("key", key)


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[tuple[bool, list[str]]]] = []
        self.nesting: list[int] = []
        self.cell: list[str] | None = None
        self.header = False

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self._end_cell()
            self.nesting.append(len(self.tables))
            self.tables.append([])
        elif self.nesting and tag == "tr":
            self._end_cell()
            self.tables[self.nesting[-1]].append((False, []))
        elif self.nesting and tag in ("td", "th") and self.tables[self.nesting[-1]]:
            self._end_cell()
            self.cell, self.header = [], tag == "th"

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._end_cell()
        if tag == "table" and self.nesting:
            self.nesting.pop()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def _end_cell(self):
        if self.cell is not None:
            rows = self.tables[self.nesting[-1]]
            head, cells = rows[-1]
            text = " ".join("".join(self.cell).split())
            rows[-1] = (self.header and (head or not cells), [*cells, text])
            self.cell = None


def html_tables(df: DataFrame, html_col: str, key: str) -> DataFrame:
    """Rows (key, table_index, row_index, header, cells); a first row of ``th`` cells is the header."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, html in zip(batch["key"], batch["html"]):
                parser = _Tables()
                parser.feed(html or "")
                parser.close()
                for t, rows in enumerate(parser.tables):
                    header = rows[0][1] if rows and rows[0][0] else None
                    body = rows[1:] if header is not None else rows
                    out += [(k, t, i, header, cells) for i, (_, cells) in enumerate(body)]
            yield pd.DataFrame(out, columns=["key", "table_index", "row_index", "header", "cells"])

    kind = df.schema[key].dataType.simpleString()
    pages = df.select(ref(key).alias("key"), ref(html_col).alias("html"))
    schema = f"key {kind}, table_index int, row_index int, header array<string>, cells array<string>"
    return pages.mapInPandas(run, schema).withColumnRenamed("key", key)


def table_columns(tables: DataFrame, header: Sequence[str], key: str) -> DataFrame:
    """The tables with one given header as typed-as-text columns."""
    same = tables.where(F.col("header") == F.array(*[F.lit(h) for h in header]))
    cells = [F.get("cells", F.lit(i)).alias(h) for i, h in enumerate(header)]
    return same.select(ref(key), F.col("table_index").alias("__table_index"), "row_index", *cells)
