"""Tables out of HTML pages.

A page becomes an array of tables in one Arrow-batched call; choosing a table
and reading its cells are plain column expressions, so no page is shuffled.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import as_col

TABLES = T.ArrayType(
    T.StructType(
        [
            T.StructField("header", T.ArrayType(T.StringType())),
            T.StructField("cells", T.ArrayType(T.ArrayType(T.StringType()))),
            T.StructField("headings", T.ArrayType(T.StringType())),
        ]
    )
)
_ARROW = pa.list_(
    pa.struct(
        [
            ("header", pa.list_(pa.string())),
            ("cells", pa.list_(pa.list_(pa.string()))),
            ("headings", pa.list_(pa.string())),
        ]
    )
)


class _Cells(HTMLParser):
    """Every table in order of appearance: rows of (is_heading, text, columns, rows), and None between its sections."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self._open = [], []
        self._skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self._skip += 1
        elif tag == "table":
            self.tables.append([])
            self._open.append({"rows": self.tables[-1], "cell": None})
        elif self._open and tag in ("thead", "tbody", "tfoot"):
            self._close_cell()
            self._open[-1]["rows"].append(None)
        elif self._open and tag == "tr":
            self._close_cell()
            self._open[-1]["rows"].append([])
        elif self._open and tag in ("td", "th"):
            self._close_cell()
            spans = dict(attrs)
            self._open[-1]["cell"] = (tag == "th", [], min(max(1, self._span(spans.get("colspan"))), 1000), self._span(spans.get("rowspan")))
        elif self._open and tag == "br" and self._open[-1]["cell"]:
            self._open[-1]["cell"][1].append(" ")

    @staticmethod
    def _span(value) -> int:
        return int(value) if value and value.isascii() and value.isdigit() and len(value) < 10 else 1

    def _close_cell(self):
        table = self._open[-1]
        if table["cell"]:
            heading, parts, columns, rows = table["cell"]
            if not table["rows"] or table["rows"][-1] is None:
                table["rows"].append([])
            table["rows"][-1].append((heading, " ".join("".join(parts).split()), columns, rows))
            table["cell"] = None

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self._skip = max(0, self._skip - 1)
        elif self._open and tag in ("td", "th", "tr"):
            self._close_cell()
        elif self._open and tag == "table":
            self._close_cell()
            self._open.pop()

    def handle_data(self, data):
        if self._open and self._open[-1]["cell"] and not self._skip:
            self._open[-1]["cell"][1].append(data)


def _grid(rows: list) -> list[list[tuple[bool, str | None]]]:
    """Rows of (is_heading, text) with spanned cells repeated; a span ends with its section, 0 reaches that far."""
    out, open_ = [], {}  # by column: rows still to fill, and the cell
    for row in rows:
        if row is None:
            open_.clear()
            continue
        line, below = [], {}
        for heading, text, columns, span in row:
            while len(line) in open_:
                line.append(open_[len(line)][1])
            for _ in range(columns):
                if span != 1:
                    below[len(line)] = (span - 1 if span else -1, (heading, text))
                line.append((heading, text))
        for column in range(len(line), max(open_, default=-1) + 1):
            line.append(open_[column][1] if column in open_ else (False, None))
        open_ = {c: (n - 1, x) for c, (n, x) in open_.items() if n != 1} | below
        out.append(line)
    return out


def _tables_of(page: str | None) -> list[dict] | None:
    if page is None:
        return None
    parser = _Cells()
    parser.feed(page)
    parser.close()
    out = []
    for rows in parser.tables:
        rows = [r for r in _grid(rows) if r]
        width = max(map(len, rows), default=0)
        texts = [[text for _, text in r] + [None] * (width - len(r)) for r in rows]
        out.append(
            {
                "header": texts[0] if texts else [],
                "cells": texts[1:],
                "headings": [text for r in rows for heading, text in r if heading and text is not None],
            }
        )
    return out


def _parse(pages: pa.Array) -> pa.Array:
    """All tables of a page; ragged rows are filled with NULL, the first row is the header."""
    return pa.array([_tables_of(p) for p in pages.to_pylist()], type=_ARROW)


# Catalyst copies deterministic calls into filters; this one must run once per page.
html_tables = F.arrow_udf(_parse, TABLES).asNondeterministic()


def first_table(tables: Column | str) -> Column:
    return F.try_element_at(as_col(tables), F.lit(1))


def pick_table(tables: Column | str, words: str) -> Column:
    """The first table with a heading that matches, ignoring case; NULL if none does."""
    hits = F.filter(as_col(tables), lambda t: F.exists(t["headings"], lambda h: h.rlike(f"(?i){words}")))
    return F.try_element_at(hits, F.lit(1))


def with_clean_header(table: Column | str) -> Column:
    """The same table under snake-case header names."""
    def clean(h: Column) -> Column:
        return F.regexp_replace(F.lower(F.regexp_replace(h, "[^0-9A-Za-z]+", "_")), "^_+|_+$", "")

    t = as_col(table)
    return F.when(t.isNotNull(), t.withField("header", F.transform(t["header"], clean)))


def cell(header: Column | str, row: Column | str, name: str) -> Column:
    """The cell of a row array under a named header; NULL if there is none."""
    return F.get(as_col(row), F.nullif(F.array_position(as_col(header), F.lit(name)), F.lit(0)).cast("int") - 1)


def table_rows(df: DataFrame, table: str, columns: dict[str, str], row_no: str = "row_no") -> DataFrame:
    """One row per body row of a table: its 1-based number and the cells, as header to output name."""
    kept = [c for c in df.columns if c != table]
    parts = df.select(*kept, F.col(f"{table}.header").alias("_header"), F.col(f"{table}.cells").alias("_cells"))
    # The outer form keeps Catalyst from evaluating the array once more in a filter.
    rows = parts.select(*kept, "_header", F.posexplode_outer("_cells").alias("_pos", "_row"))
    return rows.where(F.col("_pos").isNotNull()).select(
        *kept, (F.col("_pos") + 1).alias(row_no), *[cell("_header", "_row", h).alias(n) for h, n in columns.items()]
    )
