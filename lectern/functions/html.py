"""Table grids of web pages."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SHAPES = "array<struct<rows:int,cols:int>>"
SPANS = (1000, 65534)  # the widest and the highest cell of the HTML standard
_ATTRIBUTES = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+"
#: comments and elements whose content is no markup are passed over whole; then the tags that make tables
_TAGS = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|textarea|title)\b{_ATTRIBUTES}>.*?(?:</\1\b|\Z)|<(/?)(table|thead|tbody|tfoot|tr|td|th)(?![\w-])({_ATTRIBUTES})>",
    re.IGNORECASE | re.DOTALL,
)
_SPAN = re.compile(r"(?<![\w-])(col|row)span\s*=\s*[\"']?\s*(\d+)", re.IGNORECASE)


class _Grid:
    """One open table. `taken` says for each column in how many rows, this one included, a cell from above holds it."""

    def __init__(self):
        self.rows = self.cols = self.at = 0
        self.taken: list[float] = []
        self.in_row = self.in_cell = False

    def row(self) -> None:
        self.rows, self.at, self.in_row, self.in_cell = self.rows + 1, 0, True, False
        self.taken = [max(0, n - 1) for n in self.taken]

    def cell(self, attributes: str) -> None:
        if not self.in_row:
            self.row()
        span = {"col": 1, "row": 1} | {k.lower(): int(n) for k, n in _SPAN.findall(attributes)}
        wide = min(span["col"] or 1, SPANS[0])
        high = min(span["row"], SPANS[1]) or float("inf")  # 0: to the end of its group
        while self.at < len(self.taken) and self.taken[self.at]:
            self.at += 1
        self.taken += [0] * (self.at + wide - len(self.taken))
        for c in range(self.at, self.at + wide):
            self.taken[c] = max(self.taken[c], high)
        self.at += wide
        self.cols, self.in_cell = max(self.cols, self.at), True

    def group(self) -> None:
        """No cell reaches from one row group into another."""
        self.taken, self.in_row, self.in_cell = [], False, False


def table_grids(html: str) -> list[tuple[int, int]]:
    """(rows, cols) of each table, in the order in which they open. A table within a cell is a table of its own; one that
    opens outside a cell ends the table around it. Rows, cells and tables that are not closed end where HTML ends them."""
    found: list[_Grid] = []
    stack: list[_Grid] = []
    for _, close, tag, attributes in _TAGS.findall(html):
        tag = tag.lower()
        if tag == "table":
            if stack and (close or not stack[-1].in_cell):
                stack.pop()
            if not close:
                stack.append(_Grid())
                found.append(stack[-1])
        elif tag and stack:
            top = stack[-1]
            if tag in ("td", "th"):
                if close:
                    top.in_cell = False
                else:
                    top.cell(attributes)
            elif tag == "tr":
                if close:
                    top.in_row = top.in_cell = False
                else:
                    top.row()
            else:
                top.group()
    return [(t.rows, t.cols) for t in found]


def html_table_shapes(html: Column) -> Column:
    """array<struct<rows, cols>> of the tables in a web page; null has none. Pages go to Python in Arrow batches."""

    @F.pandas_udf(SHAPES)
    def shapes(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: [{"rows": r, "cols": c} for r, c in table_grids(page)])

    return shapes(F.coalesce(html, F.lit("")))
