"""Tables of HTML pages as grids of cells."""

from __future__ import annotations

import re
import unicodedata
from collections import deque
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf
from pyspark.sql import functions as F

#: Strings before a table that are kept as its context.
CONTEXT_STRINGS = 80
#: A span beyond this is taken for one: nothing that is printed is so wide.
MOST_SPAN = 1000


def squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text)).strip()


class _Table:
    """One open table: cells go where no earlier cell reaches down to."""

    def __init__(self, context: str):
        self.context, self.rows = context, []
        self.row: dict[int, str] | None = None
        self.down: dict[int, tuple[int, str]] = {}
        self.parts: list[str] | None = None
        self.spans = (1, 1)

    def open_row(self) -> None:
        self.close_row()
        self.row = {c: text for c, (_, text) in self.down.items()}
        self.down = {c: (n - 1, text) for c, (n, text) in self.down.items() if n > 1}

    def open_cell(self, across: int, down: int) -> None:
        self.close_cell()
        if self.row is None:
            self.open_row()
        self.parts, self.spans = [], (across, down)

    def close_cell(self) -> None:
        if self.parts is None:
            return
        text, (across, down) = squeezed(" ".join(self.parts)), self.spans
        self.parts, at = None, 0
        for _ in range(across):
            while at in self.row:
                at += 1
            self.row[at] = text
            if down > 1:
                self.down[at] = (down - 1, text)

    def close_row(self) -> None:
        self.close_cell()
        if self.row and any(self.row.values()):
            self.rows.append([self.row.get(c, "") for c in range(max(self.row) + 1)])
        self.row = None


def _span(value: str | None) -> int:
    return int(value) if value and value.strip().isdigit() and 0 < int(value) <= MOST_SPAN else 1


class _Parser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[_Table] = []
        self.closed: list[tuple[int, _Table]] = []
        self.begun = 0
        self.order: list[int] = []
        self.strings: deque[str] = deque(maxlen=CONTEXT_STRINGS)
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.silent += 1
        elif tag == "table":
            self.open.append(_Table(" ".join(self.strings)))
            self.order.append(self.begun)
            self.begun += 1
            self.strings.clear()
        elif self.open and tag == "tr":
            self.open[-1].open_row()
        elif self.open and tag in ("td", "th"):
            given = dict(attrs)
            self.open[-1].open_cell(_span(given.get("colspan")), _span(given.get("rowspan")))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif self.open and tag in ("td", "th"):
            self.open[-1].close_cell()
        elif self.open and tag == "tr":
            self.open[-1].close_row()
        elif self.open and tag == "table":
            self.end_table()

    def end_table(self) -> None:
        table = self.open.pop()
        table.close_row()
        self.closed.append((self.order.pop(), table))

    def handle_data(self, data: str) -> None:
        text = squeezed(data)
        if not text or self.silent:
            return
        self.strings.append(text)
        for table in self.open:  # a cell holds what tables inside it say
            if table.parts is not None:
                table.parts.append(text)


def grids(html: str) -> list[tuple[int, str, list[list[str]]]]:
    """``(table_no, context, grid)`` in the order tables begin. Cells that span
    columns or rows are repeated; rows without text go. The context is the text
    since the table before began, its last strings."""
    p = _Parser()
    p.feed(html)
    p.close()
    while p.open:
        p.end_table()
    return [(n, t.context, t.rows) for n, t in sorted(p.closed, key=lambda x: x[0])]


@udtf(returnType="table_no int, context string, grid array<array<string>>")
class HtmlGrids:
    """The tables of one page; none of a null page."""

    def eval(self, html: str) -> Iterator[tuple]:
        yield from grids(html or "")


def page_tables(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without its text, a row for each table with ``table_no, context, grid``."""
    return pages.lateralJoin(HtmlGrids(F.col(html_col).outer())).drop(html_col)
