"""Tables in pages of HTML, as rows."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame


class _Tables(HTMLParser):
    """Collects (table, row, cells) of a page, tables counted in the order in which they start. A table inside a cell
    is a table of its own; cells and rows that aren't closed end where the next begins."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, int, list[str]]] = []
        self.tables, self.open, self.silent = 0, [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.silent += 1
        elif tag == "table":
            self.open.append({"table": self.tables, "row": 0, "cells": None, "cell": None})
            self.tables += 1
        elif self.open and tag == "tr":
            self._end_row()
            self.open[-1]["cells"] = []
        elif self.open and tag in ("td", "th"):
            self._end_cell()
            t = self.open[-1]
            t["cells"] = [] if t["cells"] is None else t["cells"]
            t["cell"] = []
        elif self.open and tag == "br" and self.open[-1]["cell"] is not None:
            self.open[-1]["cell"].append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif self.open and tag in ("td", "th"):
            self._end_cell()
        elif self.open and tag == "tr":
            self._end_row()
        elif self.open and tag == "table":
            self._end_row()
            self.open.pop()

    def handle_data(self, data):
        if self.open and not self.silent and self.open[-1]["cell"] is not None:
            self.open[-1]["cell"].append(data)

    def close(self):
        super().close()
        while self.open:
            self._end_row()
            self.open.pop()

    def _end_cell(self) -> None:
        t = self.open[-1]
        if t["cell"] is not None:
            t["cells"].append(" ".join("".join(t["cell"]).split()))
            t["cell"] = None

    def _end_row(self) -> None:
        self._end_cell()
        t = self.open[-1]
        if t["cells"]:
            self.rows.append((t["table"], t["row"], t["cells"]))
            t["row"] += 1
        t["cells"] = None


def table_rows(page: str | None) -> list[tuple[int, int, list[str]]]:
    """(table, row, cells) of a page; of a null or empty one none."""
    if not page:
        return []
    parser = _Tables()
    parser.feed(page)
    parser.close()
    return sorted(parser.rows, key=lambda r: r[:2])


def html_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table, row, cells) of every row with cells in every table of each page; pages are saved ones, nothing is
    fetched. In Arrow batches, since no built-in function reads HTML."""
    import pandas as pd

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *r) for k, page in zip(b["_key"], b["_html"], strict=True) for r in table_rows(page)]
            yield pd.DataFrame(rows, columns=["_key", "table", "row", "cells"])

    kind = pages.schema[key].dataType.simpleString()
    given = pages.selectExpr(f"`{key}` AS _key", f"CAST(`{html}` AS string) AS _html")
    return given.mapInPandas(read, f"_key {kind}, table int, row int, cells array<string>").withColumnRenamed("_key", key)


def named_cells(rows: DataFrame, table: int, columns: dict[str, str], key: str) -> DataFrame:
    """The rows below the first of one table, with a column for each name in ``columns``, found by its heading in the
    page's first row; null where a page has no such heading or a row no such cell."""
    from pyspark.sql import functions as F

    own = rows.filter(F.col("table") == table)
    head = own.filter("row = 0").select(F.col(key).alias("_k"), F.col("cells").alias("_head"))
    body = own.filter("row > 0").join(head, F.col(key).eqNullSafe(F.col("_k")))
    cell = lambda heading: F.try_element_at("cells", F.nullif(F.array_position("_head", F.lit(heading)), F.lit(0)).cast("int"))
    return body.select(key, "row", *[cell(h).alias(n) for n, h in columns.items()])
