"""Tables inside HTML pages, as a job over a column of pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Tables(HTMLParser):
    """Rows of cell texts, a list a table; tables may nest."""

    def __init__(self) -> None:
        super().__init__()
        self.done: list[list[list[str]]] = []
        self.open: list[list[list[str]]] = []
        self.cell: list[str] | None = None
        self.outer: list[list[str] | None] = []  # the cells that hold the open tables

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.outer.append(self.cell)
            self.cell = None
            self.open.append([])
        elif self.open and tag == "tr":
            self.open[-1].append([])
        elif self.open and tag in ("td", "th"):
            self._close_cell()
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            self._close_cell()
        if tag == "table" and self.open:
            self._close_table()

    def close(self) -> None:
        """The end of the page ends what is open, the innermost first."""
        super().close()
        while self.open:
            self._close_cell()
            self._close_table()

    def _close_table(self) -> None:
        self.done.append([r for r in self.open.pop() if r])
        self.cell = self.outer.pop()

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)

    def _close_cell(self) -> None:
        if self.cell is not None and self.open:
            if not self.open[-1]:
                self.open[-1].append([])
            self.open[-1][-1].append(" ".join("".join(self.cell).split()))
        self.cell = None


def html_tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, table_idx, row_idx, cells) of every table, in any letter case and also where
    its end is missing; null pages have none."""
    source = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).filter(F.col("html").rlike("(?i)<table"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tables, rows, cells = [], [], [], []
            for i, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = _Tables()
                p.feed(html)
                p.close()
                for t, table in enumerate(p.done):
                    for r, row in enumerate(table):
                        ids.append(i), tables.append(t), rows.append(r), cells.append(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, b.column(0).type), pa.array(tables, pa.int32()), pa.array(rows, pa.int32()), pa.array(cells, pa.list_(pa.string()))],
                names=["id", "table_idx", "row_idx", "cells"],
            )

    return source.mapInArrow(run, f"id {kind}, table_idx int, row_idx int, cells array<string>").withColumnRenamed("id", id_col)


def largest_table(tables: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The rows of each page's table with the most rows, the first of equals."""
    size = tables.groupBy(id_col, "table_idx").count()
    best = size.groupBy(id_col).agg(F.max_by("table_idx", F.struct("count", -F.col("table_idx"))).alias("table_idx"))
    return tables.join(best, [id_col, "table_idx"], "left_semi")
