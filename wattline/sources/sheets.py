"""Sheets as a Spark data source: a partition per file, each file's header resolved by itself, cells of several lines, and
broken lines kept apart."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .readers import ORDINAL

#: A cell that is open for more lines is taken as one whose closing quote is missing.
CELL_LINES = 200
#: Rows that a task hands over together.
TOGETHER = 4096
csv.field_size_limit(1 << 27)
_ORDINAL = pa.struct([("file", pa.string()), ("block", pa.int64()), ("line", pa.int64())])
_PLACE = T.StructType([T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("line", T.LongType())])


@dataclass
class Row:
    """A record of a sheet: the number of its first line, its text, and its cells or what is wrong with it."""

    line: int
    text: str
    cells: list[str] | None
    fault: str | None = None


def rows_of(lines: Iterator[str]) -> Iterator[Row]:
    """Records from lines. Quotes that stay open make their first line a broken one; reading goes on with the next."""
    waiting: list[tuple[int, str]] = []
    numbered = enumerate(lines, 1)

    def line() -> tuple[int, str] | None:
        return waiting.pop(0) if waiting else next(numbered, None)

    while (first := line()) is not None:
        held, parsed, fault = [first], [], None
        while True:
            try:
                parsed = list(csv.reader([x for _, x in held], strict=True))
            except csv.Error as e:
                is_open = "unexpected end" in str(e)
                if is_open and len(held) <= CELL_LINES and (more := line()) is not None:
                    held.append(more)
                    continue
                fault = "a quote is not closed" if is_open else str(e)
            break
        if fault or len(parsed) > 1:
            waiting[:0] = held[1:]
            yield Row(first[0], first[1].rstrip("\r\n"), None, fault or "a quote is not closed")
        else:
            yield Row(first[0], "".join(x for _, x in held).rstrip("\r\n"), parsed[0] if parsed else [])


def resolved(header: list[str], candidates: dict[str, list[str]], collapse_ws: bool, file: str) -> dict[str, int]:
    """The place of each field: of the first header in sheet order that it may have. All missing fields in one error."""
    tidy = [re.sub(r"\s+", " ", h.strip()) if collapse_ws else h.strip() for h in header]
    found = {f: next((i for i, h in enumerate(tidy) if h in names), None) for f, names in candidates.items()}
    missing = [f"{f} (one of: {', '.join(candidates[f])})" for f, i in found.items() if i is None]
    if missing:
        raise ValueError(f"{file}: no header for {'; '.join(missing)}. Headers: {', '.join(tidy)}")
    return found


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if local := re.match(r"file:/*(/.*)", path):
        return fs.LocalFileSystem(), local[1]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class SheetFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class SheetReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.header_row = options["path"], int(options.get("header_row", "0"))
        self.candidates: dict[str, list[str]] = json.loads(options["candidates"])
        self.collapse_ws = options.get("collapse_ws", "false").lower() == "true"

    def partitions(self) -> list[SheetFile]:
        files, root = store_of(self.path)
        at = files.get_file_info(root)
        if at.type == fs.FileType.NotFound:
            raise ValueError(f"there is no {self.path}")
        found = [at] if at.is_file else files.get_file_info(fs.FileSelector(root, recursive=True))
        names = sorted(f.path for f in found if f.is_file and f.size and not re.match(r"[._]", f.base_name))
        start = "" if isinstance(files, fs.LocalFileSystem) else self.path[: len(self.path) - len(root)]
        return [SheetFile(start + n) for n in names] or [SheetFile("")]

    def read(self, partition: SheetFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, path = store_of(partition.path)
        with files.open_input_stream(path) as raw:
            rows = rows_of(io.TextIOWrapper(raw, encoding="utf-8-sig", errors="replace", newline=""))
            above = []
            for row in rows:  # titles, then the header; what they hold does not matter
                above.append(row)
                if len(above) > self.header_row:
                    break
            if len(above) <= self.header_row or above[-1].cells is None:
                raise ValueError(f"{partition.path} has no header in line {self.header_row}")
            header = above[-1].cells
            places = resolved(header, self.candidates, self.collapse_ws, partition.path)
            held: list[Row] = []
            for row in rows:
                if row.cells is not None and not any(c.strip() for c in row.cells):
                    continue
                if row.cells is not None and any(c.strip() for c in row.cells[len(header) :]):
                    row = Row(row.line, row.text, None, "more cells than headers")
                held.append(row)
                if len(held) == TOGETHER:
                    yield self.batch(partition.path, held, places)
                    held = []
            if held:
                yield self.batch(partition.path, held, places)

    def batch(self, path: str, rows: list[Row], places: dict[str, int]) -> pa.RecordBatch:
        def cell(row: Row, i: int) -> str | None:
            value = row.cells[i] if row.cells is not None and i < len(row.cells) else ""
            return value if value.strip() else None

        columns = {f: pa.array([cell(r, i) for r in rows], pa.string()) for f, i in places.items()}
        columns[ORDINAL] = pa.array([{"file": path, "block": 0, "line": r.line} for r in rows], _ORDINAL)
        columns["_fault"] = pa.array([r.fault for r in rows], pa.string())
        columns["_text"] = pa.array([r.text if r.fault else None for r in rows], pa.string())
        return pa.RecordBatch.from_pydict(columns)


class SheetSource(DataSource):
    """``spark.read.format("sheet")`` with the options ``candidates`` (JSON: field to headers), ``header_row`` and
    ``collapse_ws``; the path is a file or folder of any store that pyarrow knows by its scheme."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> T.StructType:
        fields = [T.StructField(f, T.StringType()) for f in json.loads(self.options["candidates"])]
        return T.StructType([*fields, T.StructField(ORDINAL, _PLACE), T.StructField("_fault", T.StringType()), T.StructField("_text", T.StringType())])

    def reader(self, schema: T.StructType) -> SheetReader:
        return SheetReader(dict(self.options))


def read_sheets(spark: SparkSession, path: str, candidates: dict[str, list[str]], header_row: int, collapse_ws: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows of all files of a landed tab under their fields' names, as text with ``_ordinal`` (file and line), and the
    broken ones: file, line, message and text. Files may differ in the order and the number of their columns."""
    spark.dataSource.register(SheetSource)
    options = {"candidates": json.dumps(candidates), "header_row": str(header_row), "collapse_ws": str(collapse_ws).lower()}
    rows = spark.read.format("sheet").options(**options).load(path)
    fine = rows.where("_fault is null").drop("_fault", "_text")
    return fine, rows.where("_fault is not null").selectExpr(f"{ORDINAL}.file", f"{ORDINAL}.line", "_fault as message", "_text as text")
