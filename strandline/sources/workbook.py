"""SpreadsheetML workbooks as a data source whose partitions are ranges of rows of a sheet.

Planning reads the file once as a stream and keeps nothing but where ranges begin, in bytes and in row numbers; each task then
reads its own bytes. Names are taken without their prefix, so any prefix of the namespace will do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from xml.parsers import expat

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK = 1 << 16
ROWS = 5000


@dataclass
class RowRange(InputPartition):
    """Rows of ``sheet`` from ``first_row`` (numbered from 0) in the bytes from ``start`` to ``end``."""

    sheet: str
    first_row: int
    start: int
    end: int
    encoding: str | None


def _local(name: str) -> str:
    return name.rpartition(":")[2]


def _attributes(attrs: dict[str, str]) -> dict[str, str]:
    return {_local(k): v for k, v in attrs.items()}


def _whole(text: str | None, least: int) -> int | None:
    text = (text or "").strip()
    return int(text) if text.isdigit() and int(text) >= least else None


def opened(path: str):
    """A file of any store that the path names: local ones may come as a plain path or as ``file:``."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    store, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(inside)


def plan(path: str, rows: int = ROWS, sheet: str | None = None) -> list[RowRange]:
    """Ranges of ``rows`` rows of every sheet, or of ``sheet``; a row that names its place moves those after it."""
    found: list[RowRange] = []
    at = {"sheet": None, "sheets": 0, "next": 0, "in_range": 0, "depth": 0}
    parser = expat.ParserCreate()
    encoding: list[str | None] = [None]

    def close(end: int) -> None:
        if found and found[-1].end < 0:
            found[-1].end = end

    def start(name: str, attrs: dict[str, str]) -> None:
        kind = _local(name)
        if kind == "Worksheet":
            at["sheets"] += 1
            at["sheet"], at["next"], at["in_range"] = _attributes(attrs).get("Name", f"Sheet{at['sheets']}"), 0, 0
        elif kind == "Table" and at["sheet"] is not None:
            at["next"] = at["in_range"] = 0
        elif kind == "Row" and at["sheet"] is not None:
            named = _whole(_attributes(attrs).get("Index"), 1)
            number = at["next"] if named is None else named - 1
            if at["in_range"] % rows == 0:
                close(parser.CurrentByteIndex)
                found.append(RowRange(at["sheet"], number, parser.CurrentByteIndex, -1, encoding[0]))
            at["next"], at["in_range"] = number + 1, at["in_range"] + 1

    def end(name: str) -> None:
        if _local(name) in ("Table", "Worksheet"):
            close(parser.CurrentByteIndex)
            at["sheet"] = None if _local(name) == "Worksheet" else at["sheet"]

    parser.XmlDeclHandler = lambda version, kind, standalone: encoding.__setitem__(0, kind)
    parser.StartElementHandler, parser.EndElementHandler = start, end
    with opened(path) as f:
        while data := f.read(CHUNK):
            parser.Parse(data, False)
        parser.Parse(b"", True)
    return [r for r in found if sheet is None or r.sheet == sheet]


def rows_of(data: bytes, part: RowRange) -> Iterator[tuple[str, int, list[str | None], list[str | None]]]:
    """(sheet, row number, cells, types) of the rows in ``data``; places that no cell fills, and cells without data, are null."""
    out: list[tuple[str, int, list[str | None], list[str | None]]] = []
    at = {"row": part.first_row - 1, "first": True, "cell": -1, "next": 0, "data": 0, "kind": None}
    text: list[str] = []

    def start(name: str, attrs: dict[str, str]) -> None:
        kind, own = _local(name), _attributes(attrs)
        if kind == "Row":
            named = _whole(own.get("Index"), 1)
            at["row"], at["next"] = at["row"] + 1 if named is None else named - 1, 0
            out.append((part.sheet, at["row"], [], []))
        elif kind == "Cell" and out:
            named = _whole(own.get("Index"), 1)
            at["cell"] = at["next"] if named is None else named - 1
            at["next"] = at["cell"] + 1 + (_whole(own.get("MergeAcross"), 1) or 0)
            for column in out[-1][2:]:
                column.extend([None] * (at["next"] - len(column)))
        elif kind == "Data" and at["cell"] >= 0:
            if not at["data"]:
                at["kind"] = own.get("Type", "String")
                text.clear()
            at["data"] += 1

    def end(name: str) -> None:
        kind = _local(name)
        if kind == "Data" and at["data"]:
            at["data"] -= 1
            if not at["data"]:
                out[-1][2][at["cell"]], out[-1][3][at["cell"]] = "".join(text), at["kind"]
        elif kind == "Cell":
            at["cell"] = -1

    parser = expat.ParserCreate(part.encoding)
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda piece: text.append(piece) if at["data"] else None
    name = part.encoding or "utf-8"
    marked = name.lower() in ("utf-16", "utf16")
    wrap = lambda s: s.encode("utf-16-le" if marked else name)
    for piece in (b"\xff\xfe" if marked else b"", wrap("<rows>"), data, wrap("</rows>")):
        parser.Parse(piece, False)
        yield from out[:-1]
        del out[:-1]
    parser.Parse(b"", True)
    yield from out


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("a workbook needs a path")
        self.path, self.sheet, self.rows = options["path"], options.get("sheet"), int(options.get("rowsPerPartition", ROWS))

    def partitions(self) -> list[RowRange]:
        return plan(self.path, self.rows, self.sheet)

    def read(self, partition: RowRange) -> Iterator[tuple]:
        if partition is None:  # no rows at all
            return
        with opened(self.path) as f:
            f.seek(partition.start)
            data = f.read(partition.end - partition.start)
        yield from rows_of(data, partition)


class WorkbookSource(DataSource):
    """``workbook``: rows of a SpreadsheetML file. Options: path, sheet (all if not given), rowsPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "sheet string, row_no int, cells array<string>, kinds array<string>"

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options)
