"""Archives and workbooks as data sources: one input partition per archive member or sheet.

A ZIP file's directory lies at its end, so planning reads a few kilobytes per archive and names the members; every task then opens
the archive by random access and inflates only its own member. Which members or sheets are read is an option and which columns is the schema;
nothing else is inflated or kept. A member whose stated size exceeds ``maxBytes`` stops the read before anything is unpacked.

Paths are files or folders that every executor reaches by the same name, or addresses that ``pyarrow.fs`` can open.
"""
from __future__ import annotations

import fnmatch
import io
import re
import zipfile
from collections.abc import Iterator
from datetime import date, timedelta
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.guards import SourceChanged

MAX_BYTES = 8 * 1024 ** 3
BATCH_ROWS = 50_000


def _located(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+://", path) else (fs.LocalFileSystem(), path)


def _archives(path: str, ending: str) -> list[str]:
    """The file itself, or the files of a folder with that ending in the order of their names."""
    system, inner = _located(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise SourceChanged(f"no such archive: {path}")
    if info.type == fs.FileType.File:
        return [path]
    listed = [i for i in system.get_file_info(fs.FileSelector(inner)) if i.type == fs.FileType.File]
    return sorted(f"{path.rstrip('/')}/{i.base_name}" for i in listed if i.base_name.lower().endswith(ending))


class _Raw(io.RawIOBase):
    """An Arrow file for ``zipfile``, which expects OSError where it looks before the beginning of a short file."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (0, self.file.tell(), self.file.size())[whence]
        if at < 0:
            raise OSError("before the beginning")
        return self.file.seek(at)

    def readinto(self, into) -> int:
        return self.file.readinto(into)


def _opened(path: str) -> zipfile.ZipFile:
    system, inner = _located(path)
    try:
        return zipfile.ZipFile(io.BufferedReader(_Raw(system.open_input_file(inner)), 1 << 20))
    except zipfile.BadZipFile as e:
        raise SourceChanged(f"not an archive: {path}") from e


class Part(InputPartition):
    """One member of one archive; ``label`` is the sheet's name in a workbook."""

    def __init__(self, path: str, member: str, label: str | None = None):
        self.path, self.member, self.label = path, member, label


class _PartReader(DataSourceReader):
    ending = ".zip"

    def __init__(self, schema: StructType, options):
        self.schema, self.path = schema, options["path"]
        self.chosen = options.get("members", "*")
        self.most = int(options.get("maxBytes", MAX_BYTES))

    def parts(self, path: str, z: zipfile.ZipFile) -> Iterator[Part]:
        raise NotImplementedError

    def partitions(self) -> list[Part]:
        found = []
        for path in _archives(self.path, self.ending):
            with _opened(path) as z:
                for p in self.parts(path, z):
                    size = z.getinfo(p.member).file_size
                    if size > self.most:
                        raise SourceChanged(f"{path}: {p.member} states {size} bytes, more than {self.most}")
                    found.append(p)
        return found

    def batch(self, columns: list) -> pa.RecordBatch:
        types = {"string": pa.string(), "int": pa.int32()}
        return pa.RecordBatch.from_arrays([pa.array(c, types[f.dataType.simpleString()], from_pandas=True) for c, f in zip(columns, self.schema)], names=self.schema.names)


class _CsvReader(_PartReader):
    def parts(self, path, z):
        for n in z.namelist():
            if n.lower().endswith(".csv") and fnmatch.fnmatchcase(n, self.chosen):
                yield Part(path, n)

    def read(self, partition):
        if partition is None:           # no member at all
            return
        names = self.schema.names
        with _opened(partition.path) as z, z.open(partition.member) as fh:
            try:
                for rows in pd.read_csv(fh, dtype=str, chunksize=BATCH_ROWS, usecols=lambda c: c in names, encoding="utf-8-sig"):
                    yield self.batch([rows[n] if n in rows else pd.Series([None] * len(rows), dtype=object) for n in names])
            except pd.errors.EmptyDataError:
                return


class ZippedCsv(DataSource):
    """Text rows of the CSV members of ZIP files. The schema (string columns) names the columns; absent ones are null.

    ``members`` is a pattern for member names (``*``), ``maxBytes`` the size a member may state (8 GB).
    """

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def schema(self):
        raise SourceChanged("name the columns to read: .schema('a string, b string')")

    def reader(self, schema):
        return _CsvReader(schema, self.options)


SHEET_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


class _SheetReader(_PartReader):
    ending = ".xlsx"

    def parts(self, path, z):
        target = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{SHEET_NS}sheet"):
            if fnmatch.fnmatchcase(sheet.get("name"), self.chosen):
                part = target[sheet.get(REL)].lstrip("/")
                yield Part(path, part if part.startswith("xl/") else "xl/" + part, sheet.get("name"))

    def _shared(self, z: zipfile.ZipFile) -> list[str]:
        if "xl/sharedStrings.xml" not in z.namelist():
            return []
        if z.getinfo("xl/sharedStrings.xml").file_size > self.most:
            raise SourceChanged(f"shared texts larger than {self.most} bytes")
        out = []
        with z.open("xl/sharedStrings.xml") as fh:
            for _, e in ElementTree.iterparse(fh):
                if e.tag == f"{SHEET_NS}si":
                    out.append("".join(t.text or "" for t in e.iter(f"{SHEET_NS}t")))
                    e.clear()
        return out

    def _date_styles(self, z: zipfile.ZipFile) -> set[int]:
        if "xl/styles.xml" not in z.namelist():
            return set()
        styles = ElementTree.fromstring(z.read("xl/styles.xml"))
        custom = {int(n.get("numFmtId")): n.get("formatCode", "") for n in styles.iter(f"{SHEET_NS}numFmt")}
        formats = [int(xf.get("numFmtId", "0")) for xf in styles.findall(f"{SHEET_NS}cellXfs/{SHEET_NS}xf")]
        return {i for i, f in enumerate(formats) if 14 <= f <= 22 or re.search(r"[dmy]{2,}", custom.get(f, ""), re.I)}

    def _text(self, cell, shared: list[str], dates: set[int]) -> str | None:
        kind, v = cell.get("t", "n"), cell.find(f"{SHEET_NS}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{SHEET_NS}t"))
        if v is None or v.text is None:
            return None
        if kind == "s":
            return shared[int(v.text)]
        if kind == "n" and int(cell.get("s", "0")) in dates:
            return (date(1899, 12, 30) + timedelta(days=int(float(v.text)))).isoformat()
        return v.text

    def read(self, partition):
        if partition is None:
            return
        rows: list[tuple] = []

        def flush():
            given = dict(zip(("row", "col", "text"), zip(*rows))) if rows else {}
            given |= {"path": [partition.path] * len(rows), "sheet": [partition.label] * len(rows)}
            return self.batch([given[n] for n in self.schema.names])

        with _opened(partition.path) as z:
            shared, dates = self._shared(z), self._date_styles(z)
            with z.open(partition.member) as fh:
                for _, e in ElementTree.iterparse(fh):
                    if e.tag == f"{SHEET_NS}c":
                        at, text = re.match(r"([A-Z]+)(\d+)", e.get("r", "")), self._text(e, shared, dates)
                        if at and text is not None:
                            col = 0
                            for ch in at.group(1):
                                col = col * 26 + ord(ch) - 64
                            rows.append((int(at.group(2)), col, text))
                    elif e.tag == f"{SHEET_NS}row":
                        e.clear()
                        if len(rows) >= BATCH_ROWS:
                            yield flush()
                            rows.clear()
        if rows:
            yield flush()


class WorkbookCells(DataSource):
    """Cells of XLSX files; ``members`` is a pattern for sheet names. Part sizes are checked as for archives."""

    @classmethod
    def name(cls) -> str:
        return "workbook_cells"

    def schema(self):
        return "path string, sheet string, row int, col int, text string"

    def reader(self, schema):
        return _SheetReader(schema, self.options)


def source_reader(spark: SparkSession, source: type[DataSource], members: str, max_bytes: int):
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("members", members).option("maxBytes", max_bytes)
