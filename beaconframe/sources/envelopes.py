"""Landed snapshots of {columns, rows} as a Spark data source with filters that are decided while a file is read.

Register `EnvelopeSource` once in a session, then
`spark.read.format("envelopes").schema("id string, n long").load(folder)`. The
schema names the columns that are wanted, so only those are taken from the rows;
each file is a partition of its own; comparisons with constants are pushed down
(with spark.sql.python.filterPushdown.enabled) and dropped rows never become
Spark's. Order, group and limit are DataFrame operations on it.
"""

from __future__ import annotations

import codecs
import json
import operator
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructType

_COMPARED = {EqualTo: operator.eq, EqualNullSafe: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
_TEXTS = {StringContains: lambda a, b: b in a, StringStartsWith: str.startswith, StringEndsWith: str.endswith}

_ERROR = "Error:"


def _cell(value, kind):
    """A cell as the column's type; null where it can't be one."""
    if value is None or value == "":
        return None
    try:
        if isinstance(kind, StringType):
            return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
        if isinstance(kind, (LongType, IntegerType)):
            return int(value)
        if isinstance(kind, DoubleType):
            return float(value)
        if isinstance(kind, BooleanType):
            return value if isinstance(value, bool) else {"true": True, "false": False}.get(str(value).lower())
    except (TypeError, ValueError):
        return None
    raise TypeError(f"envelopes have no columns of {kind.simpleString()}")


def _keeps(f: Filter):
    """The filter as a function of a row's dictionary, with nulls as in SQL's WHERE; None if it can't be decided here."""
    if isinstance(f, Not):
        inner, column = _keeps(f.child), getattr(f.child, "attribute", (None,))
        return None if inner is None or len(column) != 1 else lambda r: (isinstance(f.child, (IsNull, IsNotNull, EqualNullSafe)) or r[column[0]] is not None) and not inner(r)
    if not hasattr(f, "attribute") or len(f.attribute) != 1:
        return None
    c = f.attribute[0]
    if isinstance(f, IsNull):
        return lambda r: r[c] is None
    if isinstance(f, IsNotNull):
        return lambda r: r[c] is not None
    if isinstance(f, In):
        return lambda r: r[c] is not None and r[c] in f.value
    if type(f) in _TEXTS:
        return lambda r: r[c] is not None and _TEXTS[type(f)](r[c], f.value)
    if isinstance(f, EqualNullSafe):
        return lambda r: r[c] == f.value
    if type(f) in _COMPARED:
        return lambda r: r[c] is not None and _COMPARED[type(f)](r[c], f.value)
    return None


#: Bytes of a file that are read at a time; more only while one envelope is not whole.
PIECE = 1 << 20


def _envelopes(stream, path: str) -> Iterator[dict]:
    """The envelopes of a file one after the other: a task holds one of them and PIECE bytes, not the file."""
    utf8, decoder, text, piece, start = codecs.getincrementaldecoder("utf-8")(), json.JSONDecoder(), "", PIECE, True
    while True:
        more = stream.read(piece)
        text = (text + utf8.decode(more, not more)).lstrip()
        if start and (len(text) >= len(_ERROR) or not more):
            start = False
            if text.startswith(_ERROR):
                raise ValueError(f"{path}: {(text + utf8.decode(stream.read(), True))[len(_ERROR):].strip()}")
        at = 0
        while not start and at < len(text):
            try:
                told, at = decoder.raw_decode(text, at)
            except json.JSONDecodeError:
                if not more:
                    raise
                break
            yield told
            while at < len(text) and text[at].isspace():
                at += 1
        if not more:
            return
        # An envelope that is not whole is tried again when it is twice as long, so a long one is read in proportion to its length.
        piece, text = PIECE if at else 2 * piece, text[at:]


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class EnvelopeReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.filters = path, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        known = {x.name for x in self.schema.fields}
        for f in filters:
            child = f.child if isinstance(f, Not) else f
            if _keeps(f) is not None and getattr(child, "attribute", (None,))[0] in known:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            return []
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        return [_File(i.path) for i in sorted(found, key=lambda i: i.path) if i.is_file and i.base_name[0] not in "._"]

    def read(self, partition: _File | None) -> Iterator[tuple]:
        if partition is None:  # Spark's way to read no partition at all
            return
        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        with system.open_input_stream(partition.path) as stream:
            for told in _envelopes(stream, partition.path):
                yield from self._rows(told)

    def _rows(self, told: dict) -> Iterator[tuple]:
        place = {c: i for i, c in enumerate(told.get("columns") or [])}
        fields = [(x.name, x.dataType, place.get(x.name)) for x in self.schema.fields]
        keeps = [_keeps(f) for f in self.filters]
        for row in told.get("rows") or []:
            cells = {name: _cell(row[i], kind) if i is not None and i < len(row) else None for name, kind, i in fields}
            if all(k(cells) for k in keeps):
                yield tuple(cells.values())


class EnvelopeSource(DataSource):
    """A folder, or one file, of snapshots {"columns": [...], "rows": [[...]]}, one or more to a file; a missing folder is empty, an error text or broken JSON is an error."""

    @classmethod
    def name(cls) -> str:
        return "envelopes"

    def schema(self) -> str:
        raise ValueError("name the wanted columns with .schema(...)")

    def reader(self, schema: StructType) -> EnvelopeReader:
        return EnvelopeReader(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    """Makes the format known in the session and lets Spark push filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EnvelopeSource)
