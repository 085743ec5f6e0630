"""Versions of event tables in a shared folder: published at once, read whole or not at all.

A version is data files and, written last and under its final name in one step,
a manifest that names them with their lengths. Readers take the newest manifest
that can be parsed and whose files are all there in full; what a broken write
leaves is never seen. A table may be replaced by days: the new version names
the untouched days' files of the old one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_ALL = "all"


class SnapshotStore:
    """A folder of versions, each a set of named tables and a note of the writer's own."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _list(self, path: str) -> list[tuple[str, int, bool]]:
        where = self._path(path)
        if not self._fs.exists(where):
            return []
        return sorted((s.getPath().getName(), s.getLen(), s.isDirectory()) for s in self._fs.listStatus(where))

    def versions(self) -> list[int]:
        """Numbers of all published versions, oldest first, readable or not."""
        names = (n for n, _, is_dir in self._list(f"{self.root}/manifests") if not is_dir)
        return [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]

    def _manifest(self, version: int) -> dict | None:
        """The version's manifest; None if it is broken or a file of it is missing or cut short."""
        stream = self._fs.open(self._path(f"{self.root}/manifests/{version:012d}.json"))
        try:
            found = json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
            parts = [p for t in found["tables"].values() for p in t["parts"]]
        except (ValueError, KeyError, TypeError, AttributeError):
            return None
        finally:
            stream.close()
        for part in parts:
            there = {n: size for n, size, _ in self._list(f"{self.root}/{part['path']}")}
            if any(there.get(n) != size for n, size in part["files"]):
                return None
        return found

    def latest(self) -> tuple[int, dict] | None:
        """(number, manifest) of the newest version that can be read whole."""
        for version in reversed(self.versions()):
            found = self._manifest(version)
            if found is not None:
                return version, found
        return None

    def note(self) -> dict:
        """What the writer of the latest version noted; empty if there is none."""
        found = self.latest()
        return found[1]["note"] if found else {}

    def read(self, name: str, schema: StructType | str) -> DataFrame:
        """The table in the latest version; an empty one of `schema` if there is no version or it lacks the table."""
        found = self.latest()
        table = found[1]["tables"].get(name) if found else None
        if not table or not table["parts"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(StructType.fromJson(table["schema"])).parquet(*(f"{self.root}/{p['path']}" for p in table["parts"]))

    def write(self, tables: dict[str, DataFrame], note: dict | None = None, by_day: dict[str, str] | None = None, append: tuple[str, ...] = ()) -> int:
        """Publishes a version with the given tables, all others as they were, and returns its number.

        `by_day` names a column of days for tables of which only the days that
        occur are replaced; rows are added to the tables in `append`. Data go first; the manifest is written beside its
        place and renamed, and a number that another writer has taken meanwhile
        is an error.
        """
        before = self.latest()
        kept = dict(before[1]["tables"]) if before else {}
        version = max(self.versions(), default=0) + 1
        for name, df in tables.items():
            path, day = f"data/{uuid.uuid4().hex}", (by_day or {}).get(name)
            out = df.withColumn("_day", F.col(day).cast("date").cast("string")) if day else df
            writer = out.write.partitionBy("_day") if day else out.write
            writer.parquet(f"{self.root}/{path}")
            found = [(n.partition("=")[2], f"{path}/{n}") for n, _, is_dir in self._list(f"{self.root}/{path}") if is_dir and n.startswith("_day=")] if day else [(_ALL, path)]
            parts = [{"day": d, "path": p, "files": [(n, size) for n, size, is_dir in self._list(f"{self.root}/{p}") if not is_dir and n[0] not in "._"]} for d, p in found]
            if day:
                new = {p["day"] for p in parts}
                parts += [p for p in kept.get(name, {"parts": []})["parts"] if p["day"] not in new | {_ALL}]
            if name in append:
                parts += kept.get(name, {"parts": []})["parts"]
            kept[name] = {"schema": df.schema.jsonValue(), "parts": parts}
        text = json.dumps({"version": version, "note": note or {}, "tables": kept}).encode()
        draft, final = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}.json"), self._path(f"{self.root}/manifests/{version:012d}.json")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(text))
        stream.close()
        self._fs.mkdirs(final.getParent())
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"version {version} was published by another writer")
        return version

    def vacuum(self, keep: int = 2) -> None:
        """Removes all but the newest `keep` readable versions, with the files that no kept one names."""
        readable = [(v, m) for v in self.versions() if (m := self._manifest(v)) is not None][-keep:]
        used = {p["path"] for _, m in readable for t in m["tables"].values() for p in t["parts"]}
        for v in self.versions():
            if v not in {x for x, _ in readable} and (not readable or v < readable[-1][0]):
                self._fs.delete(self._path(f"{self.root}/manifests/{v:012d}.json"), False)
        for folder, _, _ in self._list(f"{self.root}/data"):
            inner = [f"data/{folder}/{n}" for n, _, is_dir in self._list(f"{self.root}/data/{folder}") if is_dir and n.startswith("_day=")]
            for path in inner or [f"data/{folder}"]:
                if path not in used:
                    self._fs.delete(self._path(f"{self.root}/{path}"), True)


def read_json_events(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The events of a JSON file that holds an array of objects; no rows of `schema` if the file is missing or broken anywhere."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    whole = spark.read.text(path, wholetext=True)
    kind = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    # A value that is no array of objects, or is cut off, gives null.
    fine = whole.where(F.try_parse_json("value").isNotNull()).select(F.from_json("value", f"array<struct<{kind}>>").alias("v"))
    return fine.select(F.explode("v").alias("e")).where("e is not null").select("e.*")
