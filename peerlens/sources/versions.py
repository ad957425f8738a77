"""Versions of stored tables: data first, then a manifest, which readers go by.

A manifest is one small JSON file, `_manifests/<version>.json` under the root:
for each table the folders that make it up. It is written under another name and
renamed, and the highest version counts, so a reader sees either the whole old
state or the whole new one. A job that dies before that leaves folders nobody
reads; `drop_old_versions` removes them with the old ones.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MANIFESTS = "_manifests"


@dataclass(frozen=True)
class Manifest:
    """version 0 is the state before the first publication. tables: name -> {part: folder below the root}; schemas: name -> JSON."""

    version: int = 0
    tables: dict[str, dict[str, str]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _numbers(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n[:-5]) for n in _names(spark, f"{root}/{MANIFESTS}") if n.endswith(".json") and n[:-5].isdigit())


def current(spark: SparkSession, root: str, version: int | None = None) -> Manifest:
    """The newest manifest under `root`, or that of a version."""
    numbers = _numbers(spark, root)
    if version is None and not numbers:
        return Manifest()
    if version is not None and version not in numbers:
        raise ValueError(f"no version {version} under {root}")
    fs, p = _fs(spark, f"{root}/{MANIFESTS}/{numbers[-1] if version is None else version}.json")
    stream = fs.open(p)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Manifest(**json.loads(text))


def fresh_folder(name: str) -> str:
    """A folder for new files of a table, below the root."""
    return f"data/{name}/{uuid.uuid4().hex}"


def commit(spark: SparkSession, root: str, manifest: Manifest) -> None:
    """Make `manifest` the current one. Raises if another writer has published that version meanwhile."""
    fs, made = _fs(spark, f"{root}/{MANIFESTS}/.{manifest.version}-{uuid.uuid4().hex}")
    stream = fs.create(made, True)
    try:
        stream.write(bytearray(json.dumps({"version": manifest.version, "tables": manifest.tables, "schemas": manifest.schemas}).encode()))
    finally:
        stream.close()
    _, final = _fs(spark, f"{root}/{MANIFESTS}/{manifest.version}.json")
    if fs.exists(final) or not fs.rename(made, final):
        fs.delete(made, False)
        raise ValueError(f"version {manifest.version} of {root} has been published already")


def read_table(spark: SparkSession, root: str, name: str, parts: list[str] | None = None, version: int | None = None, manifest: Manifest | None = None) -> DataFrame:
    """A table as its manifest has it; with `parts`, only their folders are opened. A table without folders is empty, with its schema."""
    found = manifest or current(spark, root, version)
    if name not in found.schemas:
        raise ValueError(f"{root} has no table {name}")
    schema = StructType.fromJson(json.loads(found.schemas[name]))
    folders = [f for p, f in sorted(found.tables[name].items()) if parts is None or p in parts]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/{f}" for f in dict.fromkeys(folders)])


def holds(spark: SparkSession, root: str, name: str) -> bool:
    return name in current(spark, root).schemas


class Draft:
    """The next version of the tables under a root: changes are written as they come, and count once `commit` is called."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.base = current(spark, root)
        self.tables = {name: dict(parts) for name, parts in self.base.tables.items()}
        self.schemas = dict(self.base.schemas)

    def put(self, name: str, rows: DataFrame, by: str | None = None, only: list[str] | None = None, options: dict | None = None) -> None:
        """Write `rows` as the table `name`, or as its parts `only`: those are replaced, or go where `rows` has none; the files of others stay.

        `by` is the column of the part's name; it is no column of the table.
        """
        place = fresh_folder(name)
        writer = rows.write.options(**(options or {}))
        (writer.partitionBy(by) if by else writer).parquet(f"{self.root}/{place}")
        kept = {p: f for p, f in self.tables.get(name, {}).items() if only is not None and p not in only}
        if by is None:
            kept[""] = place
        else:
            plain = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
            for folder in _names(self.spark, f"{self.root}/{place}"):
                if folder.startswith(f"{by}="):
                    kept[plain(folder[len(by) + 1 :])] = f"{place}/{folder}"
        self.tables[name] = kept
        self.schemas[name] = rows.drop(*([by] if by else [])).schema.json()

    def add(self, name: str, rows: DataFrame, part: str, options: dict | None = None) -> None:
        """Write `rows` as one more part of the table `name`; its other parts stay."""
        if part in self.tables.get(name, {}):
            raise ValueError(f"table {name} has a part {part} already")
        place = fresh_folder(name)
        rows.write.options(**(options or {})).parquet(f"{self.root}/{place}")
        self.tables.setdefault(name, {})[part] = place
        self.schemas.setdefault(name, rows.schema.json())

    def clear(self, name: str, schema: StructType) -> None:
        """The table `name` without rows."""
        self.tables[name] = {}
        self.schemas[name] = schema.json()

    def drop(self, name: str) -> None:
        self.tables.pop(name, None)
        self.schemas.pop(name, None)

    def read(self, name: str, parts: list[str] | None = None) -> DataFrame:
        return read_table(self.spark, self.root, name, parts, manifest=Manifest(self.base.version, self.tables, self.schemas))

    def commit(self) -> None:
        commit(self.spark, self.root, Manifest(self.base.version + 1, self.tables, self.schemas))


def drop_old_versions(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete all but the newest `keep` manifests and the folders that none of those names. Returns how many folders went.

    No writer may be at work: its folders are not named yet.
    """
    numbers = _numbers(spark, root)
    stay = [current(spark, root, n) for n in numbers[-keep:]]
    for n in numbers[:-keep]:
        fs, p = _fs(spark, f"{root}/{MANIFESTS}/{n}.json")
        fs.delete(p, False)
    used = {f for m in stay for folders in m.tables.values() for f in folders.values()}
    gone = 0
    for table in _names(spark, f"{root}/data"):
        for folder in _names(spark, f"{root}/data/{table}"):
            at = f"data/{table}/{folder}"
            # A part's folder may lie inside the folder of the write that made it.
            inside = {f for f in used if f == at or f.startswith(f"{at}/")}
            if not inside:
                fs, p = _fs(spark, f"{root}/{at}")
                fs.delete(p, True)
                gone += 1
            elif at not in inside:
                for part in _names(spark, f"{root}/{at}"):
                    if "=" in part and f"{at}/{part}" not in inside:
                        fs, p = _fs(spark, f"{root}/{at}/{part}")
                        fs.delete(p, True)
                        gone += 1
    return gone
