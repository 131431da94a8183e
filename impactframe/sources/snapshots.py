"""Versioned tables in a shared folder: new files first, then one manifest that makes them visible.

A commit writes its rows to new folders (``data/<table>/version=<v>``) and then a manifest, the list of all live
(table, key, version). Readers take the newest manifest that was written completely (its ``_SUCCESS`` file is the
switch), so a commit that dies half way leaves the old state. Replacing or dropping a key drops its line of the
manifest; nothing that a reader may be reading is overwritten. ``vacuum`` deletes the folders that no line names.

One writer at a time: two that commit the same version are told apart, and the later one fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "table_name string, live_key string, version string"


@dataclass(frozen=True)
class Part:
    """Rows that a commit adds to a table, the key they are replaced and dropped by, and their folders."""

    rows: DataFrame
    key: Column
    folders: tuple[str, ...] = ()


@dataclass(frozen=True)
class Snapshots:
    spark: SparkSession
    root: str
    #: Manifests never change, so the versions that one names are looked up once.
    _seen: dict = field(default_factory=dict, compare=False, repr=False)

    # --- files ------------------------------------------------------------

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        """The names in a folder: as many as there are commits, not as there are rows."""
        path, files = self._path(folder), self._files()
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def exists(self, path: str) -> bool:
        return self._files().exists(self._path(path))

    def delete(self, path: str) -> None:
        self._files().delete(self._path(path), True)

    # --- reading ----------------------------------------------------------

    def version(self) -> int | None:
        """The newest version that is complete."""
        files = self._files()
        for number in sorted(map(int, self.names("manifest")), reverse=True):
            if files.exists(self._path(f"manifest/{number}/_SUCCESS")):
                return number
        return None

    def manifest(self, version: int | None) -> DataFrame:
        if version is None:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{version}")

    def _folders(self, version: int | None) -> dict[str, list[str]]:
        if version not in self._seen:
            rows = self.manifest(version).select("table_name", "version").distinct().collect()
            self._seen[version] = {}
            for row in sorted(rows):
                self._seen[version].setdefault(row["table_name"], []).append(row["version"])
        return self._seen[version]

    def read(self, table: str, schema: str, key: Column) -> DataFrame:
        """The live rows of a table with its fixed schema; only folders that the manifest names are listed."""
        current = self.version()
        folders = self._folders(current).get(table)
        if not folders:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/data/{table}"
        stored = self.spark.read.schema(f"{schema}, version string").option("basePath", base)
        rows = stored.parquet(*[f"{base}/version={v}" for v in folders])
        live = self.manifest(current).filter(F.col("table_name") == table)
        live = live.select(F.col("live_key").alias("_live_key"), F.col("version").alias("_version"))
        return rows.join(live, (key == F.col("_live_key")) & (F.col("version") == F.col("_version")), "left_semi").drop("version")

    # --- writing ----------------------------------------------------------

    def stage(self, parts: dict[str, Part]) -> str:
        """Write the rows of a commit; nothing reads them before ``publish``."""
        version = f"{(max(map(int, self.names('manifest')), default=0)) + 1}-{uuid.uuid4().hex[:8]}"
        for table, part in parts.items():
            self._write(part.rows, f"data/{table}/version={version}", part.folders)
        return version

    def _write(self, rows: DataFrame, path: str, folders: tuple[str, ...]) -> None:
        if folders:
            # Adaptive execution cuts the folders of a hot key into several files and gathers small ones.
            rows = rows.hint("rebalance", *folders)
        writer = rows.write.partitionBy(*folders) if folders else rows.write
        writer.parquet(f"{self.root}/{path}")

    def staged(self, version: str, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/data/{table}/version={version}")

    def publish(self, version: str | None, added: DataFrame | None, dropped: Callable[[DataFrame], DataFrame]) -> None:
        """Write the next manifest: the current one without the lines that ``dropped`` selects, and the added ones
        (table_name, live_key)."""
        lines = self.manifest(self.version())
        kept = lines.join(dropped(lines).select("table_name", "live_key"), ["table_name", "live_key"], "left_anti")
        if added is not None:
            kept = kept.unionByName(added.withColumn("version", F.lit(version)))
        number = max(map(int, self.names("manifest")), default=0) + 1
        # One file: as many lines as there are live keys. An existing folder is an error.
        kept.select("table_name", "live_key", "version").coalesce(1).write.parquet(f"{self.root}/manifest/{number}")

    def write_part(self, version: str, table: str, rows: DataFrame) -> None:
        """One more table of a staged commit."""
        self._write(rows, f"data/{table}/version={version}", ())

    def vacuum(self) -> list[str]:
        """Delete the folders that the newest manifest does not name, and older manifests; returns what went."""
        current = self.version()
        folders, files, gone = self._folders(current), self._files(), []
        for table in self.names("data"):
            live = {f"version={v}" for v in folders.get(table, [])}
            gone += [f"data/{table}/{name}" for name in self.names(f"data/{table}") if name not in live]
        gone += [f"manifest/{n}" for n in self.names("manifest") if current is not None and int(n) != current and int(n) < current]
        for path in gone:
            files.delete(self._path(path), True)
        return sorted(gone)
