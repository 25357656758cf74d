"""A versioned Parquet store: a write makes a new version and then moves one pointer; readers see a whole version.

Versions are immutable, so a reader keeps its snapshot while a writer works. The store's schema has a number: one
written by an older schema is migrated as a whole, one by a newer schema is refused.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 2

#: schema number: what brings the tables of the number before to it, {table: DataFrame} to {table: DataFrame}.
MIGRATIONS: dict[int, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]] = {}


def migration(to: int):
    def register(step):
        MIGRATIONS[to] = step
        return step

    return register


@migration(2)
def _value_dates(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Transactions know their value date."""
    rows = tables.get("transactions")
    if rows is None or "value_date" in rows.columns:
        return tables
    return dict(tables, transactions=rows.withColumn("value_date", F.lit(None).cast("string")))


class Store:
    """schemas: {table: StructType} to read by; a table without one is read as it was written."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict | None = None, schema_version: int = SCHEMA_VERSION):
        self.spark, self.path, self.schemas, self.schema_version = spark, path.rstrip("/"), schemas or {}, schema_version
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _current(self) -> tuple[int, int]:
        """(schema, version) of the current version, (0, 0) for an empty store. Pointers are empty files; the highest counts."""
        if not self._fs.exists(self._path("current")):
            return 0, 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path("current"))]
        schema, version = max((tuple(map(int, n.split("-"))) for n in names if n[0].isdigit()), key=lambda n: n[1], default=(0, 0))
        if schema > self.schema_version:
            raise ValueError(f"the store has schema {schema}; this code knows {self.schema_version}")
        return schema, version

    def version(self) -> int:
        return self._current()[1]

    def tables(self) -> list[str]:
        """Names of the current version's tables."""
        version = self.version()
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(f"v{version}"))) if version else []

    def read(self, name: str, version: int | None = None) -> DataFrame:
        reader = self.spark.read.schema(self.schemas[name]) if name in self.schemas else self.spark.read
        return reader.parquet(f"{self.path}/v{version or self.version()}/{name}")

    def write(self, tables: dict[str, DataFrame]) -> int:
        """All tables or none: the pointer is created only when every table has been written."""
        version = self.version() + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/v{version}/{name}")
        self._fs.create(self._path(f"current/{self.schema_version}-{version}"), False).close()
        return version

    def migrate(self) -> int:
        """Brings the store to this code's schema as one new version; the version before stays as a snapshot until compact()."""
        schema, version = self._current()
        if not version or schema == self.schema_version:
            return version
        plain = Store(self.spark, self.path, None, self.schema_version)  # as written, as an old table lacks what its new schema has
        tables = {name: plain.read(name) for name in plain.tables()}
        for to in range(schema + 1, self.schema_version + 1):
            tables = MIGRATIONS[to](tables) if to in MIGRATIONS else tables
        return self.write(tables)

    def merge_files(self, file_bytes: int = 256 << 20) -> int:
        """A new version in files of about file_bytes, if a table has more files than that needs."""
        version = self.version()
        files = {name: self._files(f"v{version}/{name}") for name in self.tables()}
        needed = {name: max(1, -(-size // file_bytes)) for name, (_, size) in files.items()}
        few = lambda name: self.read(name).coalesce(needed[name]) if files[name][0] > needed[name] else self.read(name)
        return self.write({name: few(name) for name in files}) if any(files[n][0] > needed[n] for n in files) else version

    def compact(self, keep: int = 1) -> None:
        """Drops versions older than the `keep` newest."""
        for v in range(1, self.version() - keep + 1):
            self._fs.delete(self._path(f"v{v}"), True)

    def _files(self, name: str) -> tuple[int, int]:
        """Data files of a folder and their bytes."""
        found = [f for f in self._fs.listStatus(self._path(name)) if f.getPath().getName().startswith("part-")]
        return len(found), sum(f.getLen() for f in found)


def export(rows: DataFrame, path: str, kind: str = "csv", without: tuple[str, ...] = ("raw_json",)) -> None:
    """CSV or JSON lines of all columns but the raw payload, in order of account, date and row."""
    kept = rows.select(*[c for c in rows.columns if c not in without]).orderBy("account_id", "booking_date", "row_id")
    writer = kept.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def shared_dir(spark) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tallywright-")
