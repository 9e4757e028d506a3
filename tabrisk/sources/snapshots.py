"""Versioned table snapshots (S4, S5) and CSV ingest.

A table is a folder with one sub-folder per written part and a log of commits (``_versions``: the parts and rows of each
version). A version is the list of part folders it reads. Parts are written first and a commit names them in one atomic
step (``sources.commits``): a writer that fails before it leaves no trace that readers or writers could stumble over.

* ``commit(df)``: a full new version (after update / delete / replace): one new part folder.
* ``append(df)``: a new version = previous parts + one new part folder (no rewrite of old rows).

Concurrent writers are optimistic. ``read`` marks the columns of the frame it returns with the version they come from, and the
marks stay on whatever is selected, filtered or joined from it; ``commit`` finds the oldest one again, so it knows which
version the caller has seen (``base`` says so by hand). If others have committed since, the commit is refused, unless all of
them and the caller have named the ids they touched (``touched``) and no id is among both. Then the caller's change is
carried over: the latest version without the caller's ids, and the caller's rows with those ids. A frame that comes from no version of the table and
is given no base replaces whatever is there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabrisk.functions import normalize_nans
from tabrisk.plans.stored import stored
from tabrisk.sources.commits import CommitLog

MARK = "snapshot_version"


class VersionConflict(RuntimeError):
    """Another writer has committed since the version that this one read, and the changes may overlap."""


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.versions = CommitLog(spark, f"{self.root}/_versions")

    def version(self) -> int:
        """The latest version, or -1."""
        return self.versions.latest()

    def read(self, version: int | None = None) -> DataFrame:
        """A version (the latest one by default); its columns carry the version as metadata, for ``commit``."""
        v = self.version() if version is None else version
        if v < 0 or (version is not None and v not in self.versions.numbers()):
            raise FileNotFoundError(f"no committed snapshot {'' if version is None else version} under {self.root}")
        df = self.spark.read.parquet(*[f"{self.root}/{p}" for p in self.versions.get(v)["parts"]])
        mark = {MARK: v, "snapshot_root": self.root}
        return df.select(*[F.col(f"`{c}`").alias(c, metadata=mark) for c in df.columns])

    def base_of(self, df: DataFrame) -> int | None:
        """The oldest version of this table that columns of ``df`` come from."""
        marks = [f.metadata for f in df.schema.fields]
        return min((m[MARK] for m in marks if m.get("snapshot_root") == self.root and MARK in m), default=None)

    def _write(self, df: DataFrame, kind: str) -> tuple[str, int]:
        part = f"{kind}-{uuid.uuid4().hex}"
        plain = df.select(*[F.col(f"`{c}`").alias(c, metadata={}) for c in df.columns])
        plain.write.mode("errorifexists").parquet(f"{self.root}/{part}")
        rows = self.spark.read.parquet(f"{self.root}/{part}").count()  # parquet footer counts, cheap
        return part, rows

    def _check_apart(self, base: int, latest: int, touched: DataFrame | None) -> None:
        """Refuse unless the versions after ``base`` touched other ids than ``touched``."""
        refused = VersionConflict(f"{self.root} was read at version {base} and is at version {latest}")
        if touched is None:
            raise refused
        for v in range(base + 1, latest + 1):
            ids = self.versions.get(v).get("touched")
            if ids is None:
                raise refused
            other = self.spark.read.parquet(f"{self.root}/{ids}")
            if not touched.join(other.withColumnRenamed(other.columns[0], "_id"), F.col(touched.columns[0]).cast("string") == F.col("_id").cast("string"), "left_semi").isEmpty():
                raise VersionConflict(f"version {v} of {self.root} touched the same ids")

    def _check_moved(self, latest: int) -> None:
        """A lost race shows a newer version; a listing that doesn't show it can't be built on."""
        if self.version() <= latest:
            raise VersionConflict(f"version {latest + 1} of {self.root} was committed by another writer")

    def _touched(self, touched: DataFrame | None) -> tuple[DataFrame | None, str | None]:
        """The touched ids, written beside the table before they are looked at."""
        if touched is None:
            return None, None
        part, _ = self._write(touched.select(touched.columns[0]).distinct(), "touched")
        return self.spark.read.parquet(f"{self.root}/{part}"), part

    def commit(self, df: DataFrame, base: int | None = None, touched: DataFrame | None = None) -> int:
        """The whole table as a new version. ``touched``: ids (first column, of the table's id name) that the change is about."""
        if base is None:
            base = self.base_of(df)
        ids, ids_part = self._touched(touched)
        part = rows = built_on = None
        while True:
            latest = self.version()
            if base is None:
                base = latest
            if part is None or built_on != latest:
                new = df
                if latest != base:
                    self._check_apart(base, latest, ids)
                    idc = ids.columns[0]
                    new = self.read(latest).join(ids, idc, "left_anti").unionByName(df.join(ids, idc, "left_semi"))
                (part, rows), built_on = self._write(new, "part"), latest
            if self.versions.create(latest + 1, {"parts": [part], "rows": rows, "kind": "rewrite", "touched": ids_part}):
                return latest + 1
            self._check_moved(latest)

    def append(self, df: DataFrame, base: int | None = None, touched: DataFrame | None = None) -> int:
        """New rows (aligned to the table schema by name) as a new version sharing the old parts.

        Rows are only added, so what others have committed since ``base`` stays. With ``touched`` (the new ids) the append is
        refused if one of those commits touched the same ids, e.g. gave them to its own new rows.
        """
        latest = self.version()
        if latest >= 0:
            schema = self.read(latest).schema
            df = df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns
                             else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
        part, rows = self._write(df, "part")
        ids, ids_part = self._touched(touched)
        base = latest if base is None else base
        while True:
            latest = self.version()
            if latest > base and ids is not None:
                self._check_apart(base, latest, ids)
            before = self.versions.get(latest) if latest >= 0 else {"parts": [], "rows": 0}
            new = {"parts": [*before["parts"], part], "rows": before["rows"] + rows, "kind": "append", "touched": ids_part}
            if self.versions.create(latest + 1, new):
                return latest + 1
            self._check_moved(latest)


def ingest_csv(spark: SparkSession, csv_path: str, store: SnapshotStore,
               schema: T.StructType | None = None) -> tuple[int, int]:
    """Bronze CSV -> typed Parquet snapshot (NaN normalised to NULL once, here).

    Returns (version, malformed lines): a malformed line is stored with NULL for what could not be read.
    """
    from tabrisk.sources.tables import read_csv_table
    df = read_csv_table(spark, csv_path, schema)
    bad = 0
    if "_corrupt_record" in df.columns:
        # Spark does not count the corrupt lines of a raw file alone, so the parsed rows are stored first
        df = stored(df, "ingest")
        bad = df.filter(F.col("_corrupt_record").isNotNull()).count()
        df = df.drop("_corrupt_record")
    return store.commit(normalize_nans(df)), bad


def fresh_root(spark: SparkSession, kind: str) -> str:
    from tabrisk.session import scratch_path
    return scratch_path(spark, kind)

