"""Parquet tables that change in whole steps.

A table is a folder. Each write puts its rows into a segment folder of its own; which segments, and
which partitions of them, are the table is said by numbered versions (``versions.Folder``). Readers
see one version; a write that breaks off leaves files that no version names; of two writers at once
the second finds its number taken, looks at what the first has done, and commits on top of it.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .versions import Folder

SEGMENT = "_seg"
#: What a write does with columns that the table does not have.
SCHEMA_CHANGES = ("ignore", "fail", "append_new_columns", "sync_all_columns")
Unit = tuple[str, str]


class Table:
    """The table in folder ``path``.

    ``key`` are the columns that tell rows apart, for ``merge``. ``partition`` is the column whose
    values get folders of their own, for ``overwrite_partitions`` and for readers that filter on it.
    A unit is a segment, or one partition of a segment.
    """

    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...] = (), partition: str | None = None):
        self.spark, self.path, self.key, self.partition = spark, path.rstrip("/"), key, partition
        self.versions = Folder(spark, f"{self.path}/_versions")

    @property
    def exists(self) -> bool:
        return self.versions.latest()[1] is not None

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the last version, or of an earlier one that has not been vacuumed."""
        state = self.versions.latest()[1] if version is None else self.versions.read(version)
        if state is None:
            raise FileNotFoundError(f"no table in {self.path}")
        return self._rows(state)

    def note(self) -> dict:
        """What the last writer has noted."""
        return (self.versions.latest()[1] or {}).get("note", {})

    def units(self) -> list[Unit]:
        """Segments and partition folders of the last version."""
        return [tuple(u) for u in (self.versions.latest()[1] or {"units": []})["units"]]

    def _rows(self, state: dict, units: list[Unit] | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
        schema = StructType.fromJson(json.loads(state["schema"]))
        units = [tuple(u) for u in state["units"]] if units is None else units
        if not units:
            return self.spark.createDataFrame([], schema)
        with_segment = StructType([*schema.fields, StructField(SEGMENT, StringType())])
        paths = [f"{self.path}/{SEGMENT}={seg}/{part}".rstrip("/") for seg, part in units]
        return self.spark.read.schema(with_segment).option("basePath", self.path).parquet(*paths).select(*[_quoted(c) for c in (*schema.names, *extra)])

    def _write(self, df: DataFrame) -> list[Unit]:
        """A new segment; its units."""
        seg = f"s{uuid.uuid4().hex}"
        where = f"{self.path}/{SEGMENT}={seg}"
        if not self.partition:
            df.write.parquet(where)
            return [(seg, "")]
        # Rows of a partition meet in as few files as their size needs, whatever the size.
        df.hint("rebalance", self.partition).write.partitionBy(self.partition).parquet(where)
        return [(seg, name) for name in self.versions.names(where) if "=" in name]

    def _commit(self, change: Callable[[dict | None], dict]) -> int:
        while True:
            number, state = self.versions.latest()
            if self.versions.commit(number + 1, change(state)):
                return number + 1

    def _schema(self, df: DataFrame, state: dict | None, on_change: str) -> StructType:
        """The table's schema after rows like ``df``."""
        new = StructType([StructField(f.name, f.dataType) for f in df.schema])
        if state is None or on_change == "sync_all_columns":
            return new
        old = StructType.fromJson(json.loads(state["schema"]))
        added = [f for f in new if f.name not in old.names]
        if on_change == "fail" and (added or set(old.names) - set(new.names)):
            raise ValueError(f"columns of {self.path} would change: {sorted(set(old.names) ^ set(new.names))}")
        return StructType([*old.fields, *added]) if on_change == "append_new_columns" else old

    def replace(self, df: DataFrame, **note) -> int:
        """All rows anew, in one step; the old ones stay until then, and for readers of the version before."""
        return self.commit_staged(self.stage(df), df.schema, **note)

    def stage(self, df: DataFrame) -> list[Unit]:
        """Rows that are written but not yet part of the table."""
        return self._write(df)

    def staged(self, units: list[Unit], schema: StructType) -> DataFrame:
        return self._rows({"schema": schema.json()}, units)

    def commit_staged(self, units: list[Unit], schema: StructType, **note) -> int:
        """Staged rows become all of the table."""
        plain = StructType([StructField(f.name, f.dataType) for f in schema])
        return self._commit(lambda state: {"schema": plain.json(), "units": units, "note": note})

    def overwrite_partitions(self, df: DataFrame, covers: Callable[[str], bool] = lambda value: False, **note) -> int:
        """The partitions that ``df`` has, and those whose value ``covers`` claims, anew; the others are not touched."""
        units = self._write(df)
        new = {part for _, part in units}

        def change(state: dict | None) -> dict:
            kept = [u for u in (state or {"units": []})["units"] if u[1] not in new and not covers(unquote(u[1].split("=", 1)[1]))]
            return {"schema": self._schema(df, state, "sync_all_columns").json(), "units": [*kept, *units], "note": note}

        return self._commit(change)

    def merge(self, df: DataFrame, on_schema_change: str = "sync_all_columns", **note) -> int:
        """Rows of new keys are added, rows of known keys are replaced; other rows stay as they are.

        Equal rows of ``df`` count once; different rows of one key are an error, since either could win.
        Null keys equal each other. Only the units that hold replaced rows are written again; where no
        key is known, which is the usual case of a log, nothing is. The table is made if there is none.
        ``on_schema_change`` is one of ``SCHEMA_CHANGES``; "sync_all_columns" takes the columns of ``df``.
        """
        if on_schema_change not in SCHEMA_CHANGES:
            raise ValueError(on_schema_change)
        self._schema(df, self.versions.latest()[1], on_schema_change)
        staged_units = self._write(df.distinct())
        own = {"schema": StructType([StructField(f.name, f.dataType) for f in df.schema]).json()}
        staged = self._rows(own, staged_units)
        if staged.groupBy(*self.key).count().filter("count > 1").limit(1).count():
            raise ValueError(f"different rows of one key ({', '.join(self.key)})")
        keys = staged.select(*[F.col(k).alias(f"_new_{k}") for k in self.key])
        while True:
            number, state = self.versions.latest()
            schema, units = self._schema(df, state, on_schema_change), [tuple(u) for u in (state or {"units": []})["units"]]
            if units:
                touched = {_unit_of(r["file"]) for r in self._files(state, keys).distinct().collect()}
                touched = [u for u in units if (u[0], unquote(u[1])) in touched]
                if touched:
                    rows = self._rows(state, touched)
                    left = rows.join(keys, _all(rows[k].eqNullSafe(F.col(f"_new_{k}")) for k in self.key), "left_anti")
                    units = [u for u in units if u not in touched] + self._write(left)
            if self.versions.commit(number + 1, {"schema": schema.json(), "units": [*units, *staged_units], "note": note}):
                return number + 1

    def _files(self, state: dict, keys: DataFrame) -> DataFrame:
        """Files that hold a row with one of ``keys``."""
        names = [f"_old_{k}" for k in self.key]
        rows = self._rows(state, extra=("_metadata.file_path",)).select(*[F.col(k).alias(n) for k, n in zip(self.key, names, strict=True)], F.col("file_path").alias("file"))
        return rows.join(keys, _all(F.col(n).eqNullSafe(F.col(f"_new_{k}")) for k, n in zip(self.key, names, strict=True)), "left_semi").select("file")

    def vacuum(self, keep: int = 1, older_than_s: float = 86_400.0) -> list[str]:
        """Delete segments that none of the last ``keep`` versions names, and older versions; their names.

        Segments younger than ``older_than_s`` stay, since a writer may be about to commit them.
        """
        held = self.versions.numbers()
        kept = {f"{SEGMENT}={seg}" for v in held[-keep:] for seg, _ in self.versions.read(v)["units"]}
        before = time.time() - older_than_s
        out = [name for name, changed in self.versions.names(self.path).items() if name.startswith(f"{SEGMENT}=") and name not in kept and changed <= before]
        for where in [f"{self.path}/{name}" for name in out] + [self.versions.file(v) for v in held[:-keep]]:
            self.versions.delete(where)
        return out


def _quoted(name: str) -> str:
    return name if name == "_metadata.file_path" else "`" + name.replace("`", "``") + "`"


def _all(conditions):
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _unit_of(file: str) -> Unit:
    """Segment and partition folder of a data file."""
    found = re.search(rf"/{SEGMENT}=([^/]+)/(?:([^/]+)/)?[^/]+$", unquote(file))
    return found[1], found[2] or ""
