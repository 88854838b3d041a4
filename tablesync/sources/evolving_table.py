"""An append-only table whose schema changes without rewriting files.

Every column has an id that never changes and is its name in the files, so a rename touches no
file, a dropped column is not read and its name may be used again, and an added one is null in older
files. One scan of all files with the newest schema, by ids, reads every version.

Layout::

    <path>/data/run=<id>/part-*.parquet    rows, columns named c<id>
    <path>/schemas/<20 digits>             versions of the schema
    <path>/runs/<20 digits>                the run each append added
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.operators.schema import WIDTHS
from tablesync.session import local_frame, new_id
from tablesync.sources.commits import CommitConflict, commit, committed, newest_commit, read_commit


@dataclass(frozen=True)
class Column:
    id: int
    name: str
    type: T.DataType

    @property
    def stored(self) -> str:
        return f"c{self.id}"


@dataclass(frozen=True)
class Schema:
    columns: tuple[Column, ...]
    next_id: int  # ids of dropped columns are never used again

    def text(self) -> str:
        columns = [{"id": c.id, "name": c.name, "type": json.loads(c.type.json())} for c in self.columns]
        return json.dumps({"columns": columns, "next_id": self.next_id})

    @classmethod
    def of(cls, text: str) -> Schema:
        state = json.loads(text)
        # a type is written in the form of a field of a schema
        field = lambda c: T.StructField.fromJson({"name": c["name"], "type": c["type"], "nullable": True, "metadata": {}})
        return cls(tuple(Column(c["id"], c["name"], field(c).dataType) for c in state["columns"]), state["next_id"])

    def named(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise ValueError(f"no column {name}")


def widens(old: T.DataType, new: T.DataType) -> bool:
    """Whether files of the one type may be read as the other without losing a digit."""
    a, b = WIDTHS.get(old.simpleString()), WIDTHS.get(new.simpleString())
    return bool(a and b and a[0] == b[0] != "time" and a[1] <= b[1])


@dataclass(frozen=True)
class EvolvingTable:
    path: str

    def schema(self, spark: SparkSession, version: int | None = None) -> Schema:
        """A version of the schema (the newest); empty before the first."""
        folder = f"{self.path}/schemas"
        if version is not None:
            return Schema.of(read_commit(spark, folder, version))
        _, text = newest_commit(spark, folder)
        return Schema((), 1) if text is None else Schema.of(text)

    def versions(self, spark: SparkSession) -> list[int]:
        return committed(spark, f"{self.path}/schemas")

    def change(self, spark: SparkSession, add=(), rename=None, drop=(), widen=None) -> Schema:
        """Commit the next version of the schema; ``CommitConflict`` if another writer did.

        ``add`` is a list of fields, ``rename`` maps old names to new ones, ``widen`` names to types.
        """
        folder = f"{self.path}/schemas"
        number, text = newest_commit(spark, folder)
        now = Schema((), 1) if text is None else Schema.of(text)
        rename, widen = dict(rename or {}), dict(widen or {})
        for name in [*rename, *drop, *widen]:
            now.named(name)
        columns = []
        for c in now.columns:
            if c.name in drop:
                continue
            dtype = widen.get(c.name, c.type)
            if dtype != c.type and not widens(c.type, dtype):
                raise ValueError(f"column {c.name} cannot change from {c.type.simpleString()} to {dtype.simpleString()}")
            columns.append(Column(c.id, rename.get(c.name, c.name), dtype))
        columns += [Column(now.next_id + i, f.name, f.dataType) for i, f in enumerate(add)]
        names = [c.name.lower() for c in columns]
        if len(set(names)) < len(names):
            raise ValueError("two columns would have one name")
        new = Schema(tuple(columns), now.next_id + len(add))
        commit(spark, folder, number + 1, new.text())
        return new

    def append(self, rows: DataFrame) -> None:
        """Add rows of the newest schema; columns they lack are null, others are an error."""
        spark = rows.sparkSession
        schema = self.schema(spark)
        unknown = set(rows.columns) - {c.name for c in schema.columns}
        if unknown:
            raise ValueError(f"no columns {', '.join(sorted(unknown))} in the schema")
        run = new_id()
        named = [
            (F.col(f"`{c.name}`") if c.name in rows.columns else F.lit(None)).cast(c.type).alias(c.stored) for c in schema.columns
        ]
        rows.select(*named).write.parquet(f"{self.path}/data/run={run}")
        folder = f"{self.path}/runs"
        for _ in range(20):
            try:
                return commit(spark, folder, (committed(spark, folder) or [0])[-1] + 1, run)
            except CommitConflict:
                continue
        raise CommitConflict(f"{self.path} is written by too many writers at once")

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """All rows under one version of the schema, in one scan."""
        schema = self.schema(spark, version)
        if not schema.columns:
            return spark.range(0).select()
        folder = f"{self.path}/runs"
        # one name per append
        paths = [f"{self.path}/data/run={read_commit(spark, folder, n)}" for n in committed(spark, folder)]
        stored = T.StructType([T.StructField(c.stored, c.type) for c in schema.columns])
        rows = spark.read.schema(stored).parquet(*paths) if paths else local_frame(spark, [], stored)
        return rows.select(*[F.col(c.stored).alias(c.name) for c in schema.columns])
