"""Schema registry: declared tables, ordered migrations, and checks of what a folder holds."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import exists, move


class SchemaError(RuntimeError):
    """A table in the store lacks declared columns or has them with another type."""


@dataclass
class Registry:
    """tables: name -> DDL schema; migrations: (version, table, DDL of added columns), applied in order."""

    tables: dict[str, str] = field(default_factory=dict)
    migrations: list[tuple[str, str, str]] = field(default_factory=list)

    def schema(self, name: str) -> T.StructType:
        from pyspark.sql.types import _parse_datatype_string

        fields = list(_parse_datatype_string(self.tables[name]).fields)
        known = {f.name for f in fields}
        for _, table, ddl in sorted(self.migrations):
            if table == name:
                fields += [f for f in _parse_datatype_string(ddl).fields if f.name not in known]
                known |= {f.name for f in fields}
        return T.StructType(fields)

    def ensure(self, spark: SparkSession, folder: str) -> dict[str, list[str]]:
        """Creates missing tables, applies pending migrations in order of version, and fails on a table
        without its first columns. A migration adds its columns as nulls in a rewritten table, which then
        takes the old one's place; the old one stays beside it as `<name>.before-<version>`. Columns that
        exist already are left as they are. Applied versions are kept in `schema_migrations` by table, so a second
        run changes nothing and one that ended between two tables of a version goes on with the other."""
        created, applied = [], []
        log = f"{folder}/schema_migrations.parquet"
        logged = spark.read.schema("version string, table_name string").parquet(log) if exists(spark, log) else None
        done = {(r["version"], r["table_name"]) for r in logged.distinct().collect()} if logged is not None else set()
        # A line without a table was written before lines had one: the version is done for all its tables.
        pending = [m for m in sorted(self.migrations) if not {(m[0], m[1]), (m[0], None)} & done]
        for name in sorted(self.tables):
            path, staged = f"{folder}/{name}.parquet", f"{folder}/{name}.next"
            if not exists(spark, path) and exists(spark, staged):  # a run ended between the two renames
                move(spark, staged, path)
            if not exists(spark, path):
                spark.createDataFrame([], self.schema(name)).write.parquet(path)
                created.append(name)
                continue
            have = set(spark.read.parquet(path).columns)
            base = {f.name for f in T.StructType.fromDDL(self.tables[name]).fields}
            if base - have:
                raise SchemaError(f"{name} lacks {sorted(base - have)}")
        for version, name, ddl in pending:
            path, staged = f"{folder}/{name}.parquet", f"{folder}/{name}.next"
            old = spark.read.parquet(path)
            new = [f for f in T.StructType.fromDDL(ddl).fields if f.name not in old.columns]
            if new:
                old.withColumns({f.name: F.lit(None).cast(f.dataType) for f in new}).write.mode("overwrite").parquet(staged)
                move(spark, path, f"{folder}/{name}.before-{version}")
                move(spark, staged, path)
            spark.createDataFrame([(version, name)], "version string, table_name string").write.mode("append").parquet(log)
            applied.append(version)
        return {"created": created, "applied": applied}

    def read(self, spark: SparkSession, folder: str, name: str) -> DataFrame:
        """A table under its declared schema; columns its files lack are null."""
        return spark.read.schema(self.schema(name)).parquet(f"{folder}/{name}.parquet")

    def missing(self, spark: SparkSession, folder: str) -> list[str]:
        return [n for n in sorted(self.tables) if not exists(spark, f"{folder}/{n}.parquet")]

    def extra(self, spark: SparkSession, names: list[str]) -> list[str]:
        """Names that the store has and the registry doesn't declare."""
        return sorted(set(names) - set(self.tables) - {"schema_migrations"})

    def columns(self, spark: SparkSession) -> DataFrame:
        rows = [(n, f.name, f.dataType.simpleString()) for n in sorted(self.tables) for f in self.schema(n).fields]
        return spark.createDataFrame(rows, "table_name string, column_name string, type string")
