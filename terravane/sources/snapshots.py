"""Versioned tables on any store that Spark writes: a snapshot is a folder, the current one is named by a manifest row."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SnapshotStore:
    """Tables below root; a commit writes new folders, checks them, and then appends a manifest row that names them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def manifest(self) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self.spark.read.schema("generation long, tables string").json(f"{self.root}/manifest") if fs.exists(path) else None

    def current(self) -> tuple[int, dict[str, str]]:
        m = self.manifest()
        row = m.orderBy(F.desc("generation")).limit(1).collect() if m is not None else []
        return (row[0]["generation"], json.loads(row[0]["tables"])) if row else (0, {})

    def commit(self, tables: dict[str, DataFrame], checks=()) -> int:
        """Write tables as the next generation; tables not given stay. checks get the new tables and raise to stop the commit."""
        generation, names = self.current()
        fresh = {n: f"{self.root}/{n}/{uuid.uuid4().hex}" for n in tables}
        for n, df in tables.items():
            df.write.parquet(fresh[n])
        read = {n: self.spark.read.parquet(p) for n, p in fresh.items()}
        for check in checks:
            check(read)
        self._name(generation + 1, json.dumps({"generation": generation + 1, "tables": json.dumps(names | fresh, sort_keys=True)}))
        return generation + 1

    def _name(self, generation: int, row: str) -> None:
        """Make a generation current: its manifest file is written whole under a hidden name, then renamed to its own.

        A rename to a name that is there fails, so of two writers that start from one generation one alone commits; one
        that stops before the rename leaves nothing that a later commit meets.
        """
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/{name}")
        to, new = path(f"{generation:012d}.json"), path(f".{uuid.uuid4().hex}")
        fs = to.getFileSystem(conf)
        out = fs.create(new, False)
        out.write(bytearray(row.encode()))
        out.close()
        to, new = fs.makeQualified(to), fs.makeQualified(new)
        kinds = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), conf).rename(new, to, kinds)
        except Exception as e:
            fs.delete(new, False)
            if fs.exists(to):
                raise RuntimeError(f"generation {generation} was committed by another writer") from e
            raise

    def read(self, table: str, generation: int | None = None) -> DataFrame:
        """A table as of a generation, the current one by default; readers that hold it are not disturbed by later commits."""
        if generation is None:
            return self.spark.read.parquet(self.current()[1][table])
        row = self.manifest().where(F.col("generation") == generation).first()
        return self.spark.read.parquet(json.loads(row["tables"])[table])
