"""Bundles: several tables committed at once under a manifest that binds them to their content.

Tables go to folders of their own; then one manifest file appears by a rename
that fails if it is there already.  Readers follow the newest manifest, so an
attempt that ends early leaves the state before it, and of two writers one loses.

The manifest names each table's folder; beside the tables lie their digests, two
sums of hashes and a count for each file, which tasks merge: no file is ever in
one row.  ``bind`` computes them anew before a plan runs and names what changed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEPT = 9  # digits of a manifest's number


class BundleChanged(ValueError):
    """A table isn't what the manifest recorded."""


class BundleTaken(ValueError):
    """Another writer committed first."""


def digests(rows: DataFrame) -> DataFrame:
    """file, n, a, b of a table read from files: sums over the hash of each row, whatever their order."""
    sha = F.sha2(F.to_json(F.struct(*rows.columns)), 256)
    half = lambda at: F.sum(F.conv(F.substring(sha, at, 15), 16, 10).cast("decimal(38,0)"))
    return rows.select("*", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("_file")).groupBy(F.col("_file").alias("file")).agg(F.count("*").alias("n"), half(1).cast("decimal(38,0)").alias("a"), half(16).cast("decimal(38,0)").alias("b"))


class Bundle:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the newest manifest, 0 if there is none."""
        if not self._files.exists(self._path(self.root)):
            return 0
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(self.root))]
        return max((int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")), default=0)

    def manifest(self) -> dict:
        v = self.version()
        if not v:
            raise FileNotFoundError(f"no manifest in {self.root}; commit tables first")
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/manifest-{v:0{_KEPT}}.json", wholetext=True).collect()))

    def commit(self, tables: dict[str, DataFrame], *, expected: int | None = None) -> int:
        """Write the tables and put them in force together; tables that aren't named stay as they were.

        ``expected`` is the version the caller built on (the present one if not given).
        """
        base = self.version() if expected is None else expected
        named = dict(self.manifest()["tables"]) if base else {}
        attempt = uuid.uuid4().hex
        for name, df in tables.items():
            folder = f"tables/{attempt}/{name}"
            df.write.parquet(f"{self.root}/{folder}")
            digests(self.spark.read.schema(df.schema).parquet(f"{self.root}/{folder}")).coalesce(1).write.parquet(f"{self.root}/digests/{attempt}/{name}")
            named[name] = {"folder": folder, "digests": f"digests/{attempt}/{name}", "schema": df.schema.json()}
        self._swap(base + 1, {"version": base + 1, "tables": named})
        return base + 1

    def _swap(self, version: int, manifest: dict) -> None:
        draft, final = self._path(f"{self.root}/draft-{uuid.uuid4().hex}"), self._path(f"{self.root}/manifest-{version:0{_KEPT}}.json")
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if self._files.exists(final) or not self._files.rename(draft, final):
            self._files.delete(draft, False)
            raise BundleTaken(f"version {version} of {self.root} exists; read it and commit on top")

    def _table(self, entry: dict) -> DataFrame:
        from pyspark.sql.types import StructType

        return self.spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).parquet(f"{self.root}/{entry['folder']}")

    def changed(self, name: str) -> DataFrame:
        """file, problem (changed, missing, added) of a table's files."""
        entry = self.manifest()["tables"][name]
        was = self.spark.read.parquet(f"{self.root}/{entry['digests']}").select("file", F.struct("n", "a", "b").alias("was"))
        now = digests(self._table(entry)).select("file", F.struct("n", "a", "b").alias("now"))
        both = was.join(now, "file", "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))
        return both.select("file", F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "added").otherwise("changed").alias("problem"))

    def bind(self, *names: str) -> dict[str, DataFrame]:
        """The tables (all if none is named), after checking that they hold what was committed."""
        tables = self.manifest()["tables"]
        for name in names or tables:
            if name not in tables:
                raise KeyError(f"no table {name!r}; there are {', '.join(sorted(tables))}")
            bad = self.changed(name).orderBy("file").limit(3).collect()
            if bad:
                raise BundleChanged(f"{name}: {', '.join(f'{r.file} {r.problem}' for r in bad)}")
        return {name: self._table(tables[name]) for name in names or tables}
