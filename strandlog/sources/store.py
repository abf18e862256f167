"""The revision log as Parquet, with atomic commits.

    <root>/data/commit=<commit>/ns=<namespace>/part-*.parquet
    <root>/commits/<number>-<commit>.json      {"commit": ..., "replaces": [...]}

A commit's rows are written first and become visible when its small manifest file is created by a rename, so readers see all
of a commit or nothing.  A compaction is a commit that replaces others.  Paths go through Hadoop's file system, so the
root may be in any store that Spark knows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlog.operators import log as L


class Files:
    """A few file operations on any Hadoop path."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    @property
    def fs(self):
        return self.path().getFileSystem(self.conf)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def write(self, name: str, text: str) -> None:
        """Write aside, then rename: the name appears with its whole content."""
        aside = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.mkdirs(self.path(name).getParent())
        if not self.fs.rename(aside, self.path(name)):
            self.fs.delete(aside, False)
            raise FileExistsError(name)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class LogStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.files = spark, Files(spark, root)
        self.root = root.rstrip("/")

    def commits(self) -> list[dict]:
        """Visible commits, oldest first; what a later one replaces is left out."""
        found = [json.loads(self.files.read(f"commits/{n}")) for n in self.files.names("commits") if n.endswith(".json")]
        gone = {c for m in found for c in m["replaces"]}
        return [m for m in found if m["commit"] not in gone]

    def append(self, rows: DataFrame, replaces: list[str] | None = None) -> str:
        """Commit rows of the log schema; one file set per namespace."""
        commit = uuid.uuid4().hex
        rows.select(L.SCHEMA.names).write.partitionBy("ns").parquet(f"{self.root}/data/commit={commit}")
        number = len(self.files.names("commits"))
        self.files.write(f"commits/{number:012d}-{commit}.json", json.dumps({"commit": commit, "replaces": replaces or []}))
        return commit

    def read(self) -> DataFrame:
        """The log; filters on `ns` skip whole folders, filters on keys and revisions reach the files."""
        names = [f"data/commit={m['commit']}" for m in self.commits()]
        dirs = [f"{self.root}/{n}" for n in names if any(x.startswith("ns=") for x in self.files.names(n))]
        if not dirs:
            return self.spark.createDataFrame([], L.SCHEMA)
        # one scan over all commits: the plan stays the same however many there are
        schema = T.StructType([*L.SCHEMA.fields, T.StructField("commit", T.StringType())])
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/data").parquet(*dirs).select(L.SCHEMA.names)

    def compact(self, now_ms: int) -> str:
        """Rewrite everything visible without what is dead; sorted by key in each file, so scans can skip row groups."""
        old = [m["commit"] for m in self.commits()]
        rows = L.compact(self.read(), now_ms).repartition("ns", "key_i", "key_s").sortWithinPartitions("ns", *L.key_order(), "rev")
        return self.append(rows, replaces=old)

    def vacuum(self) -> int:
        """Delete the data of replaced and of never published commits; returns how many."""
        kept = {m["commit"] for m in self.commits()}
        gone = [n for n in self.files.names("data") if n.removeprefix("commit=") not in kept]
        for n in gone:
            self.files.delete(f"data/{n}")
        return len(gone)

    def repair(self) -> dict[str, int]:
        """Drop commits whose files can't be read; says how many were kept and dropped."""
        bad = []
        for m in self.commits():
            try:
                self.spark.read.parquet(f"{self.root}/data/commit={m['commit']}").agg(F.count("rev"), F.max("value")).collect()
            except Exception:  # any reader's failure means that the commit can't serve
                bad.append(m["commit"])
        if bad:
            commit = uuid.uuid4().hex
            self.files.fs.mkdirs(self.files.path(f"data/commit={commit}"))
            self.files.write(f"commits/{len(self.files.names('commits')):012d}-{commit}.json", json.dumps({"commit": commit, "replaces": bad}))
        return {"kept": len(self.commits()) - bool(bad), "dropped": len(bad)}

    def destroy(self) -> None:
        if not (self.files.names("commits") or self.files.names("data")):
            raise FileNotFoundError(f"no store at {self.root}")
        self.files.delete("")


def dump(log: DataFrame, path: str, now_ms: int, after=None) -> None:
    """The newest live rows as Parquet."""
    L.dump(log, now_ms, after).write.parquet(path)


def load(spark: SparkSession, path: str, store: LogStore, rev_of) -> str:
    """Replay a dump as fresh writes into an empty store; `rev_of` gives the new revision from the old."""
    if store.commits():
        raise FileExistsError("a dump is loaded into an empty store only")
    rows = spark.read.schema(L.SCHEMA).parquet(path)
    return store.append(rows.withColumn("rev", rev_of(F.col("rev"))))


def files_as_values(spark: SparkSession, paths: str, ns: str, rev) -> DataFrame:
    """Each file as one put: key is its name, value its bytes."""
    found = spark.read.format("binaryFile").load(paths)
    return found.select(
        F.lit(ns).alias("ns"), F.lit(None).cast("bigint").alias("key_i"), F.element_at(F.split("path", "/"), -1).alias("key_s"), rev.alias("rev"),
        F.lit("data").alias("op"), F.col("content").alias("value"), F.lit(None).cast("string").alias("obj_hash"), F.lit(None).cast("bigint").alias("obj_size"),
        F.lit(0).cast("bigint").alias("expires_at_ms"),
    )
