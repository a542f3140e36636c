"""A versioned store of an index's tables as Parquet.

Every publication writes new folders beside the old ones and then moves a small pointer file that names them,
so readers see one version or the next and a lost job leaves only unreferenced folders. Paths go
through Hadoop's file systems, so a store may lie wherever Spark reads.
"""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 12


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. Where spark.checkpoint.dir is unset, a folder of our own on one
    machine; on a cluster an error, since executors would not see each other's files."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        at = "file://" + tempfile.mkdtemp(prefix="textmill-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _located(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _located(spark, path)
    fs.delete(where, True)


def stamp(spark: SparkSession, path: str) -> tuple:
    """What tells one state of a file or folder of files from another: path, time and size of each."""
    where, fs = _located(spark, path)
    return tuple(sorted((f.getPath().toString(), f.getModificationTime(), f.getLen()) for f in fs.listStatus(where)))


_temporary: list[tuple[SparkSession, str]] = []


def fresh(spark: SparkSession, name: str) -> str:
    """A folder in the shared one that nothing has used; removed when the driver ends."""
    path = f"{shared_folder(spark)}/textmill-{name}/{uuid.uuid4().hex}"
    if not _temporary:
        atexit.register(_clear)
    _temporary.append((spark, path))
    return path


def temporary(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _clear() -> None:
    for spark, path in _temporary:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            return


class NewerSchema(Exception):
    pass


class Store:
    """Tables in BUCKETS parts by the hash of a key, so that a change of some documents writes their parts anew and
    leaves the others where they are."""

    BUCKETS = 16

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _load(self, name: str) -> dict | None:
        at, fs = _located(self.spark, f"{self.base}/{name}")
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _save(self, name: str, value: dict) -> None:
        """A small file, written beside its place and then moved there in one step."""
        new, fs = _located(self.spark, f"{self.base}/{name}.{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(json.dumps(value).encode())
        out.close()
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        old, _ = _located(self.spark, f"{self.base}/{name}")
        options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(new, old, options)

    def place(self) -> str:
        """Where the tables are: here, or where move() has taken them."""
        moved = self._load("_moved.json")
        return Store(self.spark, moved["base"]).place() if moved else self.base

    def pointer(self) -> dict | None:
        """The published version: its name, and of each table key, columns, rows and each part's folder and rows."""
        at = self.place()
        if at != self.base:
            return Store(self.spark, at).pointer()
        found = self._load("_current.json")
        if found is not None and found["schema_version"] > SCHEMA_VERSION:
            raise NewerSchema(found["schema_version"])
        return found

    def read(self, table: str, parts: list[int] | None = None) -> DataFrame:
        """A table, or those of its parts."""
        current = self.pointer()
        if current is None:
            raise FileNotFoundError(self.base)
        held = current["tables"][table]
        paths = [f"{self.place()}/{folder}" for part, folder in held["parts"].items() if parts is None or int(part) in parts]
        reader = self.spark.read.schema(held["schema"])
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], held["schema"])

    def _part(self, key: str):
        return F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(self.BUCKETS)).cast("int")

    def _written(self, df: DataFrame, key: str, folder: str) -> dict[str, str]:
        """df written by part below a folder; the parts that have rows."""
        df.withColumn("_part", self._part(key)).repartition(F.col("_part"), F.pmod(F.xxhash64(*df.columns[:1]), F.lit(8))).write.partitionBy("_part").parquet(f"{self.base}/{folder}")
        where, fs = _located(self.spark, f"{self.base}/{folder}")
        names = (f.getPath().getName() for f in fs.listStatus(where))
        return {n.removeprefix("_part="): f"{folder}/{n}" for n in names if n.startswith("_part=")}

    def publish(self, tables: dict[str, DataFrame], keys: dict[str, str] | None = None) -> str:
        """Write a new version of all tables, check that each reads back, then move the pointer. keys: the column
        by which a table is parted (its first one)."""
        version, out = f"v-{uuid.uuid4().hex}", {}
        for name, df in tables.items():
            key = (keys or {}).get(name, df.columns[0])
            parts = self._written(df, key, f"{version}/{name}")
            schema = ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes)
            rows = self.spark.read.schema(schema).parquet(*[f"{self.base}/{p}" for p in parts.values()]).count() if parts else 0
            out[name] = {"key": key, "schema": schema, "rows": rows, "parts": parts}
        self._save("_current.json", {"version": version, "tables": out, "schema_version": SCHEMA_VERSION})
        return version

    def apply(self, new: dict[str, DataFrame], gone: DataFrame) -> str:
        """Replace documents: gone has one column, the key of those whose rows go from every table; new has the rows that
        come. Both must name the changed documents, and only the parts that hold them are written anew: a
        batch costs its own size and that of its parts. Readers see all of it or nothing."""
        current = self.pointer()
        version, out = f"v-{uuid.uuid4().hex}", dict(current["tables"])
        key = gone.columns[0]
        touched = {r[0] for r in gone.select(self._part(key)).distinct().collect()}  # at most BUCKETS numbers
        for df in new.values():
            touched |= {r[0] for r in df.select(self._part(key)).distinct().collect()}
        for name, held in current["tables"].items():
            if held["key"] != key:
                raise ValueError(f"{name} is parted by {held['key']}, the change by {key}")
            old = self.read(name, sorted(touched)).join(gone, key, "left_anti")
            df = old.unionByName(new[name].select(*old.columns)) if name in new else old
            kept = {p: folder for p, folder in held["parts"].items() if int(p) not in touched}
            out[name] = {**held, "parts": {**kept, **self._written(df, key, f"{version}/{name}")}}
        self._save("_current.json", {"version": version, "tables": out, "schema_version": SCHEMA_VERSION})
        return version

    def copy_to(self, other: str) -> Store:
        """A backup: the published tables written elsewhere, with numbers of rows that must agree."""
        current, target = self.pointer(), Store(self.spark, other)
        target.publish({name: self.read(name) for name in current["tables"]}, {name: t["key"] for name, t in current["tables"].items()})
        copied = target.pointer()["tables"]
        if any(copied[name]["rows"] != self.read(name).count() for name in current["tables"]):
            raise OSError("the copy differs from the source")
        return target

    def restore(self, backup: Store) -> str:
        """Publish a backup's tables here, after a safety copy of what stands here now; the safety copy's place."""
        safety = f"{self.base}-before-{uuid.uuid4().hex}"
        if self.pointer() is not None:
            self.copy_to(safety)
        there = backup.pointer()["tables"]
        self.publish({name: backup.read(name) for name in there}, {name: t["key"] for name, t in there.items()})
        return safety

    def move(self, other: str) -> Store:
        """Copy the tables, check the copy, then switch in one step: from then on this store reads there."""
        target = self.copy_to(other)
        self._save("_moved.json", {"base": target.base})
        return target
