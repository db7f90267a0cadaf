"""Reading and writing of stored tables: Parquet, JSON lines, CSV; merge, buckets, content ids."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _place(spark: SparkSession, path: str) -> tuple:
    """Hadoop's path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _place(spark, path)
    return fs.exists(where)


def removed(spark: SparkSession, path: str) -> None:
    where, fs = _place(spark, path)
    fs.delete(where, True)


def moved(spark: SparkSession, path: str, to: str) -> bool:
    """Renames; false where `to` is there already."""
    (a, fs), (b, _) = _place(spark, path), _place(spark, to)
    fs.mkdirs(b.getParent())
    return not fs.exists(b) and fs.rename(a, b)


def folders_of(spark: SparkSession, path: str) -> list[str]:
    where, fs = _place(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(where) if f.isDirectory()] if fs.exists(where) else []


def files_of(spark: SparkSession, path: str) -> set[str]:
    """The Parquet files below path, named from there; hidden folders left out."""
    where, fs = _place(spark, path)
    found = set()
    if fs.exists(where):
        base, each = len(fs.makeQualified(where).toString()) + 1, fs.listFiles(where, True)
        while each.hasNext():
            name = each.next().getPath().toString()[base:]
            if name.endswith(".parquet") and not any(x.startswith(("_", ".")) for x in name.split("/")):
                found.add(name)
    return found


def write_text(spark: SparkSession, path: str, text: str) -> None:
    where, fs = _place(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    where, fs = _place(spark, path)
    source = fs.open(where)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def read_rows(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Parquet, or JSON lines by suffix; a missing path is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    return reader.json(path) if path.endswith((".json", ".jsonl")) else reader.parquet(path)


def write_rows(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Overwrites; with partition columns only the partitions that df has."""
    w = df.write.mode("overwrite").partitionBy(*partition_by)
    if partition_by:
        w = w.option("partitionOverwriteMode", "dynamic")
    (w.json if path.endswith((".json", ".jsonl")) else w.parquet)(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def read_document(path: str) -> dict:
    return json.loads(Path(path).read_text())


def write_document(path: str, payload: dict) -> None:
    """Metadata of a run, with sorted keys; secrets are left out."""
    kept = {k: v for k, v in payload.items() if not any(s in k.lower() for s in ("token", "secret", "password", "api_key"))}
    Path(path).write_text(json.dumps(kept, sort_keys=True, indent=2))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """A CSV, a JSON list, or an object with a list under `responses` or `candidates`."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    d = spark.read.option("multiLine", True).json(path)
    for name in ("responses", "candidates"):
        if name in d.columns:
            return d.select(F.explode(name).alias("c")).select("c.*")
    return d


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """Union of both; for a key the new row wins, among equals the last by `order`."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = [F.desc("_new"), *([order.desc()] if order is not None else [])]
    w = Window.partitionBy(*keys).orderBy(*last)
    return both.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank", "_new")


def replace_rows(old: DataFrame, new: DataFrame, where: Column) -> DataFrame:
    """The rows of old outside `where`, and new: one portfolio's rows are exchanged."""
    return old.filter(~F.coalesce(where, F.lit(False))).unionByName(new)


def pruned(table: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the members alone; partitions are pruned where the table is stored by key."""
    return table.join(members.select(*keys).distinct(), keys, "left_semi")


def content_id(df: DataFrame, keys: list[str]) -> str:
    """A digest of all rows that doesn't depend on their order: count, sum and exclusive or of hashes."""
    row = F.xxhash64(*sorted(df.columns))
    r = df.select(row.alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x")).first()
    return f"{r.n:x}-{int(r.s or 0) & (1 << 64) - 1:x}-{(r.x or 0) & (1 << 64) - 1:x}"


def pending(inputs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What isn't in the manifest yet, by key and content."""
    return inputs.join(done, keys, "left_anti")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; on a local master a temporary folder where it names none."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="quartzfolio-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return spark.conf.get("spark.checkpoint.dir").rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call returns."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(spark: SparkSession, build):
    """build() with a checkpoint folder."""
    shared_dir(spark)
    return build()
