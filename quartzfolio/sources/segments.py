"""Immutable segments of observations, named by what they hold.

A segment's hash is a digest of its distinct rows, whatever their order. Its files are written under a
temporary name and renamed to one made of provider, dataset and hash; the manifest, a row of JSON
beside it, is renamed into place last. Publishing the same rows again finds the manifest and writes nothing.
Reading hashes the rows again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.identity import canonical_json, canonical_row, set_digest
from .tables import exists, moved, read_text, removed, write_text


def observation_id(df: DataFrame) -> Column:
    return F.sha2(canonical_row(**{c: F.col(f"`{c}`") for c in df.columns}), 256)


def segment_hash(df: DataFrame) -> tuple[str, int]:
    """The digest of the distinct rows, and their number."""
    ids = df.select(observation_id(df).alias("id")).distinct()
    r = ids.agg(set_digest(F.col("id")).alias("h"), F.count("*").alias("n")).first()
    return r.h, r.n


def publish(df: DataFrame, root: str, provider: str, dataset: str) -> dict:
    """Publishes the distinct rows of df; the manifest, with `written` false where the segment was there."""
    spark = df.sparkSession
    aside = f"{root}/_aside/{uuid.uuid4().hex}"
    df.dropDuplicates().write.parquet(aside)
    rows = spark.read.schema(df.schema).parquet(aside)
    digest, n = segment_hash(rows)
    if not n:
        removed(spark, aside)
        raise ValueError("a segment needs observations")
    import hashlib

    name = hashlib.sha256(canonical_json({"dataset": dataset, "provider": provider, "hash": digest}).encode()).hexdigest()
    at = f"{root}/{provider}/{dataset}/{name}"
    written = not exists(spark, f"{at}.json")
    if written:
        # Files without a manifest are left from a publication that was cut off, or another one's of the same rows.
        if not moved(spark, aside, at):
            removed(spark, at)
            moved(spark, aside, at)
        manifest = {"segment_id": name, "provider": provider, "dataset": dataset, "segment_hash": digest, "row_count": n, "schema": rows.schema.json()}
        write_text(spark, f"{root}/_aside/{name}.json", canonical_json(manifest))
        moved(spark, f"{root}/_aside/{name}.json", f"{at}.json")
    removed(spark, aside)
    return {**manifest_of(spark, root, provider, dataset, name), "written": written}


def manifest_of(spark: SparkSession, root: str, provider: str, dataset: str, name: str) -> dict:
    return json.loads(read_text(spark, f"{root}/{provider}/{dataset}/{name}.json"))


def read(spark: SparkSession, root: str, manifest: dict) -> DataFrame:
    """The rows of a segment; raises where they aren't what was published, or can't be read."""
    from pyspark.sql.types import StructType

    at = f"{root}/{manifest['provider']}/{manifest['dataset']}/{manifest['segment_id']}"
    rows = spark.read.schema(StructType.fromJson(json.loads(manifest["schema"]))).parquet(at)
    try:
        found = segment_hash(rows)
    except Exception as e:
        raise ValueError("the segment can't be read") from e
    if found != (manifest["segment_hash"], manifest["row_count"]):
        raise ValueError("the segment's rows aren't those that were published")
    return rows
