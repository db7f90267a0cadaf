"""Work by listing that is resumed where it was cut off.

Outputs are appended under an attempt's own name, and only then does the manifest name the attempt for each of
its listings, with a digest of what they were made of. Readers see an output only through the
manifest, so that one that was cut off in between is neither seen nor in the way: the next run
finds its listings pending. `vacuum` removes attempts that nothing names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import folders_of, pending, read_rows, removed

_MANIFEST = "listing string, content string, attempt string, place long"


@dataclass
class Resumable:
    """`schema` is that of the outputs, which have a column listing."""

    spark: SparkSession
    path: str
    schema: str

    def manifest(self) -> DataFrame:
        """listing, content and attempt: the last entry of each listing."""
        every = read_rows(self.spark, f"{self.path}/manifest", _MANIFEST)
        return every.groupBy("listing").agg(F.max_by(F.struct("content", "attempt"), F.struct("place", "attempt")).alias("x")).select("listing", "x.*")

    def pending(self, inputs: DataFrame) -> DataFrame:
        """The listings (listing, content) that the manifest hasn't with this content."""
        return pending(inputs.select("listing", "content"), self.manifest(), ["listing", "content"])

    def outputs(self) -> DataFrame:
        rows = read_rows(self.spark, f"{self.path}/data", f"{self.schema}, attempt string")
        return rows.join(self.manifest().select("listing", "attempt"), ["listing", "attempt"], "left_semi").drop("attempt")

    def run(self, inputs: DataFrame, build: Callable[[DataFrame], DataFrame]) -> int:
        """build(pending listings) for what isn't done; how many listings that were."""
        attempt = uuid.uuid4().hex
        todo_path = f"{self.path}/_todo/{attempt}"
        self.pending(inputs).write.parquet(todo_path)
        todo = read_rows(self.spark, todo_path, "listing string, content string")
        n = todo.count()
        if n:
            build(todo.select("listing")).write.parquet(f"{self.path}/data/attempt={attempt}")
            self._publish(todo, attempt)
        removed(self.spark, todo_path)
        return n

    def _publish(self, todo: DataFrame, attempt: str) -> None:
        place = read_rows(self.spark, f"{self.path}/manifest", _MANIFEST).agg(F.coalesce(F.max("place") + 1, F.lit(0)).cast("long").alias("place"))
        rows = todo.join(F.broadcast(place)).select("listing", "content", F.lit(attempt).alias("attempt"), "place")  # one row
        rows.write.mode("append").parquet(f"{self.path}/manifest")

    def vacuum(self) -> int:
        """Removes attempts that the manifest doesn't name any more; how many. Not to be called while another run is on."""
        named = {r.attempt for r in self.manifest().select("attempt").distinct().collect()}  # one for each run at most
        gone = [f for f in folders_of(self.spark, f"{self.path}/data") if f.startswith("attempt=") and f.removeprefix("attempt=") not in named]
        for f in gone:
            removed(self.spark, f"{self.path}/data/{f}")
        return len(gone)


def snapshot(quotes: DataFrame) -> DataFrame:
    """listing and content: its last date, that of all listings, and how many listings there are."""
    last = quotes.groupBy("listing").agg(F.max("date").alias("last"))
    every = last.agg(F.max("last").alias("latest"), F.count("*").alias("n"))  # one row
    return last.join(F.broadcast(every)).select("listing", F.concat_ws("|", *(F.col(c).cast("string") for c in ("last", "latest", "n"))).alias("content"))


def delta_windows(stored: DataFrame, selection: DataFrame, end: str) -> DataFrame:
    """dataset, listing, start_date, end_date: from the day before the last stored date, or from the beginning ('').

    stored has dataset, listing and date; the selection's listings are wanted of each dataset (dataset, listing).
    """
    last = stored.groupBy("dataset", "listing").agg(F.max("date").alias("last"))
    d = selection.select("dataset", "listing").join(last, ["dataset", "listing"], "left")
    return d.select("dataset", "listing", F.coalesce(F.date_sub("last", 1).cast("string"), F.lit("")).alias("start_date"), F.lit(end).alias("end_date"))
