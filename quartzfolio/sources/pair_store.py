"""A store of pair statistics in buckets that is brought up to date instead of computed anew.

Layout: `listings` has a number for every listing that was ever seen, the next ones for new
listings; `pairs/version=<v>/bucket=<number of the left listing modulo buckets>` the rows, each with the
ids of both series. Unchanged pairs are found by these ids alone, so that an update costs as much
as the listings' series and the changed pairs. Only buckets that gain, change or lose a pair are
written, each as a whole; one that holds nothing any more is removed. Rows for a bucket are written aside
first; an update that is cut off is repeated by the next one, as every row says what it was made of.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import blocks, identity
from ..operators.pairs import MAX_PAIRS, PAIR, STATISTICS, guarded
from .tables import files_of, read_rows, removed, write_rows

_KEYS = "series_left string, series_right string"
_ROWS = f"{STATISTICS}, {_KEYS}, version string, bucket int"


@dataclass
class PairStore:
    spark: SparkSession
    path: str
    version: str = "1"
    buckets: int = 128
    most: int = MAX_PAIRS

    def listings(self) -> DataFrame:
        return read_rows(self.spark, f"{self.path}/listings", "listing string, number long")

    def rows(self) -> DataFrame:
        """All pairs of this version."""
        return read_rows(self.spark, f"{self.path}/pairs", _ROWS).filter(F.col("version") == self.version)

    def files(self) -> set[str]:
        return files_of(self.spark, f"{self.path}/pairs/version={self.version}")

    def _aside(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/_aside/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _numbered(self, series: DataFrame) -> None:
        """Numbers for new listings, in their order, after those there are."""
        known = self.listings()
        first = known.agg(F.coalesce(F.max("number") + 1, F.lit(0)).alias("first"))  # one row
        new = series.join(known, "listing", "left_anti").join(F.broadcast(first))
        # `guarded` bounds the listings that this window numbers.
        place = F.row_number().over(Window.partitionBy().orderBy("listing")) - 1
        new = self._aside(new.select("listing", (F.col("first") + place).cast("long").alias("number")))
        new.coalesce(1).write.mode("append").parquet(f"{self.path}/listings")

    def wanted(self, series: DataFrame) -> DataFrame:
        """left < right by name, bucket (null where left has no number yet) and both series' ids, of all pairs of listings (listing, series_id)."""
        of = series.join(self.listings(), "listing", "left").select("listing", "number", "series_id")
        place = F.row_number().over(Window.partitionBy().orderBy("listing"))
        of = of.withColumns({"place": place, "n": F.count("*").over(Window.partitionBy())})
        # Each listing names the places behind its own, which are then joined by equality.
        left = of.filter("place < n").select(F.col("listing").alias("left"), F.pmod("number", F.lit(self.buckets)).cast("int").alias("bucket"), F.col("series_id").alias("series_left"), F.explode(F.sequence(F.col("place") + 1, F.col("n").cast("int"))).alias("place"))
        return left.join(of.select("place", F.col("listing").alias("right"), F.col("series_id").alias("series_right")), "place").drop("place")

    def compared(self, series: DataFrame) -> DataFrame:
        """left, right, bucket, was (the bucket of the stored row) and status: hit, stale, missing or gone; one pass over the store."""
        have = self.rows().select(*PAIR, F.col("series_left").alias("a"), F.col("series_right").alias("b"), F.col("bucket").alias("was"))
        d = self.wanted(series).join(have, PAIR, "full")
        same = (F.col("series_left") == F.col("a")) & (F.col("series_right") == F.col("b")) & (F.col("bucket") == F.col("was"))
        status = F.when(F.col("bucket").isNull(), "gone").when(F.col("was").isNull(), "missing").when(same, "hit").otherwise("stale")
        return d.select(*PAIR, "bucket", "was", "series_left", "series_right", status.alias("status"))

    def update(self, rets: DataFrame) -> DataFrame:
        """Brings the store up to the returns; bucket, status (kept, rewritten, removed), rows, fresh and dropped of each bucket."""
        series = self._aside(identity.series_ids(rets).select("listing", "series_id"))
        guarded(series.limit(int((2 * self.most) ** 0.5) + 3).count(), self.most)
        self._numbered(series)
        compared = self._aside(self.compared(series))
        changed = compared.filter("status != 'hit'")
        touched = [r.b for r in changed.select(F.explode(F.array_compact(F.array("bucket", "was"))).alias("b")).distinct().collect()]  # as many as buckets at most
        if touched:
            fresh = changed.filter("status IN ('stale', 'missing')")
            made = blocks.statistics(rets, most=self.most, listings=series, only=fresh.select(*PAIR))
            # A pair without a common date is kept with n = 0, so that it isn't tried again.
            made = fresh.select(*PAIR, "series_left", "series_right", "bucket").join(made, PAIR, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
            kept = self.rows().filter(F.col("bucket").isin(touched)).drop("version").join(compared.filter("status = 'hit'").select(*PAIR), PAIR, "left_semi")
            rows = self._aside(kept.unionByName(made).withColumn("version", F.lit(self.version)))
            filled = {r.bucket for r in rows.select("bucket").distinct().collect()}
            if filled:
                write_rows(rows.repartition("bucket"), f"{self.path}/pairs", ("version", "bucket"))
            for b in set(touched) - filled:
                removed(self.spark, f"{self.path}/pairs/version={self.version}/bucket={b}")
        return self._report(compared, touched)

    def _report(self, compared: DataFrame, touched: list[int]) -> DataFrame:
        rows = self.rows().groupBy("bucket").agg(F.count("*").alias("rows"))
        at = F.coalesce("bucket", "was")
        steps = compared.groupBy(at.alias("bucket")).agg(F.count_if(F.col("status").isin("stale", "missing")).alias("fresh"), F.count_if(F.col("status") == "gone").alias("dropped"))
        d = steps.join(rows, "bucket", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
        status = F.when(~F.col("bucket").isin(touched), "kept").when(F.col("rows") == 0, "removed").otherwise("rewritten")
        return self._aside(d.select("bucket", status.alias("status"), "rows", "fresh", "dropped"))

    def tidy(self) -> None:
        """Removes what was written aside; reports and comparisons made before can't be read any more."""
        removed(self.spark, f"{self.path}/_aside")

    def _of_buckets(self, wanted: DataFrame) -> DataFrame:
        """The stored rows of the buckets that wanted names: no other partition is read."""
        named = [r.bucket for r in wanted.select("bucket").distinct().collect() if r.bucket is not None]  # as many as buckets at most
        return self.rows().filter(F.col("bucket").isin(named))

    def selected(self, series: DataFrame) -> DataFrame:
        """left, right, bucket and status of each pair of a selection (listing, series_id): hit, stale or missing. Only the selection's buckets are read."""
        wanted = self.wanted(series)
        have = self._of_buckets(wanted).select(*PAIR, "bucket", F.col("series_left").alias("a"), F.col("series_right").alias("b"))
        d = wanted.join(have, [*PAIR, "bucket"], "left")
        same = (F.col("series_left") == F.col("a")) & (F.col("series_right") == F.col("b"))
        return d.select(*PAIR, "bucket", F.when(F.col("a").isNull(), "missing").when(same, "hit").otherwise("stale").alias("status"))

    def statistics_of(self, series: DataFrame) -> DataFrame:
        """The stored rows of a selection's pairs; raises where one is missing or stale, and computes none."""
        view = self._aside(self.selected(series))
        lack = view.filter("status != 'hit'").limit(20).collect()
        if lack:
            raise ValueError("not in the store: " + ", ".join(f"{r.left}/{r.right} ({r.status})" for r in lack))
        return self._of_buckets(view).drop("version", "bucket", "series_left", "series_right").join(view.select(*PAIR), PAIR, "left_semi")


def write_edges(edges: DataFrame, numbers: DataFrame, path: str, version: str, metric: str, buckets: int = 128) -> None:
    """Correlation edges by (version, metric, bucket of the left listing); a bucket without edges goes."""
    spark = edges.sparkSession
    at = f"{path}/version={version}/metric={metric}"
    rows = edges.join(numbers.withColumnRenamed("listing", "left"), "left").withColumn("bucket", F.pmod("number", F.lit(buckets)).cast("int")).drop("number")
    rows = rows.withColumns({"version": F.lit(version), "metric": F.lit(metric)})
    write_rows(rows.repartition("bucket"), path, ("version", "metric", "bucket"))
    filled = {f"bucket={r.bucket}" for r in rows.select("bucket").distinct().collect()}  # as many as buckets at most
    for stale in {f.split("/")[0] for f in files_of(spark, at) if f.startswith("bucket=")} - filled:
        removed(spark, f"{at}/{stale}")
