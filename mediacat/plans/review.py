"""Review of dates in rounds: a further pattern only meets names that no pattern has dated yet."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from mediacat.functions import dates as D
from mediacat.functions import names as N
from mediacat.operators import dating
from mediacat.sources.scratch import Scratch


class DateReview:
    """Proposals of `dating.propose_dates` that patterns and exclusions are added to.

    A custom pattern goes before the built-in ones and after those added earlier, so rows that an earlier one has dated,
    and excluded ones, are settled: each round writes them apart and reads only the others, without another look at
    sidecars or tags. The result is that of propose_dates with all patterns. Counts come with the tables that are written.
    """

    def __init__(self, proposals: DataFrame, as_of_year: int, patterns: Iterable[D.CustomPattern] = ()) -> None:
        self.as_of_year, self.patterns, self.settled = as_of_year, list(patterns), []
        base = N.base_name(F.col("src_path"))
        self._next(proposals.withColumn("is_open", ~F.col("excluded") & D.custom_date(base, self.patterns).isNull()))

    def _next(self, rows: DataFrame) -> None:
        """Writes rows, with their settled part in a folder of its own, and counts them on the way."""
        seen, undated = Observation(), F.col("sidecar_time").isNull() & F.col("name_time").isNull()
        counts = [F.count(F.lit(1)).alias("rows"), F.count_if("is_open").alias("open"), F.count_if(undated).alias("unknown"), F.count_if(undated & F.col("is_open")).alias("open_unknown")]
        with Scratch(rows.sparkSession) as s:
            table = s.keep(rows.observe(seen, *counts), "review", by=["is_open"])
        self.settled.append(table.filter("NOT is_open").drop("is_open"))
        self.open, self.counts = table.filter("is_open").drop("is_open"), seen.get

    def unknown(self) -> DataFrame:
        """Open rows without a sidecar or name date, for groups and previews."""
        return dating.unknown_dates(self.open)

    def exclude(self, names: Iterable[str]) -> dict[str, int]:
        """Names, taken from those still unknown, that no pattern shall date; names that have a date keep it."""
        names = sorted(set(names) - {""})
        if names:
            known = self.open.sparkSession.createDataFrame([(n,) for n in names], "_base string")
            rows = self.open.join(F.broadcast(known), N.base_name(F.col("src_path")) == F.col("_base"), "left")
            hit = F.col("_base").isNotNull() & F.col("name_time").isNull()
            self._next(rows.withColumn("excluded", hit).withColumn("is_open", ~hit).drop("_base"))
        return self.counts

    def add(self, pattern: D.CustomPattern) -> dict[str, int]:
        """Dates the open rows that a pattern fits and returns the counts of the round: rows met, those still open and those
        unknown. A pattern that cannot be used changes nothing."""
        if pattern.usable():
            self.patterns.append(pattern)
            hit = F.col("_hit")
            rows = self.open.withColumn("_hit", pattern.date(N.base_name(F.col("src_path"))))
            rows = rows.withColumn("name_time", F.coalesce(hit, "name_time")).withColumn("tag_time", F.when(hit.isNull(), F.col("tag_time")))
            rows = rows.withColumn("_best", self._best()).withColumn("proposed", F.col("_best.ts")).withColumn("accuracy", F.col("_best.accuracy"))
            self._next(rows.withColumn("is_open", hit.isNull()).drop("_hit", "_best"))
        return self.counts

    def _best(self) -> Column:
        return D.best_date(F.col("sidecar_time"), F.col("name_time"), F.col("tag_time"), self.as_of_year)

    def proposals(self) -> DataFrame:
        """All rows with the dates of all rounds."""
        return reduce(DataFrame.unionByName, [*self.settled, self.open])
