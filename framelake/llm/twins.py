"""Rows of equal digests, without a shuffle of the rows whose digest stands alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Members, cut, join_with_hot_keys
from .exact_dedup import repeated_fingerprints


class Twins:
    """The digests that a checkpointed table (digest, print, value) has more than once.

    print: a long that follows from the digest.  ``groups`` has (digest, best, n) of
    every repeated digest, best its smallest or largest value that is not null.
    """

    def __init__(self, rows: DataFrame, digest: str, print: str, value: str, pick: Callable[[str], Column]):
        self.digest, self.print = digest, print
        repeated = cut(repeated_fingerprints(rows, print, rows.count()))
        self.members = Members(repeated, "fingerprint")
        self.total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        found = self.members.possibly(rows, print).groupBy(digest).agg(pick(value).alias("best"), F.count(F.lit(1)).alias("n"))
        self.groups = cut(found.where("n > 1").select(digest, "best", "n"))

    def beside(self, rows: DataFrame) -> DataFrame:
        """rows (with digest and print) with best, null where the digest stands alone; few other rows are shuffled, and no hot digest."""
        doubtful = join_with_hot_keys(self.members.possibly(rows, self.print), self.groups, [self.digest], "n", self.total)
        return self.members.surely_not(rows, self.print).withColumn("best", F.lit(None).cast(self.groups.schema["best"].dataType)).unionByName(doubtful.drop("n"))
