"""Aligning the frames of several modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGE = 65_536


def frame_sync(frames: DataFrame, n_modules: int) -> DataFrame:
    """(idx, frame_number) of ``frames(module, frame_number)``: for every position in the modules' series the
    smallest number that all modules have and that is not below any module's number there.

    Positions without such a number are left out (a reader would have run out of frames). Numbers
    are split into ranges of ``RANGE``: a module's series is ranked range by range, after the frames
    of its earlier ranges, and the search for the next common number is a running minimum in each
    range; a range without a common number takes that of the next. So no task holds a whole series.
    Rows with a null are left out, and repeated rows count once.
    """
    ranged = frames.select("module", "frame_number").na.drop().distinct().withColumn("range", F.floor(F.col("frame_number") / RANGE))
    # one row a module and range
    earlier = Window.partitionBy("module").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("module", "range").agg(F.count("*").alias("n")).select("module", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("module", "range").orderBy("frame_number")
    ranked = ranged.withColumn("inner", F.row_number().over(inside).cast("long") - 1)
    placed = ranked.join(before, ["module", "range"]).select("module", "frame_number", (F.col("before") + F.col("inner")).alias("idx"))
    reached = placed.groupBy("idx").agg(F.max("frame_number").alias("at_least"), F.count("*").alias("n")).where(F.col("n") == n_modules)
    common = ranged.groupBy("frame_number").agg(F.count("*").alias("n")).where(F.col("n") == n_modules).select("frame_number")
    events = reached.select(F.col("at_least").alias("key"), "idx", F.lit(None).cast("long").alias("common")).unionByName(common.select(F.col("frame_number").alias("key"), F.lit(None).cast("long").alias("idx"), F.col("frame_number").alias("common")))
    events = events.withColumn("range", F.floor(F.col("key") / RANGE))
    following = Window.partitionBy("range").orderBy("key").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    found = events.withColumn("next", F.min("common").over(following))
    # one row a range: the first common number of any later range
    firsts = events.groupBy("range").agg(F.min("common").alias("first"))
    later = Window.orderBy("range").rowsBetween(1, Window.unboundedFollowing)
    ranges = firsts.select("range", F.min("first").over(later).alias("later"))
    joined = found.where("idx IS NOT NULL").join(ranges, "range")
    return joined.select("idx", F.coalesce("next", "later").alias("frame_number")).where("frame_number IS NOT NULL")
