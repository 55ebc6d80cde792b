"""Directory chains as a graph: where they end, loop, break or are cut off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tiff import MAX_IFDS
from .ordered import written, written_alone


def followed(heads: DataFrame, links: DataFrame, most: int = MAX_IFDS) -> DataFrame:
    """(slide_id, position, offset, next_offset): the first `most` places of each slide's chain.

    heads (slide_id, offset): the first directory of a slide, 0 for none. links (slide_id,
    offset, next_offset): a row per directory; of repeated ones the least next_offset counts; 0 or null ends a chain. A place
    whose directory isn't among the links has a null next_offset and is the last. A loop is gone through
    again and again, as a reader does that only counts.

    By pointer doubling: what is reached in fewer than 2^k steps is joined with the links of 2^k
    steps, and these with themselves; so 100 places take seven rounds, whatever the number of slides. A
    directory has one link, so no join has a hot key.
    """
    one = links.filter("slide_id IS NOT NULL AND offset IS NOT NULL").groupBy("slide_id", "offset").agg(F.min(F.coalesce("next_offset", F.lit(0))).alias("next_offset"))
    one = written(one, "links")

    def walk() -> DataFrame:
        jump = one.filter("next_offset <> 0").select("slide_id", "offset", F.col("next_offset").alias("to"))
        reached = written(heads.filter("slide_id IS NOT NULL AND offset <> 0").groupBy("slide_id").agg(F.min("offset").alias("offset")).withColumn("position", F.lit(0)), "reached")
        step = 1
        while step < most:
            further = reached.join(jump, ["slide_id", "offset"]).select("slide_id", F.col("to").alias("offset"), (F.col("position") + step).alias("position"))
            reached = written(reached.union(further.filter(F.col("position") < most)), "reached")
            step *= 2
            if step < most:
                twice = jump.select("slide_id", F.col("offset").alias("start"), F.col("to").alias("offset")).join(jump, ["slide_id", "offset"])
                jump = written(twice.select("slide_id", F.col("start").alias("offset"), "to"), "jumps")
        return reached

    reached = written_alone(walk, heads.sparkSession, "walk")
    return reached.join(one, ["slide_id", "offset"], "left").select("slide_id", "position", "offset", "next_offset")


def outcomes(heads: DataFrame, links: DataFrame, most: int = MAX_IFDS) -> DataFrame:
    """(slide_id, length, outcome, loop_at, loop_length, shared): a row per slide of heads.

    length: the directories that are there, of the first `most` places. outcome: end, broken
    (the last link leads to no directory), loop (a directory comes again within `most` places), cut (as many as `most`, and no end seen), or
    empty. loop_at, loop_length: the place from which a loop runs, and its directories. shared:
    directories, of those reached, that several of the slide's directories link to."""
    walk = followed(heads, links, most)
    again = walk.groupBy("slide_id", "offset").agg(F.min("position").alias("first"), F.max("position").alias("last"), F.count("*").alias("times"))
    into = links.filter("next_offset <> 0").groupBy("slide_id", F.col("next_offset").alias("offset")).agg(F.countDistinct(links["offset"]).alias("n"))
    shared = again.join(into.filter("n > 1"), ["slide_id", "offset"], "left_semi").groupBy("slide_id").agg(F.count("*").alias("shared"))
    loops = again.groupBy("slide_id").agg(
        F.min(F.when(F.col("times") > 1, F.col("first"))).alias("loop_at"),
        # every directory of the loop that came twice tells its length
        F.min(F.when(F.col("times") > 1, ((F.col("last") - F.col("first")) / (F.col("times") - 1)).cast("int"))).alias("loop_length"),
    )
    per = walk.groupBy("slide_id").agg(F.count("next_offset").alias("length"), F.max_by(F.struct("next_offset"), "position").alias("end"))
    out = heads.filter("slide_id IS NOT NULL").select("slide_id").distinct().join(per, "slide_id", "left").join(loops, "slide_id", "left").join(shared, "slide_id", "left")
    outcome = (
        F.when(F.col("end").isNull(), "empty").when(F.col("loop_at").isNotNull(), "loop").when(F.col("end.next_offset").isNull(), "broken")
        .when(F.col("end.next_offset") == 0, "end").otherwise("cut")
    )
    return out.select("slide_id", F.coalesce("length", F.lit(0)).cast("int").alias("length"), outcome.alias("outcome"), "loop_at", "loop_length", F.coalesce("shared", F.lit(0)).cast("int").alias("shared"))
