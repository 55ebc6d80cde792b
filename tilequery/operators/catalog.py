"""Slide catalogs: listing, search and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import is_slide_file
from .ordered import numbered

DEFAULT_LIMIT = 100
#: Tasks that the slides of one search are dealt over.
SALTS = 64
#: Searches that share a prefix and a text go to slides in lists of about so many.
LISTED = 8192
#: Strings of searches that are handed to all tasks at most; more are joined by merge.
HANDED = 100_000


def scan(spark: SparkSession, path: str) -> DataFrame:
    """slides(slide_id, size, mtime) of a folder or bucket; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("slide_id"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def matching(slides: DataFrame, prefix: str | None = None, search: str | None = None) -> DataFrame:
    """Slide files with the prefix (as it is) whose id holds the search text (in any case)."""
    out = slides.filter(is_slide_file(F.col("slide_id")))
    if prefix:
        out = out.filter(F.col("slide_id").startswith(prefix))
    return out.filter(F.contains(F.lower("slide_id"), F.lower(F.lit(search)))) if search else out


def page(slides: DataFrame, limit: int = DEFAULT_LIMIT, cursor: str | None = None, prefix: str | None = None, search: str | None = None, page_first: bool = False) -> DataFrame:
    """A page in key order, with next_cursor (null on the last page).

    page_first takes the page before the suffix and search filters, as object stores do; a
    page can then be short though more follow. A top-k of limit + 1 rows, no full sort.
    """
    limit = max(1, min(1000, limit))
    rows = slides.filter(F.col("slide_id").startswith(prefix)) if prefix else slides
    if not page_first:
        rows = matching(slides, prefix, search)
    if cursor:
        rows = rows.filter(F.col("slide_id") > cursor)
    got = rows.orderBy("slide_id").limit(limit + 1)
    of = got.agg(F.count("*").alias("n"), F.sort_array(F.collect_list("slide_id")).alias("ids"))
    of = of.select(F.slice("ids", 1, limit).alias("ids"), F.when(F.col("n") > limit, F.get("ids", F.lit(limit - 1))).alias("next_cursor"))
    out = of.select(F.explode("ids").alias("slide_id"), "next_cursor")
    return matching(out, None, search) if page_first else out


def pages(slides: DataFrame, limit: int = DEFAULT_LIMIT, prefix: str | None = None, search: str | None = None) -> DataFrame:
    """Every page of a listing at once: slide_id, page (from 0), position (in the page) and next_cursor (null on the last page).

    As page() called again and again with its cursor gives them. Keys are ranked by ranges, no task sorts them all.
    Repeated keys are places of their own; null keys are no slides."""
    limit = max(1, min(1000, limit))
    rows = numbered(matching(slides.select("slide_id"), prefix, search).withColumn("tie", F.monotonically_increasing_id()), "slide_id", "tie").select("slide_id", "idx")
    rows = rows.select("slide_id", F.floor(F.col("idx") / limit).alias("page"), (F.col("idx") % limit).alias("position"))
    ends = rows.groupBy("page").agg(F.max("slide_id").alias("last"))
    # a page has a cursor if there is a next one
    followed = ends.select((F.col("page") - 1).alias("page"), F.lit(True).alias("followed"))
    cursors = ends.join(followed, "page", "left").select("page", F.when(F.col("followed"), F.col("last")).alias("next_cursor"))
    return rows.join(cursors, "page").select("slide_id", "page", "position", "next_cursor")


def postings(slides: DataFrame, size: int = 3) -> DataFrame:
    """(gram, slide_id): the distinct strings of `size` characters of each id in lower case; ids that are shorter stand under themselves."""
    low = F.lower("slide_id")
    grams = F.transform(F.sequence(F.lit(1), F.length(low) - size + 1), lambda i: F.substr(low, i, F.lit(size)))
    own = F.when(F.length(low) >= size, F.array_distinct(grams)).otherwise(F.array(low))
    return slides.select("slide_id", F.explode(own).alias("gram"))


def searched(slides: DataFrame, searches: DataFrame, size: int = 3) -> DataFrame:
    """(search_id, slide_id): for each search (search_id, prefix, search) the slide files that matching() gives.

    A null or empty prefix or search asks for nothing. Searches of the same prefix and text are one condition, and conditions are
    matched, not searches. A text is looked up by the rarest of its strings of `size` characters
    in the postings of the ids, then by the text itself; a prefix by its own first characters, of ids cut to
    as many; a text shorter than that, by postings of its own length. So each condition meets only ids that
    share its key, by an equi-join; one that asks for nothing at all meets every id, as it must.
    Last, each matched id is sent the lists of searches with its condition, and only there a row for each is made.
    Searches without any condition give a row for each slide and search, so the result can be far larger than the tables.
    """
    files = slides.select("slide_id").distinct().filter(is_slide_file(F.col("slide_id")))
    own = searches.select("search_id", F.coalesce("prefix", F.lit("")).alias("prefix"), F.lower(F.coalesce("search", F.lit(""))).alias("text")).distinct()
    conditions = own.select("prefix", "text").distinct()
    has_text, has_prefix = F.col("text") != "", F.col("prefix") != ""
    # some numbers of the searches: lengths, and how much there is to hand out
    told = conditions.agg(
        F.sort_array(F.collect_set(F.when(has_text, F.least(F.length("text"), F.lit(size))))).alias("sizes"), F.sort_array(F.collect_set(F.when(~has_text & has_prefix, F.length("prefix")))).alias("lengths"),
        F.sum(F.length("text")).alias("letters"), F.count_if(~has_text & has_prefix).alias("prefixes"), F.count_if(~has_text & ~has_prefix).alias("empty"),
    ).first()
    per = own.groupBy("search_id").count().agg(F.sum("count").alias("searches"), F.max("count").alias("most")).first()
    handed = lambda df, n: F.broadcast(df) if (n or 0) <= HANDED else df.hint("merge")
    fits = F.col("slide_id").startswith(F.col("prefix")) & F.contains(F.lower("slide_id"), F.col("text"))
    none = files.filter(F.lit(False)).select(F.lit("").alias("prefix"), F.lit("").alias("text"), "slide_id")

    # conditions with a text
    matched = none
    if told["sizes"]:
        low = F.lower("slide_id")
        each = files.select("slide_id", F.explode(F.array(*[F.lit(n) for n in told["sizes"]])).alias("n"))
        grams = each.select("slide_id", F.explode(F.when(F.length(low) >= F.col("n"), F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - F.col("n") + 1), lambda i: F.substr(low, i, F.col("n")))))).alias("gram"))
        by_text = conditions.filter(has_text).withColumn("n", F.least(F.length("text"), F.lit(size)))
        asked = by_text.select("*", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - F.col("n") + 1), lambda i: F.substr("text", i, F.col("n"))))).alias("gram"))
        often = grams.join(handed(asked.select("gram").distinct(), told["letters"]), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("often"))
        rarest = asked.join(often.hint("merge"), "gram", "left").groupBy("prefix", "text").agg(F.min_by("gram", F.struct(F.coalesce("often", F.lit(0)), "gram")).alias("gram"))
        matched = matched.union(grams.join(handed(rarest, told["letters"]), "gram").filter(fits).select("prefix", "text", "slide_id"))

    # conditions with a prefix only
    if told["lengths"]:
        heads = files.select("slide_id", F.explode(F.array(*[F.when(F.length("slide_id") >= n, F.substring("slide_id", 1, n)) for n in told["lengths"]])).alias("prefix"))
        by_prefix = conditions.filter(~has_text & has_prefix)
        matched = matched.union(heads.join(handed(by_prefix, told["prefixes"]), "prefix").select("prefix", "text", "slide_id"))
    if told["empty"]:
        matched = matched.union(files.select(F.lit("").alias("prefix"), F.lit("").alias("text"), "slide_id"))

    # rows of a condition's searches
    several = F.count("*").over(Window.partitionBy("search_id")) > 1
    place = F.pmod(F.xxhash64("search_id"), F.lit(-(-(per["searches"] or 1) // LISTED)))
    lists = own.withColumn("several", several).groupBy("prefix", "text", "several", place.alias("place")).agg(F.collect_list(F.struct("search_id")).alias("of"))
    ids = F.transform("of", lambda s: s["search_id"])  # a null id too
    lists = lists.select("prefix", "text", "several", ids.alias("ids"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = matched.withColumn("salt", F.pmod(F.xxhash64("slide_id"), F.lit(SALTS)).cast("int"))
    key = ["prefix", "text", "salt"]
    # so many tasks whatever the tables' size, as the rows are made after the join
    met = dealt.repartition(SALTS, *key).join(lists.repartition(SALTS, *key).hint("merge"), key)
    found = met.select("several", "slide_id", F.explode("ids").alias("search_id"))
    pairs = lambda df: df.select("search_id", "slide_id")
    if (per["most"] or 0) <= 1:
        return pairs(found)
    # a search of several conditions can find a slide by each
    return pairs(found.filter(~F.col("several"))).union(pairs(found.filter("several")).distinct())


def connectivity(slides: DataFrame) -> DataFrame:
    """Slide files among the first thousand keys."""
    return slides.orderBy("slide_id").limit(1000).agg(F.count_if(is_slide_file(F.col("slide_id"))).alias("slides"))
