"""Import rules (C18) and slugs in use."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsudoi.functions.canon import suffixed_slug
from tsudoi.functions.text import blank_to_null, strip

YMD = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def draft_refusal(title: Column, source_url: Column, start: Column, end: Column) -> Column:
    """Why a new draft is refused; null when it is acceptable."""
    blank = lambda c: F.coalesce(strip(c), F.lit("")) == ""
    e = blank_to_null(strip(end))
    return (F.when(blank(title), "title is required").when(blank(source_url), "source_url is required")
            .when(blank(start), "start_date is required").when(~start.rlike(YMD), F.concat(F.lit("invalid start_date: "), start))
            .when(e.isNotNull() & ~e.rlike(YMD), F.concat(F.lit("invalid end_date: "), e)))


def settle_slugs(drafts: DataFrame, taken: DataFrame) -> DataFrame:
    """N7. drafts(seq, slug, source_url) with ``final_slug``, against taken(slug, source_url) and each other.

    The first draft of a slug that no other URL owns keeps it; every other one gets the suffix of its URL, and of
    those with one suffixed slug the first does. final_slug is null where that is taken too: the row can't be imported.
    Owners are one row per slug, so a slug that many rows share is one lookup."""
    owner = taken.where(F.col("slug").isNotNull()).groupBy("slug").agg(F.min("source_url").alias("_low"), F.max("source_url").alias("_high"))
    used = owner.select(F.col("slug").alias("_wanted"), F.lit(True).alias("_used"))
    first = drafts.groupBy("slug").agg(F.min("seq").alias("_first"))
    rows = drafts.join(first, "slug", "left").join(owner, "slug", "left")
    own = F.col("_low").isNull() | ((F.col("_low") == F.col("source_url")) & (F.col("_high") == F.col("source_url")))
    plain = F.coalesce((F.col("seq") == F.col("_first")) & own, F.lit(False))
    rows = rows.withColumn("_wanted", F.when(plain, F.col("slug")).otherwise(suffixed_slug(F.col("slug"), F.col("source_url"))))
    ahead = rows.groupBy("_wanted").agg(F.min("seq").alias("_ahead"))
    rows = rows.join(ahead, "_wanted", "left").join(used, "_wanted", "left")
    free = plain | (F.col("_used").isNull() & (F.col("seq") == F.col("_ahead")))
    return rows.withColumn("final_slug", F.when(free, F.col("_wanted"))).drop("_first", "_low", "_high", "_wanted", "_ahead", "_used")
