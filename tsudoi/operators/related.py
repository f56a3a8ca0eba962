"""Related events (J18) without comparing every pair.

An event is offered the four best others: same area first, then same municipality, then shared
category, then any; inside a tier shared category first, then the nearest schedule, then the lowest
id. Each tier is read from short lists (area, area+category, ...). Per list a top-k index over days
answers "which k events of this list are nearest to this span": overlaps through dyadic day blocks,
neighbours through the k next or previous start and end days. An index entry holds k ids at most, so
neither a popular list nor a popular day grows a row, and events with equal spans ask only once.
k = 8 is exact for four results: a fuller tier can hide at most three rows plus the event itself.

A source reads no list behind one that already holds four others, lists that nobody reads have no index, and of the members of
a list with equal spans only the k first stay: the index grows with lists and days, not with events.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsudoi.functions.text import blank_to_null, let, strip
from tsudoi.plans.ranking import top_k
from tsudoi.session import cut_lineage


SALTS = 16


def _place(c: str) -> Column:
    return blank_to_null(F.lower(strip(F.col(c))))


def _lists(events: DataFrame) -> DataFrame:
    """(id, tier, list, share): the lists an event belongs to, and as a source the lists it reads."""
    cats = F.array_distinct(F.filter(F.transform("category", lambda c: F.lower(strip(c))), lambda c: (c != "") & (c != "other")))
    step = events.select("id", _place("area").alias("a"), _place("municipality").alias("m"), F.coalesce(cats, F.array().cast("array<string>")).alias("c"))

    def entry(tier: int, share: bool, *parts: Column) -> Column:
        return F.struct(F.lit(tier).alias("tier"), F.concat_ws("|", F.lit(str(tier)), *parts).alias("list"), F.lit(share).alias("share"))

    def placed(tier: int, col: str) -> Column:
        own = F.concat(F.array(entry(tier, False, F.col(col))), F.transform("c", lambda c: entry(tier, True, F.col(col), c)))
        return F.when(F.col(col).isNotNull(), own)

    shared = F.transform("c", lambda c: entry(3, True, c))
    every = F.array(entry(4, False))
    return step.select("id", F.explode(F.flatten(F.array_compact(F.array(placed(1, "a"), placed(2, "m"), shared, every)))).alias("l")).select("id", "l.*")


_WALK = "struct<s:int,e:int,out:array<struct<lv:int,blk:int>>>"


def _blocks(first: Column, last: Column, levels: int) -> Column:
    """Dyadic blocks (level, block) that exactly cover [first, last]: per level an odd left end and an
    even right end are taken, then both ends move up one level; s > e ends the walk."""
    block = lambda lv, b: F.struct(lv.alias("lv"), b.alias("blk"))

    def step(acc: Column, lv: Column) -> Column:
        left = (acc.s <= acc.e) & (acc.s.bitwiseAND(1) == 1)
        right = (acc.s <= acc.e) & (acc.e.bitwiseAND(1) == 0)
        out = F.concat(acc.out, F.array_compact(F.array(F.when(left, block(lv, acc.s)), F.when(right, block(lv, acc.e)))))
        s, e = F.when(left, acc.s + 1).otherwise(acc.s), F.when(right, acc.e - 1).otherwise(acc.e)
        up = F.struct(F.shiftright(s, 1).alias("s"), F.shiftright(e, 1).alias("e"), out.alias("out"))
        over = F.struct(F.lit(1).alias("s"), F.lit(0).alias("e"), out.alias("out"))
        return F.when(s <= e, up).otherwise(over).cast(_WALK)

    start = F.struct(first.alias("s"), last.alias("e"), F.array().alias("out")).cast(_WALK)
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), start, step).out


def _ancestors(d: Column, levels: int) -> Column:
    return F.array(*[F.struct(F.lit(lv).alias("lv"), F.shiftright(d, lv).alias("blk")) for lv in range(levels)])


def _needed(reads: DataFrame, members: DataFrame, limit: int) -> DataFrame:
    """The lists a source has to read: those up to the first kind, in order of rank, of which one alone holds enough others."""
    kind = F.col("tier") * 2 - F.col("share").cast("int")
    full = members.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("list", F.lit(True).alias("full"))
    ranked = reads.join(full, "list", "left").withColumn("kind", kind)
    enough = ranked.where("full").groupBy("id").agg(F.min("kind").alias("enough"))
    return ranked.join(enough, "id", "left").where(F.col("enough").isNull() | (F.col("kind") <= F.col("enough"))).select("id", "tier", "list", "share")


def related_events(sources: DataFrame, pool: DataFrame, spans: DataFrame, limit: int = 4) -> DataFrame:
    """J18. (source_id, related_id, tier, shares_category, gap_days, rank).

    ``sources``/``pool``: id, area, municipality, category array; ``pool`` already without ended events.
    ``spans``: (event_id, span_start, span_end) of both."""
    k = 2 * limit  # as many as can be asked of one list, the source itself and repeated offers aside
    numbered = cut_lineage(spans.select(F.col("event_id").alias("id"), F.unix_date("span_start").alias("s"), F.unix_date("span_end").alias("e")).distinct())
    # blocks larger than the longest span never occur, so no index is kept above that level
    longest = numbered.agg(F.max(F.col("e") - F.col("s") + 1)).head()[0] or 1
    levels = int(longest).bit_length() + 1
    members = _lists(pool).select("id", "list").distinct()
    reads = cut_lineage(_needed(_lists(sources), members, limit))
    members = members.join(reads.select("list").distinct(), "list", "left_semi")
    # spans travel with the lists of their event and become a row for each list only where equal spans have met
    held = numbered.join(members.groupBy("id").agg(F.collect_list("list").alias("lists")), "id").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    met = held.repartition("s", "e", "salt").select(F.explode("lists").alias("list"), "s", "e", "salt", "id")
    some = top_k(met, ["list", "s", "e", "salt"], [F.col("id")], k).select("list", "s", "e", "id")
    dated = cut_lineage(top_k(some.repartition("list"), ["list", "s", "e"], [F.col("id")], k).select("list", "s", "e", "id"))

    # overlap index: spans covering a day (blocks of the span), spans starting in a block (blocks above the start)
    entries = dated.select("list", "id", F.explode(F.concat(
        F.transform(_blocks(F.col("s"), F.col("e"), levels), lambda b: F.struct(F.lit("cover").alias("kind"), b.lv.alias("lv"), b.blk.alias("blk"))),
        F.transform(_ancestors(F.col("s"), levels), lambda b: F.struct(F.lit("start").alias("kind"), b.lv.alias("lv"), b.blk.alias("blk"))))).alias("x"))
    block = ["list", "kind", "lv", "blk"]
    index = top_k(entries.select("list", "x.*", "id").distinct(), block, [F.col("id")], k).groupBy(*block).agg(F.collect_list("id").alias("ids"))

    asked = reads.join(numbered.withColumnsRenamed({"s": "qs", "e": "qe"}), "id").withColumnRenamed("id", "source_id")
    queries = cut_lineage(asked.select("list", "qs", "qe").distinct())

    probes = queries.select("list", "qs", "qe", F.explode(F.concat(
        F.transform(_ancestors(F.col("qs"), levels), lambda b: F.struct(F.lit("cover").alias("kind"), b.lv.alias("lv"), b.blk.alias("blk"))),
        F.transform(_blocks(F.col("qs"), F.col("qe"), levels), lambda b: F.struct(F.lit("start").alias("kind"), b.lv.alias("lv"), b.blk.alias("blk"))))).alias("x")).select("list", "qs", "qe", "x.*")
    # a query meets a few blocks of at most k ids each; ids stay in short arrays until the query is answered
    overlap = probes.join(index, block).groupBy("list", "qs", "qe").agg(
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k).alias("here"))

    def neighbours(edge: str, q: str, sign: int) -> DataFrame:
        """The k nearest ids beyond day ``q``: each list keeps k ids per edge day and, from every such
        day on, the k nearest; a query day first finds the next edge day."""
        per_day = top_k(dated.select("list", F.col(edge).alias("d"), "id").distinct(), ["list", "d"], [F.col("id")], k).groupBy("list", "d").agg(
            F.array_sort(F.collect_list("id")).alias("ids"))
        order = F.col("d") * sign
        ahead = Window.partitionBy("list").orderBy(order).rowsBetween(0, k - 1)
        reach = per_day.select("list", "d", F.slice(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("d").alias("d"), i.alias("id")))).over(ahead)), 1, k).alias("near"))
        marks = per_day.select("list", "d", F.col("d").alias("mark")).unionByName(
            queries.select("list", F.col(q).alias("d"), F.lit(None).cast("int").alias("mark"))).distinct()
        # walked from the far end, so the frame only grows: one pass instead of one per row
        later = Window.partitionBy("list").orderBy(-order).rangeBetween(Window.unboundedPreceding, -1)
        nearest = (F.min("mark") if sign > 0 else F.max("mark")).over(later)
        step = marks.withColumn("next", nearest).where(F.col("mark").isNull() & F.col("next").isNotNull()).select("list", F.col("d").alias(q), F.col("next").alias("d"))
        return step.join(reach, ["list", "d"]).select("list", q, F.transform("near", lambda n: F.struct(F.abs(n.d - F.col(q)).alias("gap"), n.id.alias("id"))).alias("by_" + edge))

    none = F.array().cast("array<struct<gap:int,id:bigint>>")
    answers = (queries.join(overlap, ["list", "qs", "qe"], "left").join(neighbours("s", "qe", 1), ["list", "qe"], "left").join(neighbours("e", "qs", -1), ["list", "qs"], "left"))
    offered = F.array_sort(F.concat(F.coalesce(F.transform("here", lambda i: F.struct(F.lit(0).alias("gap"), i.cast("long").alias("id"))), none),
                                    F.coalesce(F.col("by_s").cast("array<struct<gap:int,id:bigint>>"), none), F.coalesce(F.col("by_e").cast("array<struct<gap:int,id:bigint>>"), none)))
    # an id offered twice keeps its smallest gap, which comes first in the sorted array
    once = let(offered, lambda a: F.filter(a, lambda x, i: ~F.exists(F.slice(a, F.lit(1), i), lambda y: y.id == x.id)))
    best = answers.select("list", "qs", "qe", F.slice(once, 1, k).alias("near")).select("list", "qs", "qe", F.col("near.gap").alias("gaps"), F.col("near.id").alias("ids"))

    # events without dates rank last; for a source without dates every event does
    with_days = numbered.select("id").distinct()
    undated = top_k(members.join(with_days, "id", "left_anti"), ["list"], [F.col("id")], k, "_k").drop("_k")
    anyone = top_k(members, ["list"], [F.col("id")], k, "_k").drop("_k")
    no_gap = F.lit(None).cast("int").alias("gap")

    def late(readers: DataFrame, offered: DataFrame) -> DataFrame:
        return readers.withColumnRenamed("id", "source_id").join(offered, "list").select("source_id", "tier", "share", "id", no_gap)

    # all members of a list of the first kind are equally close, so none is hidden there but the source itself
    few = F.when((F.col("tier") == 1) & F.col("share"), limit + 1).otherwise(k)
    near = asked.join(best, ["list", "qs", "qe"]).select("source_id", "tier", "share", F.slice("gaps", F.lit(1), few).alias("gaps"), F.slice("ids", F.lit(1), few).alias("ids"))
    near = near.repartition("source_id").select("source_id", "tier", "share", F.explode(F.arrays_zip("ids", "gaps")).alias("n"))
    offers = (near.select("source_id", "tier", "share", F.col("n.ids").alias("id"), F.col("n.gaps").alias("gap"))
              .unionByName(late(reads.join(with_days, "id", "left_semi"), undated)).unionByName(late(reads.join(with_days, "id", "left_anti"), anyone)))
    merged = offers.where(F.col("id") != F.col("source_id")).groupBy("source_id", "id").agg(
        F.min("tier").alias("tier"), F.max("share").alias("share"), F.min("gap").alias("gap"))
    ranked = top_k(merged, ["source_id"], [F.col("tier"), F.col("share").desc(), F.col("gap").asc_nulls_last(), F.col("id")], limit, "rank")
    return ranked.select("source_id", F.col("id").alias("related_id"), "tier", F.col("share").alias("shares_category"), F.col("gap").alias("gap_days"), "rank")
