"""First come, first served over keys, where only winners hold their keys."""
from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsudoi.operators.components import components
from tsudoi.session import cut_lineage, looked_up

FOLD_ROWS = 200_000


def in_turn(claims: Iterable[tuple[int, str]], near: Iterable[tuple[str, str]] | None) -> dict[int, bool]:
    """The loop itself. claims in order of seq; a winner bars its own keys, or those that ``near`` names beside them."""
    beside: dict[str, list[str]] = {}
    for a, b in near or ():
        beside.setdefault(b, []).append(a)
    won: dict[int, bool] = {}
    barred: set[str] = set()
    mine: list[str] = []
    now = None

    def settle() -> None:
        won[now] = barred.isdisjoint(mine)
        if won[now]:
            for key in mine:
                barred.update((key,) if near is None else beside.get(key, ()))
    for seq, key in claims:
        if seq != now and now is not None:
            settle()
            mine = []
        now = seq
        mine.append(key)
    if now is not None:
        settle()
    return won


def held_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(seq, place, key): the keys a row holds in the columns ``keys``, with the place of the column among them, from 1."""
    each = F.array(*[F.struct(F.lit(n).alias("place"), F.col(c).alias("key")) for n, c in enumerate(keys, 1)])
    return rows.select("seq", F.explode(each).alias("k")).select("seq", "k.*").where(F.col("key").isNotNull())


def early_claims(rows: DataFrame, near: DataFrame, group: str, keys: Sequence[str], fold_rows: int = FOLD_ROWS) -> tuple[DataFrame, DataFrame]:
    """rows(seq, group, *keys), written: (seq) of sure winners and the rows that are open still, to be settled by ``first_claims``.

    A row stands in the way of later rows whose group is ``near`` its own (a, b; symmetric, and a group near itself) and of those that hold
    one of its keys in the same column. An open row before all open rows in whose way it could stand is sure to win, and those
    are sure to lose. Where many rows have few groups, winners are few, so the rows are read for each round and not moved; only those
    still open are written. Ends when a task can fold what is open, or when a round settles less than half of it.
    """
    won, before = rows.select("seq").limit(0), None
    while True:
        firsts = cut_lineage(rows.groupBy(group).agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n")))
        size = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if size == 0 or before is not None and (size * (len(keys) + 1) <= fold_rows or size > before / 2):
            return won, rows
        before = size
        least = near.join(firsts.select(F.col(group).alias("b"), "seq"), "b").groupBy(F.col("a").alias(group)).agg(F.min("seq").alias("_least"))
        heads = cut_lineage(firsts.join(least, group, "left").where("_least IS NULL OR _least >= seq").select(group, "seq"))
        heads = cut_lineage(rows.join(looked_up(heads), [group, "seq"], "left_semi"))
        wanted = held_keys(heads, keys)
        asked = cut_lineage(wanted.select("place", "key").distinct())
        earliest = held_keys(rows, keys).join(looked_up(asked), ["place", "key"]).groupBy("place", "key").agg(F.min("seq").alias("_least"))
        late = wanted.join(earliest, ["place", "key"]).where("_least < seq").select("seq").distinct()
        sure = cut_lineage(heads.join(late, "seq", "left_anti"))
        won = cut_lineage(won.unionByName(sure.select("seq")))
        barred = {"seq": sure.select("seq"), group: near.join(sure.select(F.col(group).alias("b")), "b").select(F.col("a").alias(group)),
                  **{c: sure.where(F.col(c).isNotNull()).select(c) for c in keys}}
        for column, values in barred.items():
            rows = rows.join(looked_up(cut_lineage(values.distinct())), column, "left_anti")
        rows = cut_lineage(rows)


def first_claims(rows: DataFrame, keys: DataFrame, near: DataFrame | None = None, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """(seq, won): a row wins iff no earlier *winner* holds one of its keys. rows(seq), keys(seq, key).

    ``near(a, b)``, symmetric, says which keys stand in each other's way; by default a key only stands in its own. As
    in a loop over the rows in order of seq, a row that lost blocks nobody.

    Rows without a rival win at once. The others fall into components that share no key: each is settled by the loop
    itself in one pass, many components to a task of about ``fold_rows`` claims, so a chain of rows costs no more jobs than a
    pair. If all claims together are no more than that, they are one task and components aren't looked for. Only a
    component beyond it is settled by rounds over the whole of it.
    """
    keys = cut_lineage(keys.where(F.col("key").isNotNull()).select("seq", "key").distinct())
    near = None if near is None else cut_lineage(near.select("a", "b").distinct())
    held = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    if near is None:
        crowd = held.select("key", (F.col("n") - 1).alias("others"))
    else:
        crowd = near.join(held.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.sum(F.col("n") - (F.col("a") == F.col("b")).cast("long")).alias("others"))
    rivals = keys.join(crowd.where("others > 0").select("key"), "key", "left_semi").select("seq").distinct()
    claims = cut_lineage(keys.join(rivals, "seq", "left_semi"))
    some = None if near is None else cut_lineage(near.join(claims.select(F.col("key").alias("a")).distinct(), "a", "left_semi"))
    size = claims.count() + (0 if some is None else some.count())
    settled = cut_lineage(_folded(claims, some, size, fold_rows))  # callers read it several times
    return rows.select("seq").distinct().join(settled, "seq", "left").select("seq", F.coalesce("won", F.lit(True)).alias("won"))


def _folded(claims: DataFrame, near: DataFrame | None, size: int, fold_rows: int) -> DataFrame:
    if size <= fold_rows:
        one = F.lit(0)
        return _fold(claims.withColumn("task", one), None if near is None else near.withColumn("task", one))
    code = F.xxhash64("key").alias("code")
    least = claims.groupBy("seq").agg(F.min(F.xxhash64("key")).alias("a"))
    links = claims.select("seq", code).join(least, "seq").select("a", F.col("code").alias("b"))
    if near is not None:
        links = links.unionByName(near.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")))
    root = components(links)
    placed = claims.withColumn("node", F.xxhash64("key")).join(root, "node", "left").select("seq", "key", F.coalesce("root", "node").alias("root"))
    placed = cut_lineage(placed)
    around = None if near is None else near.withColumn("node", F.xxhash64("a")).join(root, "node", "left").select("a", "b", F.coalesce("root", "node").alias("root"))
    sizes = placed.select("root") if around is None else placed.select("root").unionAll(around.select("root"))
    large = cut_lineage(sizes.groupBy("root").count().where(F.col("count") > fold_rows).select("root"))
    task = F.pmod(F.xxhash64("root"), F.lit(-(-size // fold_rows)))
    small = placed.join(large, "root", "left_anti").withColumn("task", task)
    out = _fold(small, None if around is None else around.join(large, "root", "left_anti").withColumn("task", task))
    if large.isEmpty():
        return out
    return out.unionByName(_rounds(placed.join(large, "root", "left_semi").select("seq", "key"), near))


def _fold(claims: DataFrame, near: DataFrame | None) -> DataFrame:
    """claims(task, seq, key), near(task, a, b): the loop in each task."""
    def table(won: dict[int, bool]) -> pa.Table:
        return pa.table({"seq": pa.array(list(won), pa.int64()), "won": pa.array(list(won.values()), pa.bool_())})

    def pairs(part: pa.Table, a: str, b: str) -> Iterable[tuple]:
        return zip(part.column(a).to_pylist(), part.column(b).to_pylist())
    ordered = claims.select("task", F.col("seq").cast("long").alias("seq"), "key")
    if near is None:
        return ordered.groupBy("task").applyInArrow(lambda part: table(in_turn(pairs(part.sort_by("seq"), "seq", "key"), None)), "seq long, won boolean")
    return (ordered.groupBy("task").cogroup(near.select("task", "a", "b").groupBy("task"))
            .applyInArrow(lambda part, beside: table(in_turn(pairs(part.sort_by("seq"), "seq", "key"), list(pairs(beside, "a", "b")))), "seq long, won boolean"))


def _rounds(keys: DataFrame, near: DataFrame | None) -> DataFrame:
    """Each round settles every row that an earlier winner blocks and every row with no earlier open row beside it, the
    first open row at least, until none is open: a few aggregates over (row, key), rows of one key are never paired."""
    keys = cut_lineage(keys)
    state = keys.select(F.col("seq").cast("long").alias("seq"), F.lit(None).cast("boolean").alias("won")).distinct()
    while True:
        held = keys.join(state, "seq").groupBy("key").agg(F.min(F.when(F.col("won"), F.col("seq"))).alias("w"), F.min(F.when(F.col("won").isNull(), F.col("seq"))).alias("u"))
        if near is not None:
            held = near.join(held.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("w").alias("w"), F.min("u").alias("u"))
        beside = keys.join(held, "key").groupBy("seq").agg(F.min("w").alias("w"), F.min("u").alias("u"))
        won = (F.when(F.col("won").isNotNull(), F.col("won")).when(F.col("w") < F.col("seq"), F.lit(False))
               .when(F.coalesce(F.col("u") >= F.col("seq"), F.lit(True)), F.lit(True)))
        state = cut_lineage(state.join(beside, "seq", "left").select("seq", won.alias("won")))
        if state.where(F.col("won").isNull()).isEmpty():
            return state
