"""Balanced label propagation: linked documents move to their neighbours' shard under quotas."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import running
from .scratch import Scratch

#: Cells with more than this part of all rows are looked up by broadcast: there are fewer of them than this number.
HOT = 1024
#: Ranks of one key that meet their ranges in one group.
SLICE = 10_000


def allowed_moves(sizes: list[int], wanted: dict[tuple[int, int], int], capacity: int) -> dict[tuple[int, int], int]:
    """The part of the wanted moves between shards after which no shard exceeds ``capacity``.

    Inflows of an overfull shard shrink until all fit. Shrinking them leaves
    rows where they were, so the loop repeats; it ends at no move at all,
    which fits whenever the start did.
    """
    n, moves = len(sizes), np.zeros((len(sizes), len(sizes)), np.int64)
    for (a, b), m in wanted.items():
        moves[a, b] = m
    for _ in range(200):
        after = np.array(sizes) + moves.sum(0) - moves.sum(1)
        over = np.flatnonzero(after > np.maximum(capacity, np.array(sizes)))
        if not len(over):
            return {(a, b): int(moves[a, b]) for a in range(n) for b in range(n) if moves[a, b]}
        for b in over:
            inflow = moves[:, b].sum()
            moves[:, b] = np.floor(moves[:, b] * max(0.0, 1 - (after[b] - capacity) / max(inflow, 1))).astype(np.int64)
    return {}


def _fill(groups: list[tuple[int, int, int]], quota: list[int], rule: str, large: str) -> tuple[int, list[tuple[int, int, int, int]], list[tuple[int, int, dict[int, int]]]]:
    """One order of filling shards; see ``group_places``."""
    room, at, whole, loose, failed = list(quota), {}, [], [], 0

    def put(home: int, size: int, k: int, count: int) -> None:
        room[k] -= size * count
        whole.append((home, size, count, k))

    def part(rows: int, into: dict[int, int]) -> None:
        while rows:
            k = max(range(len(room)), key=lambda k: (room[k], -k))
            n = min(rows, room[k])
            into[k], room[k], rows = into.get(k, 0) + n, room[k] - n, rows - n

    queue = defaultdict(list)
    for home, size, count in groups:
        if size <= max(quota):
            queue[size].append((home, count, None))
            continue
        for _ in range(count):
            rest, into = size, {}
            while large != "last" and (free := [k for k in range(len(room)) if 0 < room[k] == quota[k] <= rest]):
                k = home if home in free else free[0]
                into[k], room[k], rest = room[k], 0, rest - room[k]
            loose.append((home, size, into))
            if large == "first" and 0 < rest:
                queue[rest].append((home, 1, into))
            else:
                at[id(into)] = rest
    for size in sorted(queue, reverse=True):
        left = []
        for home, count, into in sorted(queue[size], key=lambda x: (x[2] is not None, x[0])):
            n = min(count, room[home] // size) if rule == "home" and into is None else 0
            if n:
                put(home, size, home, n)
            left.append((home, count - n, into))
        for home, count, into in left:
            while count:
                fits = [k for k in range(len(room)) if room[k] >= size]
                if not fits:
                    break
                if into is not None:
                    k = min(fits, key=lambda k: (room[k], k))
                    into[k], room[k], count = into.get(k, 0) + size, room[k] - size, 0
                elif rule == "tight":
                    k = min(fits, key=lambda k: (room[k], k))
                    n = min(count, room[k] // size)
                    put(home, size, k, n)
                    count -= n
                else:
                    k, *others = sorted(fits, key=lambda k: (-room[k], k))
                    n = min(count, room[k] // size, max(1, count // len(room), (room[k] - room[others[0]]) // size if others else count))
                    put(home, size, k, n)
                    count -= n
            if into is not None:
                at[id(into)] = size * count
            else:
                failed += count
                for _ in range(count):
                    loose.append((home, size, {}))
                    at[id(loose[-1][2])] = size
    for _, _, into in loose:
        part(at.get(id(into), 0), into)
    return failed, whole, loose


def group_places(groups: list[tuple[int, int, int]], quota: list[int]) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, dict[int, int]]]]:
    """Shards for ``groups`` (home shard, rows, how many such groups), so that none gets more than its quota.

    Returns whole groups (home, rows, how many, shard) and parted ones (home,
    rows, rows by shard). Largest first, a group stays at home or goes to the
    shard with most room; single rows come after all groups, so their room is
    free for any. Only groups above the largest quota must be parted; another
    one is parted where no shard has that much room left, when less than its
    size times the number of shards is still to be placed. As that depends on
    the order, other orders are tried too (tightest shard first; rests of the
    large groups, or all their rows, last), and the one with fewest such groups is taken.
    """
    groups = sorted(groups, key=lambda g: (-g[1], g[0]))
    best = None
    for rule in ("home", "tight", "wide"):
        for large in ("first", "rest last", "last"):
            tried = _fill(groups, quota, rule, large)
            if best is None or tried[0] < best[0]:
                best = tried
            if not best[0]:
                return best[1:]
    return best[1:]


def _look_up(rows: DataFrame, cells: DataFrame, total: int, values: list[str]) -> DataFrame:
    """``rows`` with ``values`` of their cell in ``cells(link, shard, n, *values)``, null where it has none; ``n`` counts the cell's rows.

    Of ``total`` rows, cells of more than a ``HOT``-th are fewer than ``HOT``,
    so those are broadcast, and their rows and those without a link are dealt
    by id. So no key of the shuffle has more rows than a ``HOT``-th, provided
    that ``cells`` has every cell above that.
    """
    names = rows.columns
    is_hot = F.col("n") * HOT > total
    hot = cells.filter(is_hot).select("link", "shard", F.lit(1).alias("hot_"), *[F.col(v).alias(f"hot_{v}") for v in values])
    cold = cells.filter(~is_hot).select(F.lit(0).alias("apart_"), F.col("link").alias("link_"), F.col("shard").alias("shard_"), *values)
    apart = F.col("hot_").isNotNull() | F.col("link").isNull()
    met = rows.join(F.broadcast(hot), ["link", "shard"], "left").withColumn("apart_", apart.cast("int"))
    met = met.withColumn("link_", F.when(apart, F.xxhash64("doc_id")).otherwise(F.col("link"))).withColumn("shard_", F.col("shard"))
    met = met.join(cold, ["apart_", "link_", "shard_"], "left")
    return met.select(*names, *[F.coalesce(f"hot_{v}", v).alias(v) for v in values])


def _by_range(ranked: DataFrame, key: str, kind: str, ranges: list[tuple]) -> DataFrame:
    """``ranked`` with ``to_`` of the one of ``ranges`` (key, low, high, to) that its ``rank_`` lies in; a key's ranks are met in slices, so none is one task's."""
    piece = lambda rank: F.floor(rank / SLICE)
    table = ranked.sparkSession.createDataFrame(ranges, f"{key} {kind}, low_ long, high_ long, to_ int")
    table = table.withColumn("slice_", F.explode(F.sequence(piece(F.col("low_")), piece(F.col("high_") - 1))))
    return ranked.withColumn("slice_", piece(F.col("rank_"))).join(table, [key, "slice_"]).filter("rank_ >= low_ and rank_ < high_")


def _settled(state: DataFrame, names: list[str], quota: list[int], scratch: Scratch) -> DataFrame:
    """``state`` with every group of ``link`` in one shard as far as groups fit; ``grouped_`` tells its rows from single ones.

    The driver gets groups counted by home and size: sizes differ, so there are
    at most about n_shards * sqrt(2 * rows) such counts.
    """
    n_shards = len(quota)
    cells = scratch.save(state.filter("link is not null").groupBy("link", "shard").agg(F.count("*").alias("n")), "cells")
    home = F.max(F.struct("n", F.xxhash64("link", "shard").alias("tie"), F.col("shard").alias("at")))["at"]
    groups = cells.groupBy("link").agg(home.alias("home"), F.sum("n").alias("n")).filter("n > 1")
    groups = scratch.save(groups.select("link", "home", "n", (F.col("n") * n_shards + F.col("home")).alias("class_")), "groups")
    whole, parted = group_places([tuple(r) for r in groups.groupBy("home", "n").count().collect()], quota)
    places, pieces, used = [], [], defaultdict(int)
    for k, (at, size, count, to) in enumerate([*whole, *((at, size, 1, None) for at, size, _ in parted)]):
        c = size * n_shards + at
        places.append((c, used[c], used[c] + count, -1 - (k - len(whole)) if to is None else to))
        used[c] += count
    for k, (_, _, into) in enumerate(parted):
        low = 0
        for to, n in sorted(into.items()):
            pieces.append((-1 - k, low, low + n, to))
            low += n
    to = _by_range(running(groups, scratch, "classes", "class_", [F.col("link")]), "class_", "long", places).select("link", "to_")
    to = scratch.save(cells.join(to, "link"), "to")
    placed = _look_up(state, to, sum(quota), ["to_"]).select(*names, F.coalesce("to_", "shard").alias("shard"), F.col("to_").isNotNull().cast("int").alias("grouped_"))
    if not parted:
        return placed
    placed = scratch.save(placed, "placed")
    rows = running(placed.filter("shard < 0"), scratch, "parted", "shard", [F.col("link"), F.col("doc_id")])
    rows = _by_range(rows, "shard", "int", pieces)
    return placed.filter("shard >= 0").unionByName(rows.select(*names, F.col("to_").alias("shard"), "grouped_"))


def balanced_shards(rows: DataFrame, n_shards: int = 8, slack: float = 0.05, least_gain: float = 0.1) -> DataFrame:
    """``rows(doc_id, link, ...)`` with ``shard`` and ``slot``; shard counts differ by one at most.

    ``link`` (long, null for none) joins documents to a common neighbour: all
    documents with one link value are neighbours of each other. Start: a hash
    of the document. Each round joins every document with its neighbours'
    shard counts; documents prefer the shard with most neighbours (ties: by a
    hash, so that they spread) and move there in order of gain, as far as the
    quotas between pairs of shards allow: no shard may pass its mean by more
    than ``slack`` and the scatter of the start. Rounds go on as long as each
    leaves at least the share ``least_gain`` fewer rows apart from their goal. What they leave parted,
    for want of room at its goal, then gets a shard that has room
    (``group_places``), and single rows move from shards above their final
    size to shards below it. So neighbours are parted only where they exceed
    a whole shard, or where no order tried leaves them room at the exact final sizes.

    Neighbour counts are aggregated per (link, shard), never as pairs. Null
    and repeated ids are placed like any others; an empty table stays empty.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "sharding")
    start = F.pmod(F.xxhash64("doc_id", F.lit("start")), F.lit(n_shards)).cast("int")
    state = scratch.save(rows.withColumn("shard", start), "state-0")
    names = rows.columns
    total = state.count()
    mean = total / n_shards
    capacity = int(np.ceil(mean * (1 + slack) + 4 * np.sqrt(mean)))
    tie = [F.col("link"), F.col("doc_id")]
    step, parted = 0, None
    while True:
        step += 1
        cells = state.filter("link is not null").groupBy("link", "shard").agg(F.count("*").alias("n"))
        best = cells.groupBy("link").agg(F.max(F.struct("n", F.xxhash64("link", "shard").alias("tie"), F.col("shard").alias("at"))).alias("best"), F.count("*").alias("shards"), F.max("n").alias("most")).filter(f"shards > 1 or most * {HOT} > {total}")
        goal = F.when(F.col("best.at") != F.col("shard"), F.col("best.at"))
        wishes = cells.join(best, "link").select("link", "shard", goal.alias("goal"), (F.col("best.n") - F.col("n") + 1).alias("gain"), "n")
        # Cells with many rows stay in the table without a wish, so that their rows are known and spread.
        wishes = scratch.save(wishes.filter(f"goal is not null or n * {HOT} > {total}"), f"wishes-{step}")
        wanted = {(r["shard"], r["goal"]): r["m"] for r in wishes.filter("goal is not null").groupBy("shard", "goal").agg(F.sum("n").alias("m")).collect()}
        sizes = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        moves = allowed_moves([sizes.get(k, 0) for k in range(n_shards)], wanted, capacity)
        before, parted = parted, sum(wanted.values())
        if not moves or before is not None and parted > (1 - least_gain) * before:
            break
        joined = scratch.save(_look_up(state, wishes, total, ["goal", "gain"]).select(*names, "shard", "goal", "gain"), f"joined-{step}")
        asked = joined.filter("goal is not null").withColumn("way", F.col("shard") * n_shards + F.col("goal"))
        ranked = running(asked, scratch, f"asked-{step}", "way", [-F.col("gain"), *tie])
        quota = F.create_map(*[F.lit(x) for (a, b), m in moves.items() for x in (a * n_shards + b, m)])
        moved = ranked.select(*names, F.when(F.col("rank_") < F.coalesce(quota[F.col("way")], F.lit(0)), F.col("goal")).otherwise(F.col("shard")).alias("shard"))
        state = scratch.save(joined.filter("goal is null").select(*names, "shard").unionByName(moved), f"state-{step}")
        scratch.drop(f"state-{step - 1}", f"wishes-{step}", f"joined-{step}", f"asked-{step}")
    counts = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    size = [counts.get(k, 0) for k in range(n_shards)]
    quota = [total // n_shards] * n_shards
    for k in sorted(range(n_shards), key=lambda k: (-size[k], k))[: total % n_shards]:
        quota[k] += 1
    held = scratch.save(_settled(state, names, quota, scratch), "held")
    counts = {r["shard"]: r["n"] for r in held.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    size = [counts.get(k, 0) for k in range(n_shards)]
    give = [max(0, s - q) for s, q in zip(size, quota, strict=True)]
    given = np.concatenate([[0], np.cumsum(give)])
    out = running(held, scratch, "slots", "shard", [F.col("grouped_"), *tie])
    pick = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("shard") + 1)
    out = out.withColumn("spare_", F.when(F.col("rank_") < pick(give), F.col("rank_") + pick(given[:-1])))
    to, slot, low = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for k in range(n_shards):
        take = max(0, quota[k] - size[k])
        if take:
            here = F.col("spare_").between(low, low + take - 1)
            to, slot = F.when(here, F.lit(k)).otherwise(to), F.when(here, F.col("spare_") - low + size[k]).otherwise(slot)
            low += take
    moved = F.col("spare_").isNotNull()
    return out.select(*names, F.when(moved, to).otherwise(F.col("shard")).alias("shard"), F.when(moved, slot).otherwise(F.col("rank_") - pick(give)).cast("long").alias("slot"))


def shard_documents(documents: DataFrame, n_shards: int = 8) -> DataFrame:
    """Shards of ``documents(doc_id, text)`` in which equal texts stay together.

    Returns doc_id, size (UTF-8 bytes plus one; null text: one), text_crc32
    (null text: that of the empty text), shard and slot. Null texts count as
    empty ones and are one group with them. Extra columns of the input are
    left behind.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("link"))
    return balanced_shards(rows, n_shards).select("doc_id", "size", "text_crc32", "shard", "slot")


def cut_groups(placed: DataFrame) -> DataFrame:
    """One row about ``placed(link, shard)``: groups of two rows or more, how many of them lie in several shards, and their rows."""
    groups = placed.filter("link is not null").groupBy("link", "shard").agg(F.count("*").alias("n")).groupBy("link").agg(F.sum("n").alias("n"), F.count("*").alias("shards")).filter("n > 1")
    return groups.agg(F.count("*").alias("groups"), F.count_if(F.col("shards") > 1).alias("parted"), F.coalesce(F.sum(F.when(F.col("shards") > 1, F.col("n"))), F.lit(0)).alias("rows_of_parted"))
