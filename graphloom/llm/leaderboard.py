"""Leaderboards of nations over a stream of sale lines, and the feed of their changes.

Lines are dealt to batches by the day they arrive; each batch is appended to a
folder and a stateful streaming query is started anew on one checkpoint for it.
Its state, in ``applyInPandasWithState``, is kept by nation and bucket of items:
running revenues by item, and the bucket's saved board. A third of all lines may
be of one nation, so a nation's items are spread over ``BUCKETS`` groups, and
lines of one nation, item and day are summed where they are read. A list ordered
by negative revenue and item id, kept by bisection, gives the board of each day;
the days of a batch are replayed in order, and what moved on a bucket's board
goes out.

The best of all items are among the best of their buckets: replaying the moves
of a nation's buckets on a list of the same kind gives its boards, which are
diffed. That is at most ``PLACES`` a bucket and day, however many lines there are.

Revenues are whole cents in doubles, exact up to 2**53.

Defined results: a line without a date, amount, quantity, price, nation or item
is treated as ``sale_batches`` says; repeated lines count each time; lines that
are late are dropped; vendors and items that repeat count once, with the
smallest nation or price; an empty table gives an empty feed; further columns of
the tables are not looked at.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from graphloom.llm.store import cut, shared_dir

#: Places of a board, groups of a nation's items, entries kept in order beyond a board.
PLACES, BUCKETS, SPARE = 10, 32, 64
#: First day of the batches, their number and the days they cover; days a line may be late.
FIRST_DAY, BATCHES, SPAN, LATE = 19723, 10, 180, 3

FEED = "nation_id int, arrival_day long, item_id long, batch int, change string, old_rank int, new_rank int, revenue long"
_LINES = "nation_id int, item_id long, day long, shipped long, seen long, batch int, cents double"
_DAYS = "nation_id int, bucket int, packed binary"
#: Sums of lines by day and item, as they travel to the state of their bucket: many to a row.
_SUMS = np.dtype([("day", "<i8"), ("item", "<i8"), ("batch", "<i4"), ("cents", "<f8")])
#: Sorted item ids and their revenues, as bytes of long and double, and the bucket's board.
_STATE = "items binary, cents binary, board_items array<long>, board_cents array<double>"
_MOVES = "nation_id int, day long, item_id long, batch int, held boolean, cents double"


def _cents(amount: Column) -> Column:
    return F.floor(amount * F.lit(100.0) + F.lit(0.5)).cast("double")


def sale_batches(lines: DataFrame, vendors: DataFrame, items: DataFrame) -> DataFrame:
    """Lines with their nation, cents, days and batch.

    A null ``shipped_at`` is a day drawn by the line's hash; a null amount is quantity times price,
    and nothing where one of them is null too. Lines whose vendor has no nation or whose item is
    unknown have a null ``nation_id``: they only move the latest day.
    """
    part = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("sale_id", "item_id", "vendor_id", "line_no")]
    h = F.crc32(F.concat_ws(",", *part).cast("binary"))
    shipped = F.coalesce(F.unix_date(F.col("shipped_at").cast("date")).cast("long"), FIRST_DAY + h % 150)
    dated = lines.select("vendor_id", "item_id", "quantity", "amount", "flag", h.alias("h"), shipped.alias("shipped"))
    day = F.col("shipped") + F.col("h") % 7 + F.when(F.col("h") % 5 == 0, 20).otherwise(0)
    # both tables grow with the input: joined by shuffles, which adaptive execution splits where a key is hot; it
    # does so only for sides that come straight from a shuffle, so the aggregates are tables of their own
    nations = cut(vendors.groupBy("vendor_id").agg(F.min("nation_id").alias("nation_id")), "leaderboard-nations")
    prices = cut(items.groupBy("item_id").agg(F.min("price").alias("price"), F.lit(True).alias("known")), "leaderboard-prices")
    full = dated.join(nations.hint("merge"), "vendor_id", "left").join(prices.hint("merge"), "item_id", "left")
    priced = F.coalesce(_cents(F.col("amount")), F.col("quantity").cast("double") * _cents(F.col("price")), F.lit(0.0))
    return full.select(
        F.when(F.col("known"), F.col("nation_id")).cast("int").alias("nation_id"),
        "item_id",
        day.cast("long").alias("day"),
        "shipped",
        F.least(F.lit(BATCHES), 1 + F.floor((day - FIRST_DAY) * BATCHES / SPAN)).cast("int").alias("batch"),
        F.when(F.col("flag") == "swapped", -priced).otherwise(priced).alias("cents"),
    )


class Board:
    """Items with a positive revenue in order, as far down as ``cut``: what is further down is not held."""

    def __init__(self, rows, cut: tuple[float, int] | None = None) -> None:
        self.held = dict(rows)
        self.order = sorted((-v, k) for k, v in self.held.items())
        self.cut = cut

    def put(self, item: int, revenue: float) -> None:
        """Sets an item's revenue; one that is not positive, or beyond the cut, is let go."""
        before = self.held.pop(item, None)
        if before is not None:
            del self.order[bisect_left(self.order, (-before, item))]
        if revenue > 0 and (self.cut is None or (-revenue, item) <= self.cut):
            self.held[item] = revenue
            insort(self.order, (-revenue, item))

    def trim(self, most: int) -> None:
        if len(self.order) > most:
            for _, item in self.order[most:]:
                del self.held[item]
            del self.order[most:]
            self.cut = self.order[-1]

    def top(self) -> list[int]:
        return [item for _, item in self.order[:PLACES]]


def _leaders(items: np.ndarray, cents: np.ndarray) -> Board:
    """The first ``SPARE`` of all items, and the cut below them if there are more."""
    up = np.flatnonzero(cents > 0)
    first = up[np.lexsort((items[up], -cents[up]))[:SPARE]] if len(up) <= 4 * SPARE else None
    if first is None:
        near = up[cents[up] >= np.partition(cents[up], len(up) - SPARE)[len(up) - SPARE]]  # ties of the last one too
        first = near[np.lexsort((items[near], -cents[near]))[:SPARE]]
    board = Board(zip(items[first].tolist(), cents[first].tolist(), strict=True))
    if len(up) > len(first):
        board.cut = board.order[-1]
    return board


def bucket_moves(items: np.ndarray, cents: np.ndarray, board: dict[int, float], sums: np.ndarray) -> tuple[list[tuple], dict[int, float]]:
    """Replays the days of ``sums`` (records of ``_SUMS``) over running revenues, which it changes in place.

    ``items`` are sorted and have all items of ``sums``. Returns what came onto the bucket's board, changed
    there or left it, as (day, item, batch, held, revenue), and the board after the last day.
    """
    order = _leaders(items, cents)
    inside = np.zeros(len(items), bool)
    inside[np.searchsorted(items, list(order.held))] = True
    moves: list[tuple] = []
    sums = sums[np.lexsort((sums["item"], sums["day"]))]
    firsts = np.flatnonzero(np.append(True, (sums["day"][1:] != sums["day"][:-1]) | (sums["item"][1:] != sums["item"][:-1])))
    deltas, places = np.add.reduceat(sums["cents"], firsts), np.searchsorted(items, sums["item"][firsts])
    all_days, batches = sums["day"][firsts], sums["batch"][firsts]
    days, starts = np.unique(all_days, return_index=True)
    for day, lo, hi in zip(days.tolist(), starts, [*starts[1:], len(firsts)], strict=True):
        at = places[lo:hi]
        cents[at] += deltas[lo:hi]
        told = at if order.cut is None else at[inside[at] | (-cents[at] <= order.cut[0])]
        for i, item, v in zip(told.tolist(), items[told].tolist(), cents[told].tolist(), strict=True):
            order.put(item, v)
            inside[i] = item in order.held
        if order.cut is not None and len(order.order) < PLACES or len(order.order) > 4 * SPARE:
            order = _leaders(items, cents)
            inside[:] = False
            inside[np.searchsorted(items, list(order.held))] = True
        now = {item: order.held[item] for item in order.top()}
        batch = int(batches[lo])
        moves += [(day, item, batch, True, v) for item, v in now.items() if board.get(item) != v]
        moves += [(day, item, batch, False, float(cents[np.searchsorted(items, item)])) for item in board if item not in now]
        board = now
    return moves, board


def nation_changes(moves: pd.DataFrame) -> list[tuple]:
    """Replays the moves on the boards of a nation's buckets, day by day, and diffs the nation's boards."""
    order, board, feed = Board(()), [], []
    for day, part in moves.groupby("day", sort=True):
        gone = {}
        for item, held, cents in zip(part["item_id"].tolist(), part["held"].tolist(), part["cents"].tolist(), strict=True):
            order.put(item, cents if held else 0.0)
            if not held:
                gone[item] = cents
        now = order.top()
        old, new = {x: i for i, x in enumerate(board, 1)}, {x: i for i, x in enumerate(now, 1)}
        for item in sorted(old.keys() | new.keys()):
            a, b = old.get(item), new.get(item)
            if a != b:
                change = "enter" if a is None else "exit" if b is None else "move"
                feed.append((int(day), item, int(part["batch"].iloc[0]), change, a, b, round(order.held.get(item, gone.get(item, 0.0)))))
        board = now
    return feed


def bucket_boards(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Replays what a start brings for a nation's bucket of items over its state, and hands out the moves."""
    new = np.concatenate([np.frombuffer(packed, _SUMS) for part in rows for packed in part["packed"]])
    items, cents, *saved = state.get if state.exists else (b"", b"", [], [])
    items, cents = np.frombuffer(items, "<i8"), np.frombuffer(cents, "<f8")
    known = np.union1d(items, new["item"])
    revenue = np.zeros(len(known))
    revenue[np.searchsorted(known, items)] = cents
    moves, board = bucket_moves(known, revenue, dict(zip(*saved, strict=True)), new)
    state.update((known.astype("<i8").tobytes(), revenue.astype("<f8").tobytes(), list(board), list(board.values())))
    if moves:
        out = pd.DataFrame(moves, columns=["day", "item_id", "batch", "held", "cents"])
        out.insert(0, "nation_id", key[0])
        yield out


def nation_feed(moves: pd.DataFrame) -> pd.DataFrame:
    """The feed of one nation from all moves on the boards of its buckets."""
    out = pd.DataFrame(nation_changes(moves), columns=["arrival_day", "item_id", "batch", "change", "old_rank", "new_rank", "revenue"])
    out[["old_rank", "new_rank"]] = out[["old_rank", "new_rank"]].astype("Int32")
    out.insert(0, "nation_id", moves["nation_id"].iloc[0])
    return out


def bucket_of(items: np.ndarray, buckets: int) -> np.ndarray:
    return ((items.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


def sum_days(buckets: int, most: int = 1 << 20):
    """Sums the lines of one nation, item and day where they are read, ``most`` rows at a time, and packs them by bucket."""

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).group_by(["nation_id", "item_id", "day"]).aggregate([("batch", "max"), ("cents", "sum")])
        nation, item, day, batch, cents = (table[c].to_numpy() for c in ("nation_id", "item_id", "day", "batch_max", "cents_sum"))
        bucket = bucket_of(item, buckets)
        order = np.lexsort((bucket, nation))
        sums = np.empty(len(order), _SUMS)
        for name, values in (("day", day), ("item", item), ("batch", batch), ("cents", cents)):
            sums[name] = values[order]
        nation, bucket = nation[order], bucket[order]
        firsts = np.flatnonzero(np.append(True, (nation[1:] != nation[:-1]) | (bucket[1:] != bucket[:-1])))
        rows = [sums[lo:hi].tobytes() for lo, hi in zip(firsts, [*firsts[1:], len(sums)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(nation[firsts], pa.int32()), pa.array(bucket[firsts], pa.int32()), pa.array(rows, pa.binary())], names=["nation_id", "bucket", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= most:
                yield from packed(held)
                held, n = [], 0
        if n:
            yield from packed(held)

    return run


def change_feed(spark: SparkSession, lines: DataFrame, vendors: DataFrame, items: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The changes of all boards, day by day: columns of ``FEED``.

    Every call works in a folder of its own below ``spark.checkpoint.dir``. What reaches the driver is a
    row per batch. A start that fails can be repeated: offsets, states and the output's log are in that folder.
    """
    root = f"{shared_dir(spark)}/leaderboard-{uuid.uuid4().hex}"
    # lines that count for nothing but the latest day stay in the batches: they are read, and dropped, by the stream
    batches = sale_batches(lines, vendors, items)
    batches.write.partitionBy("batch").parquet(f"{root}/staged")
    staged = spark.read.schema(batches.schema).parquet(f"{root}/staged")
    latest = {r.batch: r.latest for r in staged.groupBy("batch").agg(F.max("shipped").alias("latest")).collect()}
    if not latest:
        return spark.createDataFrame([], FEED)
    own = spark.newSession()  # with settings of its own, and as many partitions of state as the caller's shuffles have
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")  # a store's memory is given back with its task
    # not RocksDB: each store that Spark 4.1 opens with it leaves half a MB of native statistics in the executor for good
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    own.conf.set("spark.sql.streaming.checkpoint.fileChecksum.enabled", "false")  # a second file beside each small one
    seen = None
    for batch in sorted({*range(1, BATCHES + 1), *latest}):
        fed = staged.where(F.col("batch") == batch).select("nation_id", "item_id", "day", "shipped", F.lit(seen).cast("long").alias("seen"), "batch", "cents")
        fed.write.mode("append").parquet(f"{root}/lines")
        if batch in latest:
            seen = max(latest[batch], seen if seen is not None else latest[batch])
        _start(own, root, buckets)
    return spark.read.schema(_MOVES).parquet(f"{root}/moves").groupBy("nation_id").applyInPandas(nation_feed, FEED)


def _start(spark: SparkSession, root: str, buckets: int) -> None:
    """Runs the streaming query over what was appended since its last start."""
    lines = spark.readStream.schema(_LINES).parquet(f"{root}/lines")
    on_time = lines.where(f"nation_id IS NOT NULL AND item_id IS NOT NULL AND (seen IS NULL OR shipped + {LATE} >= seen)")
    days = on_time.select("nation_id", "item_id", "day", "batch", "cents").mapInArrow(sum_days(buckets), _DAYS)
    moves = days.groupBy("nation_id", "bucket").applyInPandasWithState(bucket_boards, _MOVES, _STATE, "append", "NoTimeout")
    writer = moves.writeStream.format("parquet").option("path", f"{root}/moves").option("checkpointLocation", f"{root}/checkpoint")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
