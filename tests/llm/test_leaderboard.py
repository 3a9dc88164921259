"""The feed of leaderboard changes against a plain replay."""

from __future__ import annotations

import datetime
import math
import random
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest

from graphloom.llm import leaderboard
from graphloom.llm.queries import QUERIES


def plain_boards(days: dict[int, list[tuple]]) -> list[tuple]:
    """(nation, day, item, change, old rank, new rank, revenue) of lines (nation, item, cents) by day."""
    revenue, boards, out = defaultdict(lambda: defaultdict(int)), defaultdict(list), []
    for day in sorted(days):
        for nation, item, cents in days[day]:
            revenue[nation][item] += cents
        for nation in {x[0] for x in days[day]}:
            new = [i for i, v in sorted(revenue[nation].items(), key=lambda x: (-x[1], x[0])) if v > 0][:10]
            a, b = ({x: k for k, x in enumerate(board, 1)} for board in (boards[nation], new))
            for x in a.keys() | b.keys():
                if a.get(x) != b.get(x):
                    out.append((nation, day, x, "enter" if x not in a else "exit" if x not in b else "move", a.get(x), b.get(x), revenue[nation][x]))
            boards[nation] = new
    return out


def plain_feed(lines: list[dict], vendors: list[dict], items: list[dict]) -> list[tuple]:
    nation, price = {r["vendor_id"]: r["nation_id"] for r in vendors}, {r["item_id"]: r["price"] for r in items}
    batches, days, seen = defaultdict(list), defaultdict(list), None
    for r in lines:
        h = zlib.crc32(",".join("" if r[c] is None else str(r[c]) for c in ("sale_id", "item_id", "vendor_id", "line_no")).encode())
        s = (r["shipped_at"].date() - datetime.date(1970, 1, 1)).days if r["shipped_at"] else 19723 + h % 150
        a = s + h % 7 + (20 if h % 5 == 0 else 0)
        batches[min(10, 1 + math.floor((a - 19723) * 10 / 180))].append((r, s, a))
    batch_of = {a: b for b, rows in batches.items() for _, _, a in rows}
    for b in sorted(batches):
        for r, s, a in batches[b]:
            if (seen is None or s + 3 >= seen) and nation.get(r["vendor_id"]) is not None and r["item_id"] in price:
                p, q = price[r["item_id"]], r["quantity"]
                cents = math.floor(100 * r["amount"] + 0.5) if r["amount"] is not None else 0 if p is None or q is None else q * math.floor(100 * p + 0.5)
                days[a].append((nation[r["vendor_id"]], r["item_id"], -cents if r["flag"] == "swapped" else cents))
        seen = max([s for _, s, _ in batches[b]] + [seen] * (seen is not None))
    return [(n, a, x, batch_of[a], *rest) for n, a, x, *rest in plain_boards(days)]


def rows_of(feed) -> list[tuple]:
    return sorted((tuple(r) for r in feed.select("nation_id", "arrival_day", "item_id", "batch", "change", "old_rank", "new_rank", "revenue").collect()), key=str)


def test_feed_of_the_tables(spark, sf_dir):
    tables = [pq.read_table(f"{sf_dir}/{t}.parquet").to_pylist() for t in ("sale_lines", "vendors", "items")]
    assert rows_of(QUERIES["op11_leaderboard"](spark, sf_dir)) == sorted(plain_feed(*tables), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_replay_of_many_items_in_buckets(seed):
    """More items than are kept in order, revenues that fall again, ties, days over several batches of state."""
    rng = random.Random(seed)
    rows = [(day, rng.randrange(700), rng.choice([-30, -20, 10, 10, 20, 40])) for day in range(25) for _ in range(rng.choice([3, 900]))]
    days = defaultdict(list)
    for day, item, cents in rows:
        days[day].append((1, item, cents))
    items, moves = np.arange(700), []
    for bucket in range(3):
        mine, board = items[items % 3 == bucket], {}
        cents = np.zeros(len(mine))
        for batch in range(5):
            part = np.array([(d, i, batch, float(c)) for d, i, c in rows if i % 3 == bucket and d // 5 == batch], leaderboard._SUMS)
            found, board = leaderboard.bucket_moves(mine, cents, board, part)
            moves += found
    feed = leaderboard.nation_changes(pd.DataFrame(moves, columns=["day", "item_id", "batch", "held", "cents"]))
    assert sorted(((1, d, i, c, a, b, v) for d, i, _, c, a, b, v in feed), key=str) == sorted(plain_boards(days), key=str)


def test_nulls_ties_repeats_and_further_columns(spark):
    lines = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, flag string, shipped_at timestamp_ntz, nation_id string, batch string"
    at = datetime.datetime(2024, 1, 5)
    data = [
        (1, 1, 7, 1, 2, 5.0, "kept", at, "x", "y"),
        (1, 1, 7, 1, 2, 5.0, "kept", at, "x", "y"),  # repeated: counts again
        (2, 1, 8, 1, 1, 10.0, None, at, None, None),  # a tie of 7
        (3, None, 8, 1, None, None, "kept", at, None, None),  # nothing known of its worth
        (4, 1, 9, 1, 3, None, "swapped", at, None, None),  # priced, below zero
        (None, 1, 9, 1, 1, 90.0, "kept", None, None, None),
        (5, 1, 99, 1, 1, 1.0, "kept", at, None, None),  # no such item
        (6, 1, 7, 2, 1, 1.0, "kept", at, None, None),  # a vendor without a nation
        (7, 1, None, None, 1, 1.0, "kept", at, None, None),
    ]
    vendors, items = [(1, 3), (2, None), (None, 4)], [(7, 1.0), (8, None), (9, 2.25)]
    v, i = spark.createDataFrame(vendors, "vendor_id long, nation_id int"), spark.createDataFrame(items, "item_id long, price double")
    df = spark.createDataFrame(data, lines)
    plain = plain_feed([dict(zip(df.columns, r, strict=True)) for r in data], [dict(zip(v.columns, r, strict=True)) for r in vendors], [dict(zip(i.columns, r, strict=True)) for r in items])
    assert rows_of(leaderboard.change_feed(spark, df, v, i)) == sorted(plain, key=str)
    assert leaderboard.change_feed(spark, df.limit(0), v, i).collect() == []


def test_state_keeps_nothing_in_the_executor(spark):
    """Each store that RocksDB opens leaves native memory behind: 211 partitions and 10 starts took 0.4 GB of an executor."""
    days = [datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d) for d in (0, 40, 90)]
    lines = [(k, k % 5, k % 7, 1, 1, float(k), "kept", days[k % 3]) for k in range(60)]
    df = spark.createDataFrame(lines, "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, flag string, shipped_at timestamp_ntz")
    v, i = spark.createDataFrame([(1, 3)], "vendor_id long, nation_id int"), spark.createDataFrame([(k, 1.0) for k in range(7)], "item_id long, price double")
    shared = Path(leaderboard.shared_dir(spark).removeprefix("file:"))
    before = set(shared.glob("leaderboard-*"))
    assert leaderboard.change_feed(spark, df, v, i).count()
    roots = [x for x in shared.glob("leaderboard-*") if x not in before and (x / "checkpoint").exists()]
    assert len(roots) == 1
    stores = {f.suffix for f in (roots[0] / "checkpoint/state").rglob("*") if f.is_file() and f.name[:1].isdigit()}
    assert ".delta" in stores and not stores & {".changelog", ".zip"}
