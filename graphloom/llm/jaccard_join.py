"""N-gram Jaccard join by prefix trees.

Two documents link when their sets of word n-grams have a Jaccard similarity of
at least ``SHARE`` percent; classes are the connected components of the links.

1. Documents with equal sets are one set, known by a digest; the smallest
   document id stands for it.
2. In one global order of the n-grams - rare ones first, as far as they are
   counted - linked sets share an n-gram among their first n - ceil(share * n) + 1.
   Each set deals out the n-grams of a fixed part of the hash space (and as many
   more as its prefix needs); what only one set has is dropped where it meets, and
   a set with enough of those has no partner.
3. Sets that share a prefix n-gram, and whose sizes and places in the order leave
   room for a link, fall into candidate clusters, cut into blocks of bounded size.
   Where that makes several blocks, step 2 is done again with all n-grams of these
   sets, now in exact order, so that what many texts quote does not hold them together.
   A block stores its sets, frequent n-grams first, in a trie;
   each set walks it once, sharing partial overlaps, and leaves a subtree when the
   n-grams that remain cannot reach the bound or all below it is of its own class.
4. Clusters that still have several blocks are finished exactly: their classes' first
   members meet in blocks of their own, and then all sets of different classes that
   share a prefix n-gram in such places.

Defined results: a text without words, or null, has an empty set and links with
nothing; a text of fewer than n words has its whole sequence as its one n-gram; a
null key keeps its row, which links with nothing and has no component; rows may
repeat; keys may be of any type that has an order; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.store import cut, give_back, slices
from graphloom.operators.components import connected_components

#: Words of an n-gram, least similarity in percent.
WORDS, SHARE = 5, 75
#: The part of the hash space, in 1/64, whose n-grams every set deals out; all of it.
ZONE, WHOLE = 24, 64
#: N-grams of all sets in one block at most; a larger set is a block of its own with each partner.
BLOCK = 1_000_000
#: Sets that share an n-gram are counted up to this number.
COUNTED = 1 << 16
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_FILTER_WORDS = 1 << 16


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads sums of hashes evenly over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, hashes: dict, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's n-grams."""
    found = text.encode().translate(_LOWER).split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = min(words, len(found))
    with np.errstate(over="ignore"):
        total = np.full(len(h) - n + 1, n, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for i in range(n):
            total = total * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - n + 1 + i]
        return np.unique(_mixed(total))


def prefix_length(n: int, share: int = SHARE) -> int:
    """So many n-grams from the front of the order, of any two sets that link, have one in common."""
    return n - -(-share * n // 100) + 1 if n else 0


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _over_texts(batches, words):
    for part in slices(batches, "text", 4 << 20):
        hashes = _Hashes()
        yield part, [shingles(t, hashes, words) for t in part.column("text").to_pylist()]


def sets_of(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(key, n, s1, s2): size and digest of each document's set."""

    def run(batches):
        for part, found in _over_texts(batches, words):
            digests = np.array([_digest(s) for s in found], np.int64).reshape(-1, 2)
            yield pa.record_batch([part.column("key"), pa.array([len(s) for s in found], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1])], ["key", "n", "s1", "s2"])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, n long, s1 long, s2 long")


def dealt_out(docs: DataFrame, text: str, words: int, share: int, zone: int = ZONE) -> DataFrame:
    """(token, s1, s2, n, z): the n-grams that each set offers; ``z`` of them lie in the zone.

    A task deals out equal sets once.
    """

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for _, found in _over_texts(batches, words):
            tokens, ids, sizes, zones = [], [], [], []
            for s in found:
                if not len(s) or (d := _digest(s)) in seen:
                    continue
                if len(seen) < 1 << 18:
                    seen.add(d)
                z = int(np.searchsorted(s, np.uint64(zone << 58))) if zone < WHOLE else len(s)
                tokens.append(s[: max(z, prefix_length(len(s), share))])
                ids.append(d)
                sizes.append(len(s))
                zones.append(z)
            if tokens:
                each = [len(t) for t in tokens]
                pair = np.repeat(np.array(ids, np.int64), each, axis=0)
                yield pa.record_batch(
                    [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(np.repeat(np.array(sizes, np.int32), each)), pa.array(np.repeat(np.array(zones, np.int32), each))],
                    ["token", "s1", "s2", "n", "z"],
                )

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "token long, s1 long, s2 long, n int, z int")


def shared(dealt: DataFrame) -> DataFrame:
    """(token, sets, s1, s2, n, z): the rows whose n-gram at least two sets have; ``sets`` counts those, up to a bound.

    Reads each partition in order of the n-grams and holds one n-gram's rows at a time, ``COUNTED`` at most.
    """
    names = ["token", "s1", "s2", "n", "z"]

    def run(batches):
        held: list[np.ndarray] = []  # distinct rows of the n-gram that is being read
        token, last, open_ = None, None, False

        def out(rows: np.ndarray, sets: np.ndarray):
            return pa.record_batch([*(pa.array(rows[:, i] if i < 3 else rows[:, i].astype(np.int32)) for i in range(5)), pa.array(sets.astype(np.int32))], [*names, "sets"])

        def closed():
            rows = np.concatenate(held) if held else np.zeros((0, 5), np.int64)
            if len(rows) > 1:
                yield out(rows, np.full(len(rows), min(len(rows), COUNTED)))

        for batch in batches:
            rows = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])
            if not len(rows):
                continue
            before = np.vstack([[[*last] if last else [rows[0, 0], ~rows[0, 1], 0]], rows[:-1, :3]])
            rows = rows[(rows[:, :3] != before).any(axis=1)]
            if not len(rows):
                continue
            last = tuple(rows[-1, :3])
            starts = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
            ends = np.append(starts[1:], len(rows))
            if rows[0, 0] != token:
                if not open_:
                    yield from closed()
                held, open_ = [], False
            whole = np.zeros(len(rows), bool)
            sets = np.zeros(len(rows), np.int64)
            lengths = ends - starts
            # n-grams that begin and end in this batch
            inner = slice(1 if rows[0, 0] == token else 0, len(starts) - 1)
            if inner.start < inner.stop:
                many = np.repeat(np.minimum(lengths[inner], COUNTED), lengths[inner])
                a, b = starts[inner.start], ends[inner.stop - 1]
                sets[a:b], whole[a:b] = many, many > 1
            if rows[0, 0] == token:
                first = rows[: ends[0]]
                if open_:
                    yield out(first, np.full(len(first), COUNTED))
                else:
                    held.append(first)
                if len(starts) > 1:
                    if not open_:
                        yield from closed()
                    held, open_ = [], False
            if whole.any():
                yield out(rows[whole], sets[whole])
            if rows[0, 0] != token or len(starts) > 1:
                held, open_, token = [rows[starts[-1] :]], False, rows[-1, 0]
            if not open_ and sum(map(len, held)) >= COUNTED:
                every = np.concatenate(held)
                yield out(every, np.full(len(every), COUNTED))
                held, open_ = [], True
        if not open_:
            yield from closed()

    return dealt.repartition("token").sortWithinPartitions("token", "s1", "s2").mapInArrow(run, "token long, s1 long, s2 long, n int, z int, sets int")


def prefixes(met: DataFrame, share: int, zone: int = ZONE) -> DataFrame:
    """(token, s1, s2, n, at): the shared n-grams that lie in their set's prefix, after ``at`` others at least.

    The order: n-grams of the zone by the number of their sets (those of one set first), then by
    hash; then all others by hash. A set's own n-grams of the zone therefore come first, and where
    they fill the prefix the set is gone.
    """
    sign = F.lit(-(1 << 63))
    unsigned = F.col("token").bitwiseXOR(sign)  # orders as the unsigned number does
    zoned = unsigned < F.lit((zone << 58) - (1 << 63)) if zone < WHOLE else F.lit(True)
    n = F.col("n").cast("long")
    room = n - F.ceil(n * share / 100.0) + 1
    group = Window.partitionBy("s1", "s2")
    own = F.col("z") - F.sum(F.when(zoned, 1).otherwise(0)).over(group)
    place = F.row_number().over(group.orderBy(F.when(zoned, 0).otherwise(1), F.when(zoned, F.col("sets")), unsigned))
    # beyond the zone every n-gram that the prefix needs is dealt out, but those that no other set dealt out were dropped: keep all
    return met.select("token", "s1", "s2", "n", (own + place - 1).cast("int").alias("at"), (F.when(zoned, place <= room - own).otherwise(own + F.sum(F.when(zoned, 1).otherwise(0)).over(group) < room)).alias("inside")).where("inside").drop("inside")


def near(met: DataFrame, share: int) -> DataFrame:
    """(src, dst): pairs of (token, rep, n, at) that hold together all sets that can link.

    The first common n-gram of two linked sets has enough of both behind it: ``at`` bounds the size of a partner.
    Of an n-gram's sets, in order of size, each is paired with that one of its smaller partners that allows the largest.
    """

    def linked(rows: pa.Table) -> pa.RecordBatch:
        token, n, at = (rows.column(c).to_numpy().astype(np.int64) for c in ("token", "n", "at"))
        row = np.arange(len(n))
        opens = np.concatenate([[True], token[1:] != token[:-1]])
        begin = np.maximum.accumulate(np.where(opens, row, 0))
        group = np.cumsum(opens) << 40  # sizes of one n-gram lie above those of all before
        reach = ((100 + share) * (n - at) - share * n) // share
        top = np.maximum.accumulate(group + reach)
        widest = np.maximum.accumulate(np.where(np.concatenate([[True], top[1:] > top[:-1]]), row, 0))
        end = np.minimum(np.searchsorted(group + n, group + reach, side="right"), row)
        partner = widest[np.maximum(end - 1, 0)]
        found = (end > begin) & (reach[partner] >= n)
        reps = rows.column("rep").combine_chunks()
        return pa.record_batch([reps.take(pa.array(row[found])), reps.take(pa.array(partner[found]))], ["src", "dst"])

    def run(batches):
        held: list[pa.RecordBatch] = []  # rows of the n-gram that is being read
        for batch in batches:
            token = batch.column("token").to_numpy()
            if not len(token):
                continue
            last = int(np.searchsorted(token, token[-1]))
            if last or held and held[0].column("token")[0].as_py() != token[0]:
                yield linked(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield linked(pa.Table.from_batches(held))

    kind = met.schema["rep"].dataType.simpleString()
    rows = met.select("token", "rep", "n", "at").repartition("token").sortWithinPartitions("token", "n", "rep")
    return rows.mapInArrow(run, f"src {kind}, dst {kind}").where("src <> dst").distinct()


class _Node:
    __slots__ = ("edge", "kids", "best", "leaf", "mixed", "least")

    def __init__(self, edge, best, leaf, least):
        self.edge, self.kids, self.best, self.leaf, self.mixed, self.least = edge, {}, best, leaf, False, least


def trie_join(sets: list[np.ndarray], share: int = SHARE) -> list[int]:
    """For each set the number of the first set of its class, by one walk of a growing trie per set.

    Links are those of similarity >= share percent: (100 + share) * overlap >= share * (n + m).
    """
    total = len(sets)
    parent = list(range(total))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if total < 2:
        return parent
    sizes = [len(s) for s in sets]
    tokens, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, -times))] = np.arange(len(tokens))  # the order of the trie: frequent first
    common = rank[inverse][times[inverse] > 1]
    held = np.add.reduceat((times[inverse] > 1).astype(np.int64), np.cumsum([0, *sizes[:-1]])) if all(sizes) else None
    if held is None:
        raise ValueError("empty sets have no class")
    lists = np.split(common, np.cumsum(held)[:-1])
    up = 100 + share
    root = _Node((), -1, None, 0)
    for x in range(total):
        n, mine = sizes[x], np.sort(lists[x])
        if 100 * len(mine) < share * n:  # too much of it is in no other set
            continue
        mine = mine.tolist()
        has = set(mine)
        need = share * n
        # walk: a node, the n-grams on the path to it, the overlap on that path
        stack = [(kid, 0, 0) for kid in root.kids.values()]
        while stack:
            node, depth, overlap = stack.pop()
            if not node.mixed and find(node.least) == find(x):
                continue
            edge = node.edge
            overlap += len(has.intersection(edge)) if len(edge) > 4 else sum(t in has for t in edge)
            depth += len(edge)
            # best: the largest up * n-grams - share * size below; what remains of a path can all be shared at best
            if node.best - up * (depth - overlap) < need:
                continue
            if node.leaf is not None and up * overlap >= share * (n + sizes[node.leaf]):
                a, b = find(x), find(node.leaf)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            for kid in node.kids.values():
                stack.append((kid, depth, overlap))
        _insert(root, mine, up * len(mine) - share * n, x, find)
    return [find(i) for i in range(total)]


def _insert(root: _Node, tokens: list[int], worth: int, x: int, find) -> None:
    node, at = root, 0
    while True:
        kid = node.kids.get(tokens[at]) if at < len(tokens) else None
        if kid is None:
            if at == len(tokens):
                node.leaf = x  # equal sets of common n-grams: the earlier one gets a node of its own
            else:
                node.kids[tokens[at]] = _Node(tuple(tokens[at:]), worth, x, x)
            return
        edge, k = kid.edge, 1
        while k < len(edge) and at + k < len(tokens) and edge[k] == tokens[at + k]:
            k += 1
        if k < len(edge):  # split the edge
            low = _Node(edge[k:], kid.best, kid.leaf, kid.least)
            low.kids, low.mixed = kid.kids, kid.mixed
            kid.edge, kid.kids, kid.leaf = edge[:k], {edge[k]: low}, None
        kid.best = max(kid.best, worth)
        kid.mixed = kid.mixed or find(kid.least) != find(x)
        at += k
        if at == len(tokens) and kid.leaf is not None:
            kid.kids[("again", x)] = _Node((), worth, x, x)
            return
        node = kid


def _filtered(df: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """A first thinning by a membership filter of fixed size, whose true members all pass."""
    h = F.xxhash64(key)
    word, bit = h.bitwiseAND(F.lit(_FILTER_WORDS - 1)), F.shiftright(h, 32).bitwiseAND(F.lit(63)).cast("int")
    filter_ = members.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))
    # _FILTER_WORDS rows of two numbers at most
    return df.join(F.broadcast(filter_), word == F.col("_word")).where(F.call_function("shiftright", F.col("_bits"), bit).bitwiseAND(F.lit(1)) == 1).drop("_word", "_bits")


def _join_blocks(texts: DataFrame, words: int, share: int) -> DataFrame:
    """(rep, root) for rows (block, rep, text) that the trie join puts into classes."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        reps, column = table.column("rep").combine_chunks(), table.column("text")
        hashes = _Hashes()
        roots = trie_join([shingles(t.as_py(), hashes, words) for t in column], share)
        give_back()
        return pa.table({"rep": reps, "root": reps.take(pa.array(roots))})

    kind = texts.schema["rep"].dataType.simpleString()
    return texts.groupBy("block").applyInArrow(run, f"rep {kind}, root {kind}")


def _classes(docs: DataFrame, key: str, text: str, blocks: DataFrame, words: int, share: int) -> DataFrame:
    """Classes inside each block of (rep, block)."""
    source = docs.select(F.col(key).alias("rep"), F.col(text).cast("string").alias("text"))
    own = _filtered(source, "rep", blocks.select("rep")).join(blocks, "rep")
    return cut(_join_blocks(own.select("block", "rep", "text"), words, share), "jaccard-classes")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, share: int = SHARE, block: int = BLOCK) -> DataFrame:
    """(``key``, ``n_shingles``, ``component_id``) for each row: the size of its set and the smallest key of its class."""
    sets = cut(sets_of(docs, key, text, words), "jaccard-sets")
    real = sets.where("n > 0 AND key IS NOT NULL")
    reps = cut(real.groupBy("s1", "s2").agg(F.min("key").alias("rep")), "jaccard-reps")

    met = _met(docs, text, reps, words, share, ZONE)
    placed = _placed(met, share, block)
    wide = placed.where("parts > 1").select("rep")
    if not wide.isEmpty():
        source = docs.select(F.col(key).alias("rep"), F.col(text).alias(text))
        met = _met(_filtered(source, "rep", wide).join(wide, "rep", "left_semi"), text, reps.join(wide, "rep", "left_semi"), words, share, WHOLE)
        placed = cut(placed.where("parts = 1").unionByName(_placed(met, share, block)), "jaccard-blocks")
    first = _classes(docs.where(F.col(key).isNotNull()), key, text, placed.select("rep", "block"), words, share)

    large = placed.where("parts > 1")
    if large.isEmpty():
        final = first.withColumnRenamed("root", "component")
    else:
        links = first.where("rep != root").select(F.col("rep").alias("src"), F.col("root").alias("dst"))
        # the first members of the classes meet, block by block, until one round has no more than one block a cluster
        heads = large.join(first.where("rep = root"), "rep").select("rep", "cluster", "n")
        again = heads.groupBy("cluster").agg(F.ceil(F.sum("n") / block).alias("parts"))
        regrouped = cut(heads.join(again, "cluster").select("rep", _block(F.col("cluster"), F.xxhash64("rep"), F.col("parts"))), "jaccard-heads")
        second = _classes(docs, key, text, regrouped, words, share)
        links = cut(links.unionByName(second.where("rep != root").select(F.col("rep").alias("src"), F.col("root").alias("dst"))), "jaccard-links")
        rest = cut(_residual(met.join(large.select("rep").distinct(), "rep"), connected_components(links), block, share), "jaccard-rest")
        third = _classes(docs, key, text, rest, words, share)
        links = links.unionByName(third.where("rep != root").select(F.col("rep").alias("src"), F.col("root").alias("dst")))
        final = connected_components(links).withColumnRenamed("id", "rep")

    final = final.groupBy("rep").agg(F.min("component").alias("component"))  # a repeated row is met as often as it stands there
    named = reps.join(final, "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    out = sets.join(named, ["s1", "s2"], "left")
    linked = (F.col("n") > 0) & F.col("key").isNotNull()
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(linked, F.col("component")).otherwise(F.col("key")).alias("component_id"))


def _met(docs: DataFrame, text: str, reps: DataFrame, words: int, share: int, zone: int) -> DataFrame:
    """(token, rep, n, at): the prefixes of the sets of ``reps``."""
    met = cut(prefixes(shared(dealt_out(docs, text, words, share, zone)), share, zone), "jaccard-prefixes")
    return cut(met.join(reps, ["s1", "s2"]).select("token", "rep", "n", "at"), "jaccard-met")


def _placed(met: DataFrame, share: int, block: int) -> DataFrame:
    """(rep, cluster, parts, n, block): the candidate clusters and their blocks."""
    clusters = connected_components(near(met, share)).withColumnsRenamed({"id": "rep", "component": "cluster"})
    sized = clusters.join(met.groupBy("rep").agg(F.max("n").alias("n")), "rep")
    parts = sized.groupBy("cluster").agg(F.ceil(F.sum("n") / block).alias("parts"))
    return cut(sized.join(parts, "cluster").select("rep", "cluster", "parts", "n", _block(F.col("cluster"), F.col("rep"), F.col("parts"))), "jaccard-blocks")


def _block(cluster: Column, by: Column, parts: Column) -> Column:
    return F.concat_ws("/", cluster.cast("string"), F.pmod(F.xxhash64(by), parts).cast("string")).alias("block")


def _residual(met: DataFrame, classes: DataFrame, block: int, share: int) -> DataFrame:
    """(rep, block): each set beside those of other classes with which it shares a prefix n-gram that leaves room for a link.

    For an n-gram, the sets of its most frequent class are only met, not asked about, so a class that
    holds nearly all sets costs no more than its few outsiders do.
    """
    told = cut(met.join(classes, F.col("rep") == F.col("id"), "left").select("token", "rep", "n", "at", F.coalesce("component", "rep").alias("class")), "jaccard-told")
    each = told.groupBy("token", "class").agg(F.count("*").alias("k"))
    main = each.groupBy("token").agg(F.max(F.struct("k", "class")).alias("top"), F.count("*").alias("classes")).where("classes > 1").select("token", F.col("top.class").alias("main"))
    asked = told.join(main, "token").where("class != main").select("token", F.col("rep").alias("asks"), F.col("class").alias("own"), F.col("n").alias("size"), F.col("at").alias("place"))
    fits = (100 + share) * F.least(F.col("n") - F.col("at"), F.col("size") - F.col("place")) >= share * (F.col("n") + F.col("size"))
    pairs = cut(asked.join(told, "token").where((F.col("own") != F.col("class")) & fits).select("asks", "rep", "n").distinct(), "jaccard-pairs")
    parts = pairs.groupBy("asks").agg(F.ceil(F.sum("n") / block).alias("parts"))
    dealt = pairs.join(parts, "asks").select("asks", "rep", _block(F.col("asks"), F.col("rep"), F.col("parts")))
    return dealt.select("rep", "block").unionByName(dealt.select(F.col("asks").alias("rep"), "block").distinct())
