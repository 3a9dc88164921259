"""Line dedup: exact repeats and near repeats by a segment-partition edit join.

Everything here is DataFrame functions; nothing runs in Python.

A line goes if an equal line stands earlier in the corpus, or if an earlier line
is near it: within ``allowed`` edits of code points, a number that grows with the
square root of the longer line's length. The longer line of a pair is cut into
that many segments and one more, so one of them stands unspoiled in the other
line. Segments are indexed by class of length, number and content; the
substrings of each line that can meet them are probed; sketches of their
code points and pairs of these thin out what meets by chance; a banded bit-parallel edit distance decides.

The segments of the front half are placed from the line's start and those of the
back half from its end, all of one length in a class. There is an unspoiled
segment with as many edits before it as segments and no more edits after it than
segments, so a front one is off by its number at most and a back one by that
counted from the end. This makes the substrings that are probed few (half the
square of the edits) and the same for all lengths of a class.

Order is that of the key, then of the text's hash, then of the line number.

Defined results: a line counts if it holds a non-blank character, others always
stay; lines of fewer than 10 code points are allowed no edit, so only equal ones
go; a null text stays null; a text that loses all its lines becomes empty; rows
equal in key and text are one document and get equal results; an empty table
gives an empty result; other columns are carried along unchanged, whatever their
names but for ``_gone``, which is replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import store

#: Lines that are looked up before their keys are dealt out: the most frequent ones, so many at most.
HEAVY = 1000
#: Earliest lines of a key that all others are held against, round by round; at last (0) all that is left is held against all earlier lines.
PIVOTS = (1, 8, 0)
#: Parts of a line that are looked for in the other before the distance is taken.
_PARTS = 32
#: Words of 64 bits in the membership filter that is sent to every task: a fixed size.
_FILTER_WORDS = 1 << 16
#: The most edits between near lines: a band of twice as many cells and one has to fit into a word.
_MOST = 30


def cut(df: DataFrame, name: str) -> DataFrame:
    """A working table; nearly all of its columns are hashes."""
    return store.cut(df, name, dictionary=False)


def edits(n: int) -> int:
    """Edits between near lines if the longer has ``n`` code points: a quarter of the square root, but two from 20 and one from 10."""
    return 0 if n < 10 else 1 if n < 20 else max(2, min(_MOST, int(n**0.5 / 4)))


def allowed(n: Column) -> Column:
    """``edits`` of a column."""
    return F.when(n < 10, 0).when(n < 20, 1).otherwise(F.greatest(F.lit(2), F.least(F.lit(_MOST), F.floor(F.sqrt(n) / 4)))).cast("int")


#: First length of each class; all lines of a class are allowed the same edits.
_CLASSES = (10, 20, 30, 42, *((4 * t) ** 2 for t in range(2, _MOST + 1)))


def _named(df: DataFrame, key: str, text: str) -> DataFrame:
    """(d, r1, r2, line_no, line): the counted lines of ``df`` with their document's place in the order."""
    # hashed before the lines are dealt out: a text is hashed once, not once a line
    hashed = df.select(F.col(key).alias("d"), F.col(text).alias("text"), *_row_hash(key, text))
    return hashed.select("d", "r1", "r2", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _row_hash(key: str, text: str) -> list[Column]:
    return [F.xxhash64(key, text).alias("r1"), F.xxhash64(F.lit("row"), key, text).alias("r2")]


def _counts(line: Column) -> Column:
    """Whether a line holds a non-blank character."""
    # trimmed on the left alone, which ends at the first such character
    return F.ltrim(line, F.lit(" \t\x0b\f\r")) != ""


def _line_hash(line: Column) -> list[Column]:
    """Two hashes of a line; the last two bits of the first are free for marks."""
    return [F.xxhash64(line).bitwiseAND(F.lit(-4)).alias("h"), F.xxhash64(F.lit("line"), line).alias("h2")]


#: Kinds of code points whose counts are compared, 16 to a word; they are summed four to a word, so lines longer than the limit have none.
_KINDS, _COUNTED = 32, (1 << 15) - 1
#: Of 400 seeds the one that deals the frequent characters of European texts out most evenly.
_SEED = 163
#: Codes of the numbers modulo 8, four bits each: as many bits differ as steps lie between two numbers around the circle.
_CIRCLE = (0b0000, 0b0001, 0b0011, 0b0111, 0b1111, 0b1110, 0b1100, 0b1000)


def _sketches(lines: DataFrame) -> DataFrame:
    """(h, s0 .. s3, l0, l1): for each (h, line) whether the pairs of neighbouring code points of each of 256 kinds are odd in number, and the counts of 32 kinds of code points modulo 8, coded.

    An edit takes two pairs away and adds two at most (the last code point makes a pair with the end), so it turns
    four bits of ``s`` at most; it takes one code point away and adds one, so it turns two bits of ``l``. Very long
    lines have null for ``l``.
    """
    units = lines.select("h", F.encode("line", "UTF-32").alias("units"), F.length("line").alias("n"))
    each = units.select("h", "units", (F.col("n") <= _COUNTED).alias("counted"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    kind = lambda size, kinds, *seed: F.xxhash64(*seed, F.substr("units", 4 * F.col("i") - 3, F.lit(size))).bitwiseAND(F.lit(kinds - 1))
    placed = each.select("h", kind(8, 256).alias("s"), F.when(F.col("counted"), kind(4, _KINDS, F.lit(_SEED))).alias("l"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    bit = F.call_function("shiftleft", one, F.col("s").bitwiseAND(F.lit(63)).cast("int"))
    field = F.call_function("shiftleft", one, (16 * F.col("l").bitwiseAND(F.lit(3))).cast("int"))
    odd = [F.bit_xor(F.when(F.shiftright("s", 6) == w, bit).otherwise(none)).alias(f"s{w}") for w in range(4)]
    sums = [F.sum(F.when(F.shiftright("l", 2) == w, field).when(F.col("l").isNotNull(), none)).alias(f"_{w}") for w in range(_KINDS // 4)]
    code = lambda k: F.get(F.array(*map(F.lit, _CIRCLE)), F.shiftright(f"_{k // 4}", 16 * (k % 4)).bitwiseAND(F.lit(7)).cast("int")).cast("long")
    word = lambda w: reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(code(16 * w + i), 4 * i) for i in range(16)])
    return placed.groupBy("h").agg(*odd, *sums).select("h", *(f"s{w}" for w in range(4)), *(word(w).alias(f"l{w}") for w in range(_KINDS // 16)))


def _differ(a: str, b: str, word: str, words: int) -> Column:
    """Bits in which some words of two rows differ: four times the edit distance at most for pairs of code points, twice for their counts."""
    return reduce(add, [F.bit_count(F.col(f"{a}.{word}{w}").bitwiseXOR(F.col(f"{b}.{word}{w}"))) for w in range(words)])


def _parts_meet(long: Column, short: Column, most: Column, parts: Column) -> Column:
    """Whether enough of ``parts`` parts of ``long`` stand in ``short`` near their places: an edit spoils one of them at most.

    Both are lines at four bytes a code point; a part may be found between two code points, which only lets more through.
    """
    n = F.floor(F.octet_length(long) / 4)

    def spoiled(i: Column) -> Column:
        start, end = F.floor(n * i / parts).cast("int"), F.floor(n * (i + 1) / parts).cast("int")
        first = F.greatest(start - most, F.lit(0))
        return (~F.contains(F.substr(short, 4 * first + 1, 4 * (end + most - first)), F.substr(long, 4 * start + 1, 4 * (end - start)))).cast("int")

    return F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(0), lambda a, i: F.when(a > most, a).otherwise(a + spoiled(i))) <= most


def codes(line: Column) -> Column:
    """The characters of a line as numbers."""
    return F.transform(F.split(line, ""), lambda c: F.ascii(c))


def _common(a: Column, b: Column) -> Column:
    """How many codes two arrays share from the front."""
    n = F.least(F.size(a), F.size(b))
    differs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x != y)
    at = F.array_position(differs, True).cast("int")
    return F.when(at > 0, at - 1).otherwise(n)


def trimmed(pairs: DataFrame, a: str, b: str, most: Column) -> DataFrame:
    """``pairs`` with the arrays ``a`` and ``b`` cut to where they differ and a little of what they share around it.

    That leaves their distance as it is; ``most`` + 1 shared codes stay on either side.
    """
    front = pairs.withColumn("_front", F.greatest(_common(F.col(a), F.col(b)) - most - 1, F.lit(0)))
    rest = lambda c: F.slice(F.col(c), F.col("_front") + 1, F.size(c))
    left = front.withColumns({a: rest(a), b: rest(b)})
    back = left.withColumn("_back", F.greatest(_common(F.reverse(a), F.reverse(b)) - most - 1, F.lit(0)))
    part = lambda c: F.slice(F.col(c), F.lit(1), F.greatest(F.size(c) - F.col("_back"), F.lit(0)))
    return back.withColumns({a: part(a), b: part(b)}).drop("_front", "_back")


def edit_distance(long: Column, short: Column, most: Column) -> Column:
    """Levenshtein distance of two arrays of codes, ``long`` not the shorter, if it is at most ``most``; else something larger.

    Both hold more than ``most`` codes, and ``most`` is from 1 to 30.

    Bit-parallel over a diagonal band of 2 * most + 1 cells: one word of vertical
    differences moves down the diagonal with each character of the shorter text.
    It ends early: values along a diagonal never fall and neighbouring cells differ by one at
    most, so no cell of the last diagonal is less than the band's lower edge minus the way to it.
    """
    m, n = F.size(long), F.size(short)
    one, ended = F.lit(1).cast("long"), F.lit(1000).cast("long")
    up = lambda x, k: F.call_function("shiftleft", x, k.cast("int"))

    def walk(p: Column) -> Column:
        mask, top = p["mask"], p["top"]

        def step(acc: Column, j: Column) -> Column:
            # j from 0; bit i of a word stands for row j - most + i, rows counted from 0
            here, first, last = F.get(short, j), F.greatest(j - most, F.lit(0)), F.least(j + most, m - 1)
            cells = F.aggregate(F.slice(long, first + 1, last - first + 1), F.lit(0).cast("long"), lambda bits, c: F.when(c == here, F.shiftright(bits, 1).bitwiseOR(top)).otherwise(F.shiftright(bits, 1)))
            match = F.call_function("shiftright", cells, (j + most - last).cast("int"))
            return F.struct(match.alias("match"), acc["vp"].alias("vp"), acc["vn"].alias("vn"), acc["d"].alias("d"), j.alias("j"))

        def across(s: Column) -> Column:
            vp, vn = s["vp"], s["vn"]
            d0 = (s["match"].bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(s["match"]).bitwiseOR(vn).bitwiseAND(mask)
            # positive once the band's lower edge has left the last row
            past = F.greatest(F.lit(0), s["j"] - (m - 1 - most))
            return F.struct(d0.alias("d0"), vp.alias("vp"), vn.alias("vn"), past.alias("past"), s["d"].alias("d"))

        def down(s: Column) -> Column:
            hp = s["vn"].bitwiseOR(F.bitwise_not(s["d0"].bitwiseOR(s["vp"]))).bitwiseAND(mask)
            hn = s["d0"].bitwiseAND(s["vp"])
            k = 2 * most - s["past"]
            moved = F.when(s["past"] == 0, 1 - _bit_at(s["d0"], 2 * most)).otherwise(_bit_at(hp, k) - _bit_at(hn, k))
            below = F.shiftright(s["d0"], 1)
            return F.struct(
                hn.bitwiseOR(F.bitwise_not(below.bitwiseOR(hp)).bitwiseAND(mask)).alias("vp"),
                below.bitwiseAND(hp).alias("vn"),
                (s["d"] + moved).alias("d"),
            )

        def on(acc: Column, j: Column) -> Column:
            far = (acc["d"] > p["limit"]) & (j <= m - most)
            return F.when(acc["d"] >= ended, acc).when(far, F.struct(acc["vp"].alias("vp"), acc["vn"].alias("vn"), ended.alias("d"))).otherwise(_let(_let(step(acc, j), across), down))

        start = F.struct((mask - (up(one, most) - 1)).alias("vp"), F.lit(0).cast("long").alias("vn"), most.cast("long").alias("d"))
        return F.aggregate(F.sequence(F.lit(0), n - 1), start, on, lambda acc: acc["d"])

    fixed = F.struct(up(one, 2 * most).alias("top"), (up(one, 2 * most + 1) - 1).alias("mask"), (2 * most - (m - n)).cast("long").alias("limit"))
    walked = _let(fixed, walk)
    return F.when(m - n > most, (m - n).cast("long")).otherwise(walked)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bit_at(word: Column, k: Column) -> Column:
    return F.call_function("shiftright", word, k.cast("int")).bitwiseAND(F.lit(1))


def _place(h: Column) -> tuple[Column, Column]:
    """Word and bit of a hash in the membership filter; its last bit says nothing."""
    return F.shiftright(h, 1).bitwiseAND(F.lit(_FILTER_WORDS - 1)), F.shiftright(h, 32).bitwiseAND(F.lit(63)).cast("int")


def _filter(df: DataFrame, h: str) -> DataFrame:
    """A membership filter of bounded size: (_word, _bits)."""
    word, bit = _place(F.col(h))
    return df.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))


def _hit(h: Column) -> Column:
    return _bit_at(F.col("_bits"), _place(h)[1]) == 1


def _maybe(df: DataFrame, h: str, members: DataFrame) -> DataFrame:
    """The rows of ``df`` that the filter lets through: all members, few others."""
    # at most _FILTER_WORDS rows of two numbers
    return df.join(F.broadcast(members), _place(F.col(h))[0] == F.col("_word")).where(_hit(F.col(h))).drop("_word", "_bits")


def _class(n: Column) -> Column:
    """The number of the class of lines of ``n`` code points."""
    return reduce(add, [(n >= c).cast("int") for c in _CLASSES]) - 1


def _fronted(lines: DataFrame) -> DataFrame:
    """``lines`` with own, p0 and p1: the class of each line, and the hash of its first segment there and in the next class."""
    sizes = F.array(*(F.lit(c // (edits(c) + 1)) for c in _CLASSES))
    front = lambda c: F.xxhash64(F.substr("line", F.lit(1), F.get(sizes, c)))
    return lines.withColumn("own", _class(F.length("line"))).withColumns({"p0": front(F.col("own")), "p1": front(F.col("own") + 1)})


def _keys(lines: DataFrame) -> DataFrame:
    """(k, g): for each line ``units`` (four bytes a code point) of hash ``h`` its index entries and its probes; ``g`` is the hash, its last bit set for what is a probe only and the one before for a first segment.

    A line is indexed in its own class and probes that one and, where a longer line of the next could be near, that too.
    The entry of a segment and the probe at its place are one row.
    """
    n = F.col("n")
    firsts = F.array(*map(F.lit, _CLASSES))
    most = F.array(*(F.lit(edits(c)) for c in _CLASSES))
    sizes = F.array(*(F.lit(c // (edits(c) + 1)) for c in _CLASSES))
    classed = lines.withColumn("own", _class(n)).withColumn("next", (F.get(firsts, F.col("own") + 1) - F.get(most, F.col("own") + 1) <= n))
    each = classed.select("h", "units", "n", "own", F.explode(F.sequence("own", F.col("own") + F.coalesce(F.col("next").cast("int"), F.lit(0)))).alias("c"))
    sized = each.select("h", "units", "n", "own", "c", F.get(most, F.col("c")).alias("t"), F.get(sizes, F.col("c")).alias("size"))
    cut_ = sized.select("h", "units", "n", "own", "c", "t", "size", F.explode(F.sequence(F.lit(0), F.col("t"))).alias("i"))
    # a segment of the front half may be off by its number, one of the back half by that from the end
    reach = F.least(F.col("i"), F.col("t") - F.col("i"))
    moved = cut_.select("h", "units", "n", "own", "c", "t", "size", "i", F.explode(F.sequence(-reach, reach)).alias("s"))
    probe = (F.col("s") != 0) | (F.col("c") != F.col("own"))
    place = F.when(F.col("i") <= F.shiftright("t", 1), F.col("i") * F.col("size")).otherwise(n - (F.col("t") + 1 - F.col("i")) * F.col("size")) + F.col("s")
    placed = moved.select("h", "units", "n", "c", "i", "size", probe.alias("probe"), place.cast("int").alias("at")).where((F.col("at") >= 0) & (F.col("at") + F.col("size") <= n))
    key = F.xxhash64(F.col("c") * 64 + F.col("i"), F.substr("units", 4 * F.col("at") + 1, 4 * F.col("size")))
    return placed.select(key.alias("k"), (F.col("h") + F.col("probe").cast("long") + 2 * (F.col("i") == 0).cast("long")).alias("g"))


def near_lines(docs: DataFrame, firsts: DataFrame, key: str, text: str) -> DataFrame:
    """(h): the lines that an earlier line is near to. ``firsts`` has (h, h2, first, n) of each distinct line."""
    lines = _named(docs, key, text).where(_counts(F.col("line")) & (F.length("line") >= _CLASSES[0])).select("line", *_line_hash(F.col("line")))
    # the most frequent lines are dealt out once each: their text is read where they stand first
    most = cut(firsts.where("n > 1").orderBy(F.desc("n"), "h", "h2").limit(HEAVY).select("h", "h2", "first.r1", "first.r2", "first.line_no"), "heavy-lines")
    heavy = F.broadcast(most)  # HEAVY rows at most
    stands = docs.select(F.col(text).alias("text"), *_row_hash(key, text)).join(heavy, ["r1", "r2"]).select("h", "h2", F.get(F.split("text", "\n"), F.col("line_no")).alias("line"))
    once = stands.where(F.length("line") >= _CLASSES[0]).groupBy("h", "h2").agg(F.first("line").alias("line"))  # repeated rows
    spread = lines.join(heavy.select("h", "h2"), ["h", "h2"], "left_anti").unionByName(once)
    units = spread.select("h", F.encode("line", "UTF-32").alias("units"))
    keys = _keys(units.select("h", "units", (F.octet_length("units") / 4).cast("int").alias("n")))
    # a key tells something only where an index entry meets a probe of another line: few of all keys
    one = Window.partitionBy("k")
    line, mark = F.col("g").bitwiseAND(F.lit(-4)), F.col("g").bitwiseAND(F.lit(1))
    meets = (F.min(line).over(one) != F.max(line).over(one)) & (F.min(mark).over(one) == 0)
    sized = keys.withColumns({"meets": meets, "size": F.count("*").over(one)}).where("meets")
    met = cut(sized.select("k", line.alias("h"), (mark == 1).alias("probe"), (F.col("g").bitwiseAND(F.lit(2)) == 2).alias("front"), "size").distinct(), "near-line-keys")

    members = cut(met.select("h").distinct(), "near-line-members")
    few = _filter(members, "h")
    # joined, not semi-joined: that would be pushed below the filter and shuffle all lines
    texts = _maybe(lines.select("h", "line"), "h", few).join(members, "h").groupBy("h").agg(F.first("line").alias("line"))
    order = _maybe(firsts.select("h", "first"), "h", few).join(members, "h").groupBy("h").agg(F.min("first").alias("first"))
    told = cut(texts.join(order, "h").select("h", "line", "first", F.length("line").alias("n")).withColumn("t", allowed(F.col("n"))), "near-line-texts")
    drawn = cut(_fronted(told).drop("line").join(_sketches(told), "h").withColumn("place", F.struct("first", "h")).drop("first"), "near-line-sketches")
    counted = cut(met.join(drawn, "h"), "near-line-meetings")
    near, tested, done = None, None, 0
    # first against the earliest lines of each key; what is found near by then needs no more pairs
    for pivots in PIVOTS:
        # with one row more than there were earliest ones, all rows of a key have met
        counted, done = counted.where(F.col("size") > done + 1), pivots
        later = counted if near is None else counted.join(near, "h", "left_anti")
        if pivots:
            rank = F.row_number().over(Window.partitionBy("k").orderBy("place"))
            earliest = counted.groupBy("k").agg(F.min("place").alias("place")) if pivots == 1 else counted.withColumn("rank", rank).where(F.col("rank") <= pivots).select("k", "place")
            earlier = earliest.select("k", "place.h").distinct().join(drawn, "h").withColumns({"probe": F.lit(None).cast("boolean"), "front": F.lit(True)})
        else:
            earlier = counted
        pairs = _meeting(later.alias("b"), earlier.alias("a"))
        pairs = cut(pairs if tested is None else pairs.join(tested, ["h", "other"], "left_anti"), "near-line-pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = cut(_near(pairs, told), "near-lines")
        near = found if near is None else near.unionByName(found)
    return near


def _meeting(later: DataFrame, earlier: DataFrame) -> DataFrame:
    """(h, other): the lines of ``later`` (b) and those of ``earlier`` (a) with the same key that may be near; of two known marks one has to be an index entry.

    Lines that begin alike meet by their first segment and need no other, as some shortest edit leaves it unspoiled.
    """
    # the edits allowed grow with the length; what tells most pairs apart at the least cost stands first
    most = F.greatest("a.t", "b.t")
    met = (F.col("a.k") == F.col("b.k")) & (F.abs(F.col("a.n") - F.col("b.n")) <= most) & (_differ("a", "b", "s", 4) <= 4 * most)
    close = (F.col("a.place") < F.col("b.place")) & ~F.coalesce(F.col("a.probe") & F.col("b.probe"), F.lit(False)) & F.coalesce(_differ("a", "b", "l", 2) <= 2 * most, F.lit(True))
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    alike = F.when(a("own") == b("own"), a("p0") == b("p0")).when(a("own") == b("own") + 1, a("p0") == b("p1")).when(b("own") == a("own") + 1, b("p0") == a("p1")).otherwise(False)
    return later.join(earlier, met & close & (a("front") | ~alike)).select(F.col("b.h").alias("h"), F.col("a.h").alias("other")).distinct()


def _near(pairs: DataFrame, told: DataFrame) -> DataFrame:
    """(h): the lines that their ``other`` is near to."""
    # most lines are in no pair: they are not shuffled
    told = _maybe(told, "h", _filter(pairs.select("h").union(pairs.select("other")), "h"))
    named = lambda h, line: told.select(F.col("h").alias(h), F.col("line").alias(line), F.col("n").alias(f"{line}_n"))
    both = pairs.join(named("other", "x"), "other").join(named("h", "y"), "h")
    turned = F.col("x_n") >= F.col("y_n")
    sides = both.select("h", F.when(turned, F.col("x")).otherwise(F.col("y")).alias("long"), F.when(turned, F.col("y")).otherwise(F.col("x")).alias("short"), allowed(F.greatest("x_n", "y_n")).alias("most"))

    def meets(p: Column) -> Column:
        # few parts first, then parts of four code points
        fine = F.greatest(F.lit(_PARTS), F.floor(F.octet_length(p["a"]) / 16).cast("int"))
        return _parts_meet(p["a"], p["b"], p["most"], F.lit(_PARTS)) & _parts_meet(p["a"], p["b"], p["most"], fine)

    likely = sides.where(_let(F.struct(F.encode("long", "UTF-32").alias("a"), F.encode("short", "UTF-32").alias("b"), "most"), meets))
    # the distance is the costly part: it is spread over all tasks, however few bytes the pairs have
    coded = likely.repartition("h", F.xxhash64("long", "short")).withColumns({c: codes(F.col(c)) for c in ("long", "short")})
    # written before the test, as a filter would be pushed below the arrays and compute them anew at each use
    ready = cut(trimmed(coded, "long", "short", F.col("most")), "near-line-likely")
    return ready.where(edit_distance(F.col("long"), F.col("short"), F.col("most")) <= F.col("most")).select("h").distinct()


def dropped_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(r1, r2, gone): for each document that loses lines, their sorted numbers from 0."""
    seen = cut(_named(docs, key, text).where(_counts(F.col("line"))).select("d", "r1", "r2", "line_no", *_line_hash(F.col("line"))), "lines")
    firsts = cut(seen.groupBy("h", "h2").agg(F.min(F.struct("d", "r1", "r2", "line_no")).alias("first"), F.count("*").alias("n")), "first-lines")
    again = seen.join(firsts.where("n > 1"), ["h", "h2"]).where(~F.struct("d", "r1", "r2", "line_no").eqNullSafe(F.col("first"))).select("r1", "r2", "line_no")
    near = near_lines(docs, firsts, key, text)
    close = seen.join(near, "h", "left_semi").select("r1", "r2", "line_no")
    return again.unionByName(close).groupBy("r1", "r2").agg(F.sort_array(F.collect_set("line_no")).alias("gone"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and ``_gone``, the numbers of those lines (or null).

    Documents that certainly lose nothing, by a filter of fixed size, pass by without a shuffle.
    """
    lost = cut(dropped_lines(docs, key, text), "dropped-lines")
    # the row stands in a struct, so that no name of its columns meets one of these
    marked = docs.select(F.struct(*(F.col(c) for c in docs.columns if c != "_gone")).alias("row"), *_row_hash(key, text))
    members = F.broadcast(_filter(lost, "r1"))  # _FILTER_WORDS rows at most
    tested = marked.join(members, _place(F.col("r1"))[0] == F.col("_word"), "left").withColumn("in", F.coalesce(_hit(F.col("r1")), F.lit(False)))
    untouched = tested.where(~F.col("in")).select("row.*", F.lit(None).cast("array<int>").alias("_gone"))
    joined = tested.where("in").join(lost, ["r1", "r2"], "left")
    old = F.col("row").getField(text)
    left = F.array_join(F.filter(F.split(old, "\n"), lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    rest = joined.select(F.when(F.col("gone").isNull(), F.col("row")).otherwise(F.col("row").withField(text, left)).alias("row"), F.col("gone").alias("_gone"))
    return untouched.unionByName(rest.select("row.*", "_gone"))
