"""Corpus operators that read one row at a time, against plain versions of the same."""

from __future__ import annotations

import collections
import hashlib
import html as entities
import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, chat, decontaminate, html_extract, pii, quality_rules, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " ", "  ", "a  b", " a", "a ", "a \nb", "a\n b", "x\n\n y\t z", "<|endoftext|>", "foo  <|endoftext|>  bar", "it's 12 'll  '", "é ñ 日本 語", "a\x1c b", "a　 b  c", "\n", "😀 😀", "  lead", "end  ", "x" * 50_000]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


# --- chat


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<\\s>\\\\[INST", "[", "<", "[[/INST]]", "\\", "", None, "[:]\n[ROLE]", "日本😀<s>"]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(hard)] + [(2, 0, "tool", "x"), (2, 1, None, "y"), (2, 1, None, "y"), (None, None, None, None), (3, 0, "assistant", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1)).withColumn("formatted", F.lit("clash"))
    out = {r.conv_id: r for r in chat.format_conversations(df).select("*", chat.parse_formatted(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("trained")).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [(r, t or "") for _, _, r, t in rows[: len(hard)]]
    assert out[1].valid and out[1].trained == "".join(t or "" for t in hard[1::2])
    assert [(t.role, t.text) for t in out[2].turns] == [("tool", "x"), ("", "y"), ("", "y")] and not out[2].valid and out[2].first_bad_turn == 0
    assert [(t.role, t.text) for t in out[None].turns] == [("", "")]
    assert not out[3].valid and out[3].first_bad_turn == 0
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_refuses_unsafe_templates():
    with pytest.raises(ValueError):
        chat.ChatTemplate(roles={"user": chat.Turn("<a", "b<")})


# --- BPE


def test_bpe_equals_the_library(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    rows = [*docs[:60], *((10_000 + i, t) for i, t in enumerate(ODD)), (10_000, ""), (None, "null key")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("clash")).write.parquet(str(tmp_path / "documents.parquet"))
    got = collections.Counter(map(tuple, queries.op2_bpe(spark, str(tmp_path)).collect()))
    want = collections.Counter()
    for key, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        want[(key, len(ids), digest(",".join(map(str, ids))), digest(tokenizer.decode(ids, skip_special_tokens=False)))] += 1
    assert got == want
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(empty, PATH).count() == 0
    lists = spark.createDataFrame([(1, None), (2, [50256, 220])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(lists, PATH).collect()} == {1: "", 2: "<|endoftext|> "}


# --- quality rules


def brute_counts(text):
    words = WORD.findall(text or "")
    times = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {k for i in range(len(words) - 2) if times[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(covered)


def test_quality_counts(docs):
    random.seed(1)
    made = [" ".join(random.choice("ab") for _ in range(random.randint(0, 30))).replace("a b", "a\nb") for _ in range(300)]
    for text in [*(t for _, t in docs), *ODD, *made]:
        n, chars, symbols, _, dups, repeated, _ = quality_rules.measure(text)
        assert (n, chars, symbols, dups, repeated) == brute_counts(text)


def test_quality_thresholds_follow_the_group(spark, sf_dir):
    plain = [f"word{i} " * 3 + " ".join(f"w{i}x{j} and" for j in range(60)) for i in range(40)]
    rows = [(i, t, "en", "a") for i, t in enumerate(plain)] + [(100, " ".join(f"&&w{j}## $$" for j in range(80)), "en", "a"), (101, None, None, None), (102, "few words", "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("key", F.lit(1)).withColumn("limits", F.lit(2))
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    assert all(got[i].kept for i in range(40)) and not got[100].kept and "symbol_share" in got[100].failed
    assert got[101].base_failed and got[102].base_failed and len(got) == len(rows)
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_sketch_merges_and_bounds_its_error(spark):
    values = spark.range(1, 5001).select((F.col("id") % 7).alias("g"), F.lit("r").alias("rule"), (F.col("id") / 10.0).alias("value"))
    fine = quality_rules.sketch(values, ["g"])
    merged = fine.groupBy("rule", "bin").agg(F.sum("n").alias("n"))
    row = quality_rules.quantiles(merged, [], {"q": 0.25, "m": 0.5}).first()
    assert abs(row.q / 125 - 1) < 0.06 and abs(row.m / 250 - 1) < 0.06 and row["rows"] == 5000


# --- decontamination


def brute_hits(docs, bench, window=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for key, text in bench:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(str(key))
    out = {}
    for key, text in docs:
        w, hit, items = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    items |= windows[tuple(w[i : i + n])]
                    hit |= set(range(i, i + n))
        out[key] = (len(w), len(hit), sorted(items))
    return out


def test_decontamination_equals_brute_force(spark, sf_dir, monkeypatch):
    random.seed(7)
    vocabulary = ["The", "of", "cat", "é", "9", "run", "Zed"]
    say = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    bench = [(i, say(random.randint(0, 25))) for i in range(12)] + [(20, "Solo"), (21, None), (3, "of cat of")]
    docs = [(i, say(random.randint(0, 60))) for i in range(150)] + [(200 + i, f"intro, {t}! outro") for i, (_, t) in enumerate(bench)] + [(900, None), (901, "")]
    want = brute_hits(docs, bench)
    b = spark.createDataFrame(bench, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("matches", "row", "hits", "_text")})
    d = d.unionByName(d.where("doc_id = 3"))
    for block in (4 << 20, 40):
        monkeypatch.setattr(decontaminate, "BENCH_BLOCK", block)
        got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.scan(d, b, keep=["doc_id"]).collect()}
        assert got == want
    kept = decontaminate.decontaminate(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {k for k, v in want.items() if not v[1]}
    assert decontaminate.scan(d, b.limit(0)).where("n_hit > 0").count() == 0 and decontaminate.scan(d.limit(0), b).count() == 0


def test_suffix_array_and_longest_matches_equal_brute_force():
    import numpy as np

    random.seed(12)
    for _ in range(60):
        say = lambda n: " ".join(random.choice("abc") for _ in range(n))
        bench = decontaminate.build([(str(i), say(random.randint(0, 14))) for i in range(5)], 4)
        words = bench.stream.tolist()
        tail = lambda i: (words[i:] + [0])[: (words[i:] + [0]).index(0)]
        order = [tail(i) for i in bench.suffixes]
        assert order == sorted(order) and sorted(bench.suffixes) == list(range(len(words)))
        text = decontaminate.words_of(say(40))
        stream = np.array([bench.vocabulary.get(w, 0) for w in text] + [0])
        length, there = decontaminate.longest(stream, bench, np.arange(len(text)))
        shared = lambda i, j: next((k for k, (x, y) in enumerate(zip([*stream[i:], 0], [*tail(j), 0])) if x != y or not x), 0)
        for i, n in enumerate(length):
            best = max((shared(i, j) for j in range(len(words))), default=0)
            assert n == best and (not n or shared(i, int(there[i])) == n)


def test_items_with_a_common_preamble_make_no_pairs(spark):
    preamble = " ".join(f"p{i}" for i in range(40))
    bench = spark.range(10_000).selectExpr("id AS item_id", f"concat('{preamble} ', id) AS text")
    docs = spark.range(60).selectExpr("id AS doc_id", f"concat('x {preamble} ', id, ' y') AS text")
    got = decontaminate.scan(docs, bench).collect()
    assert all(r.n_hit == 41 and len(r["items"]) == 10_000 and [tuple(m)[1:] for m in r.matches] == [(0, 1, 41)] for r in got) and len(got) == 60


def test_longest_matches_are_verbatim(spark):
    item = " ".join(f"w{i}" for i in range(30))
    d = spark.createDataFrame([(1, "x y " + " ".join(f"W{i}" for i in range(5, 22)) + " z")], "doc_id long, text string")
    row = decontaminate.scan(d, spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert [tuple(m) for m in row.matches] == [("7", 5, 2, 17)]


# --- personal data


def plain_spans(text):
    digits = lambda t: re.sub("[^0-9]", "", t)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_equal_the_patterns(docs):
    random.seed(3)
    made = ["".join(random.choice("ab1239@@..-_ +() 00000") for _ in range(random.randint(1, 60))) for _ in range(4000)]
    for text in [*(t for _, t in docs), *made, "4" + "1" * 15 + " x", "a" * 3000 + "@b.c"]:
        assert pii.detect(text) == plain_spans(text)


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail john.doe [at] mail [dot] example [dot] com now", "email", "john.doe [at] mail [dot] example [dot] com"),
        ("bob at mail dot example dot com", "email", "bob at mail dot example dot com"),
        ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("call plus one six one four five five five eight zero zero one", "phone", "plus one six one four five five five eight zero zero one"),
        ("192[.]168[.]0[.]7", "ip", "192[.]168[.]0[.]7"),
        ("card 4１11 1111 1111 1111", "card", "4１11 1111 1111 1111"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, span):
    (found,) = pii.find(text)
    assert found[0] == kind and text[found[1] : found[2]] == span and not found[3]


def test_prose_has_no_disguised_spans():
    assert pii.find("one of the two cats, at noon. Dot the i; five or six of them, eight at most") == [] and pii.find(None) == []


def test_pii_query(spark, tmp_path):
    rows = [(1, "a@b.co 1.2.3.4"), (2, None), (2, None), (3, "x [at] y [dot] org")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(0)).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op9_pii(spark, str(tmp_path)).collect()))
    base = "email:0:6,ip:7:14"
    assert got == [(1, 1, 1, 0, 0, digest(base), base), (2, 0, 0, 0, 0, digest(""), ""), (2, 0, 0, 0, 0, digest(""), ""), (3, 0, 0, 0, 0, digest(""), "email:0:18")]
    one = spark.createDataFrame([("a@b.co 1.2.3.4",)], "text string")
    assert pii.detect_spans(one, keep=["text"]).select(pii.redact(F.col("text"), F.col("spans")).alias("r")).first().r == "<email> <ip>"


# --- pages


def test_pages_give_their_article(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("text", F.lit("clash"))
    for row, got in zip(pages.orderBy("page_id").collect(), html_extract.extract_main_text(pages, keep=["page_id"]).orderBy("page_id").collect()):
        article = re.search(r"<article>(.*)</article>", row.html, re.S)[1]
        parts = [" ".join(entities.unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got.text == "\n\n".join(p for p in parts if p) and got.n_chars == len(got.text)


def test_odd_pages():
    w = html_extract.fit([])
    page = '<html><body><header><a href="/">Home</a></header><div class="cookie-notice">We use cookies.</div><article><h1>A &amp; b</h1><p>One <i>long</i>\n paragraph, ends here.<p>Two.<aside>Related</aside><script>"<p>no</p>"</script><form><label>Name</label></form></article><section id="comments"><p>Great article, I liked it.</p></section><footer>x</footer>'
    assert html_extract.extract(page, w) == "A & b\n\nOne long paragraph, ends here.\n\nTwo."
    assert html_extract.extract(None, w) == html_extract.extract("", w) == html_extract.extract("<!-- x", w) == ""


PROSE = "<p>One sentence stands here, and it is long enough to read.</p><p>Two more follow it. Here is the other, which ends.</p>"
READ = "One sentence stands here, and it is long enough to read.\n\nTwo more follow it. Here is the other, which ends."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<body class="single has-sidebar"><main><article>{PROSE}</article></main></body>', READ),
        (f'<article class="post category-social">{PROSE}</article>', READ),
        (f'<div id="main" class="no-comments">{PROSE}</div>', READ),
        (f'<article data-hidden="no">{PROSE}</article>', READ),
        (f"<body><form action=x><nav><a href=1>Home</a></nav><article>{PROSE}</article></form>", READ),
        (f"<body><form action=x>{PROSE * 6}</form>", "\n\n".join([READ] * 6)),
        (f'<article>{PROSE}<div class="banner-note">A note of some length stands here, for all to read.</div></article>', READ + "\n\nA note of some length stands here, for all to read."),
        (f'<article>{PROSE}<form><label>Your name</label></form><div class="related-posts"><a href=x>Other</a></div></article>', READ),
        (f'<article>{PROSE}</article><section id="comments"><article><p>Nice article, I liked it. Really, a lot.</p></article></section>', READ),
        (f"<article>{PROSE}<p hidden>Not shown, at all. Never.</p><aside><p>By the way, this stands aside. It is not read.</p></aside></article>", READ),
        (f"<div><ul><li><a href=1>Home</a></li><li><a href=2>Away</a></li></ul></div><div>{PROSE}</div>", READ),
    ],
)
def test_article_stays_whatever_the_markup_around(page, text):
    assert html_extract.extract(page, html_extract.fit([])) == text


def test_cut_decides_labels(spark, sf_dir):
    rows = html_extract.extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=[]).agg(F.sum("n_blocks"), F.sum("n_turned")).first()
    assert rows[0] > rows[1] > 0
    # a short line among prose: its text alone says boilerplate, its neighbours content
    w = html_extract.fit([])
    blocks = html_extract.blocks_of(f"<div>{PROSE * 3}<p>So</p>{PROSE * 3}</div>")
    assert html_extract.odds_of(blocks, w)[6] < 0 and html_extract.label(blocks, w).all()


@pytest.mark.parametrize("page", ['<a "' * 250_000, "<a" * 500_000, "<a '\"" * 200_000 + ">", "<div>" * 100_000 + "</b>" * 100_000 + "x", "<b>" * 200_000 + "x", "<p>word, and. " * 70_000, "</script" * 100_000, "<ul><li><a href=1>x</a><p>One, two. Three.</p>" * 20_000])
def test_long_pages_take_linear_time(page):
    import time

    began = time.process_time()
    html_extract.extract(page, html_extract.fit([]))
    assert time.process_time() - began < 8


def test_pages_with_odd_rows(spark):
    rows = [(1, None, "u"), (1, None, "u"), (None, "", None), (2, f"<article>{PROSE}", "x"), (2, f"<article>{PROSE}", "x")]
    df = spark.createDataFrame(rows, "page_id long, html string, url string").withColumns({c: F.lit("clash") for c in ("row", "text", "_html", "n_turned")})
    got = html_extract.extract_main_text(df).select("page_id", "url", "row", "_html", "text", "n_chars").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter((k, u, "clash", "clash", READ if k == 2 else "", len(READ) if k == 2 else 0) for k, _, u in rows)
    assert html_extract.extract_main_text(df.limit(0)).count() == 0


def test_cut_is_minimal():
    import itertools

    import numpy as np

    random.seed(4)
    for _ in range(150):
        n = random.randint(1, 7)
        source, sink = (np.array([random.choice([0, 1, 2, 5]) for _ in range(n)], float) for _ in range(2))
        edges = [(a, b, random.choice([0.5, 1.0, 3.0])) for a in range(n) for b in range(a + 1, n) if random.random() < 0.5]
        cost = lambda side: sum(sink[i] if side[i] else source[i] for i in range(n)) + sum(c for a, b, c in edges if side[a] != side[b])
        assert cost(html_extract.max_flow_cut(source, sink, edges)) == pytest.approx(min(map(cost, itertools.product([False, True], repeat=n))))
