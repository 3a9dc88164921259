"""Each transducer is reached by a text that holds its form alone."""

from __future__ import annotations

import random

import pytest

from graphloom.llm import pii


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("call plus 49 170 1234567 now", "phone", "plus 49 170 1234567"),
        ("bob at mail . example . com", "email", "bob at mail . example . com"),
        ("bob @ mail . com", "email", "bob @ mail . com"),
        ("10 . 0 . 0 . 1", "ip", "10 . 0 . 0 . 1"),
        ("+49 17 one 2345 67 eight", "phone", "+49 17 one 2345 67 eight"),
        ("card 4111 1111 1111 one one one one", "card", "4111 1111 1111 one one one one"),
        ("card 4111 1111 1111 111 one", "card", "4111 1111 1111 111 one"),
        ("bob [at] mail.com", "email", "bob [at] mail.com"),
        ("10[.]0.0.1", "ip", "10[.]0.0.1"),
        ("bob@m\u0430il.com", "email", "bob@m\u0430il.com"),
    ],
)
def test_one_form_alone(text, kind, span):
    (found,) = pii.find(text)
    assert found[0] == kind and text[found[1] : found[2]] == span


def test_gate_is_the_union_of_the_transducers():
    random.seed(2)
    parts = [*"one two , - . 1 23 x1 plus at dot @ [ ] ( ) bob com _ +".split(), " ", " ", " ", " ", "\n", "\u0430", "é"]
    for _ in range(20000):
        text = "".join(random.choice(parts) for _ in range(random.randint(1, 14)))
        assert pii._touched(text) == any(t(text) for t in pii.TRANSDUCERS), text


def test_whole_address_stands_beside_its_plain_part():
    assert pii.find("mail j\u043ehn@example.com now") == [("email", 5, 21, False), ("email", 7, 21, True)]


@pytest.mark.parametrize("text", ["look at example.com for more", "he sat at home. The dog slept", "find us at shop.example.org", "two @ a time. And more", "a at b", "a dot b"])
def test_prose_before_a_host_is_no_name(text):
    assert pii.find(text) == []


def test_a_lone_digit_word_beside_a_number_is_prose():
    assert pii.find("call +1 (848) 555-1373 one more time") == [("phone", 5, 22, True)]


NAMES = ["john", "mary.doe", "k_9", "a.b-c", "sales"]
HOSTS = ["example.com", "mail.example.org", "my-host.net", "x1.co.uk"]
WORDS = dict(zip("0123456789", "zero one two three four five six seven eight nine".split()))
LOOKS = {"a": "\u0430", "e": "\u0435", "o": "\u043e", "c": "\u0441", "p": "\u0440", "x": "\u0445"}


def wide(text):
    return "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in text)


def plain_address():
    return f"{random.choice(NAMES)}@{random.choice(HOSTS)}"


def plain_card():
    digits = "4" + "".join(random.choice("0123456789") for _ in range(14))
    return digits + next(c for c in "0123456789" if pii.luhn(digits + c))


DISGUISES = {
    "at and dot in brackets": ("email", lambda: plain_address().replace("@", " [at] ").replace(".", "(dot)")),
    "at and dot as words": ("email", lambda: plain_address().replace("@", " at ").replace(".", " dot ")),
    "at as a word": ("email", lambda: plain_address().replace("@", " at ")),
    "at in brackets": ("email", lambda: plain_address().replace("@", "<AT>")),
    "spaced signs": ("email", lambda: plain_address().replace("@", " @ ").replace(".", " . ")),
    "wide forms": ("email", lambda: wide(plain_address())),
    "look-alikes": ("email", lambda: "".join(LOOKS.get(c, c) for c in plain_address())),
    "zero-width characters": ("email", lambda: plain_address().replace("@", "\u200b@\u200d")),
    "spelled phone": ("phone", lambda: "plus " + " ".join(WORDS[random.choice("0123456789")] for _ in range(11))),
    "half spelled phone": ("phone", lambda: "+49 " + " ".join(random.choice([c, WORDS[c]]) for c in "1701234567")),
    "spelled card": ("card", lambda: " ".join(WORDS[c] for c in plain_card())),
    "card with a wide digit": ("card", lambda: (lambda c: c[:7] + wide(c[7]) + c[8:])(plain_card())),
    "spaced ip": ("ip", lambda: " . ".join(str(random.randint(0, 255)) for _ in range(4))),
    "ip in brackets": ("ip", lambda: "[.]".join(str(random.randint(0, 255)) for _ in range(4))),
    "ip with dots as words": ("ip", lambda: " dot ".join(str(random.randint(0, 255)) for _ in range(4))),
}


@pytest.mark.parametrize("name", DISGUISES)
def test_recall_of_a_disguise(name):
    """Nine of ten planted disguises of each kind are found, from their first character to their last."""
    random.seed(8)
    kind, make = DISGUISES[name]
    found = 0
    for _ in range(200):
        said, before, after = make(), random.choice(["", "Write to ", "so, then: ", "\u00e9t\u00e9 \u2013 "]), random.choice(["", " now", ", please", ".\nMore"])
        spans = pii.find(before + said + after)
        found += any(k == kind and (before + said + after)[a:b] == said for k, a, b, _ in spans)
    assert found >= 180


@pytest.mark.parametrize("text", ["a " * 300_000, "a" * 600_000, "a dot " * 100_000, "one " * 150_000, "a@" * 300_000, "1 . " * 150_000, "bob [at] x [dot] org " * 30_000, "+1 " * 200_000])
def test_long_texts_take_linear_time(text):
    import time

    began = time.process_time()
    pii.find(text)
    assert time.process_time() - began < 8


def test_spans_of_odd_tables(spark):
    from pyspark.sql import functions as F

    rows = [(1, "x [at] y [dot] org"), (1, "x [at] y [dot] org"), (None, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("row", "_text", "spans")})
    got = pii.detect_spans(df).collect()
    assert sorted(((r.doc_id or 0), r.row, r._text, len(r.spans)) for r in got) == [(0, "clash", "clash", 0), (1, "clash", "clash", 1), (1, "clash", "clash", 1), (2, "clash", "clash", 0)]
    assert pii.detect_spans(df.limit(0)).count() == 0
