"""Personal data: base spans against the patterns themselves, trees and thresholds, hard rows."""

import hashlib
import random
import re

import numpy as np

from spoor.llm import private

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    return [[(m.start(), m.end()) for m in EMAIL.finditer(text)],
            [(m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
            [(m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))],
            [(m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]]


def wanted(i, text):
    found = brute(text)
    base = [f"{k}:{a}:{b}" for k, spans in zip(private.KINDS, found) for a, b in spans]
    return (i, *map(len, found), hashlib.sha256(",".join(base).encode()).hexdigest())


def check(rows, result):
    columns = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    assert sorted((tuple(r) for r in result.select(columns).collect()), key=repr) == sorted((wanted(i, t) for i, t in rows), key=repr)
    texts = dict(rows)
    for r in result.collect():
        spans = [s.split(":") for s in r.spans.split(",") if s]
        base = [f"{k}:{a}:{b}" for k, found in zip(private.KINDS, brute(texts[r.doc_id])) for a, b in found]
        assert {":".join(s) for s in spans} >= set(base) and len(spans) == len(base) + r.n_added
        assert spans == sorted(spans, key=lambda s: (private.KINDS.index(s[0]), int(s[1])))
        touched = [(int(a), int(b)) for _, a, b in spans if f"{_}:{a}:{b}" not in base]
        assert all(b <= int(x) or int(y) <= a for a, b in touched for _, x, y in (s.split(":") for s in base))


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], private.private_digests(docs))


def test_random_texts(spark):
    rng = random.Random(4)
    alphabet = ["a", "B", "@", ".", "-", "_", "%", " ", "  ", "+", "1", "25", "999", "0", "4111111111111111", "(", ")", "\n", "é", "😀", "x.y", "12345678", "/"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for i in range(1500)]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, rid int, kind string").repartition(5)
    check(rows, private.private_digests(docs))


def test_hard_rows(spark):
    rows = [(1, None), (2, ""), (3, "a@b.c_d@e.f.g@h.i"), (4, "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255"), (5, "x" * 5_000 + "@y.z"),
            (6, "1" * 5_000), (7, "1.1.1.1 " * 2_000), (8, "+1" + " " * 5_000 + "5"), (9, "4111 1111-1111 1111 +49 (30) 123-45 67."),
            (10, "." * 5_000 + "a@" + "b." * 2_000 + "c"), (11, "😀 a@b.co 😀 +12345678901"), (12, "1 " * 3_000), (13, "5" * 15), (-1, "a@b.cd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, private.private_digests(docs))
    assert private.private_digests(docs.filter("doc_id = 99")).collect() == []
    twice = spark.createDataFrame([(None, "a@b.cd"), (None, None), (7, "x a@b.cd"), (7, "a@b.cd"), (7, "a@b.cd")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.spans) for r in private.private_digests(twice).collect()) == [
        (0, ""), (0, "email:0:6"), (7, "email:0:6"), (7, "email:0:6"), (7, "email:2:8")]


def test_spans_are_added(spark):
    """Phone numbers with another sign in front are learned from those with a plus; other numbers stay."""
    rng = random.Random(7)
    number = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    phone = lambda: f"1 ({number(3)}) 555-{number(4)}"
    rows = [(i, f"word call +{phone()} or so {number(8)} and {number(2)}.{number(2)} of") for i in range(600)]
    rows += [(1000, f"and call {phone()} now"), (1001, f"just {number(8)} here"), (1002, "no numbers")]
    found = {r.doc_id: r for r in private.private_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1000].spans == "phone:9:25" and found[1000].n_added == 1 and found[1000].n_phone == 0
    assert found[1001].spans == found[1002].spans == "" and sum(r.n_added for r in found.values()) == 1


def test_trees_and_thresholds():
    rng = np.random.default_rng(1)
    x = np.stack([rng.integers(0, n, 3000) for n in private.FEATURES.values()], axis=1)
    likely = (x[:, 1] > 4) & (x[:, 3] == 1)
    good, bad = np.where(likely, 19.0, 0.0), np.where(likely, 1.0, 20.0)
    margin = private.margins(private.boosted(x, good, bad), x)
    assert margin[likely].min() > 1 and margin[~likely].max() < -1
    bars = private.thresholds(x, margin, good, np.where(likely, 0.0, 20.0))
    assert all(margin[~likely].max() < b <= margin[likely].max() for b in bars)
    assert private.thresholds(x[:0], margin[:0], good[:0], bad[:0]) == [np.inf] * 4


def test_very_long_texts(spark):
    """Runs of a million characters, which a pattern that steps back would take hours for."""
    n = 1_000_000
    rows = [(1, "x" * n + "@y.z"), (2, "1" * n), (3, "+1" + " " * n + "5"), (4, "." * n), (5, "a@" + "b." * (n // 2) + "c"), (6, "1 " * (n // 2)), (7, "(" * n)]
    found = {r.doc_id: r.spans for r in private.private_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: f"email:0:{n + 4}", 2: "", 3: "", 4: "", 5: f"email:0:{n + 3}", 6: "", 7: ""}
