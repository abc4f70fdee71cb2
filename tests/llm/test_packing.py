"""Packing: valid bins, the same bins as item by item, hard rows."""

import random
from collections import Counter, defaultdict

from spoor.llm import packing


def one_by_one(lengths, sizes, plan):
    """Best fit, item by item, opening the sizes that the plan's rule names: contents of the bins."""
    rest = packing.Plan({}, sizes)
    histogram = Counter(lengths)
    volume, bins = sum(lengths), []
    for length in sorted(histogram, reverse=True):
        volume -= length * histogram[length]
        rest.volume = volume
        opened = []
        for i in range(histogram[length]):
            fit = min(((room, k) for k, (room, _, _) in enumerate(bins) if room >= length), default=None)
            if fit is None:
                if not opened:
                    size = rest._size_to_open(length, histogram[length] - i)
                    opened = [size] * -(-(histogram[length] - i) // (size // length))
                size = opened.pop()
                bins.append([size, size, []])
                fit = (size, len(bins) - 1)
            bins[fit[1]][0] -= length
            bins[fit[1]][2].append(length)
    return Counter((next(s for s in sizes if s >= sum(c)), tuple(sorted(c))) for _, _, c in bins)


def bins_of(rows):
    contents = defaultdict(list)
    for r in rows:
        if r.bin_id is not None:
            contents[r.bin_id, r.bin_size].append((r.bin_start, r.length))
    assert len({b for b, _ in contents}) == len(contents)
    for (_, size), items in contents.items():
        at = 0
        for start, length in sorted(items):
            assert start == at
            at += length
        assert at <= size
    return Counter((size, tuple(sorted(n for _, n in items))) for (_, size), items in contents.items())


def test_against_item_by_item(spark):
    rng = random.Random(2)
    for sizes in ((8, 16, 32), (10,), (64, 100, 250)):
        lengths = [min(max(sizes), int(rng.paretovariate(0.7))) for _ in range(400)] + [3] * 200
        df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")
        rows = packing.pack(df, sizes).collect()
        assert sorted(r.doc_id for r in rows) == list(range(len(lengths)))
        assert bins_of(rows) == one_by_one(lengths, sizes, None)


def test_hard_rows(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, 25), (3, 25), (None, 4), (5, 10), (6, -3)], "doc_id long, length long")
    rows = packing.pack(df, (4, 10)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in rows) == Counter(
        [(1, 0, 0, 0), (2, 0, 0, 0), (6, 0, 0, 0), (None, 0, 0, 4), (5, 0, 0, 10)] + [(3, 0, 0, 10), (3, 1, 10, 10), (3, 2, 20, 5)] * 2)
    assert all((r.bin_id is None) == (r.length == 0) for r in rows)
    assert sum(k[0] * n for k, n in bins_of(rows).items()) == 64     # five pieces of 10, both of 5 in one bin, 4 in a small one
    assert packing.pack(df.filter("doc_id = 99"), (4, 10)).collect() == []


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(packing.word_lengths(docs)).collect()
    lengths = [n for r in docs.collect() for n in _pieces(len((r.text or "").split()) + 1)]
    bins = bins_of(rows)
    assert Counter(n for (_, items), k in bins.items() for n in items * k) == Counter(lengths)
    waste = 1 - sum(lengths) / sum(size * k for (size, _), k in bins.items())
    assert waste < 0.03


def _pieces(n, largest=max(packing.SIZES)):
    return [largest] * (n // largest) + ([n % largest] if n % largest else [])
