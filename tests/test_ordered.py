"""Segmented helpers against plain Python, with pieces far smaller than a key's history."""

import random

from pyspark.sql import functions as F

from spoor.operators import images, ordered


def _rows(spark, n=400, keys=3, seed=1, step=3):
    rng = random.Random(seed)
    seqs = rng.sample(range(1, n * step), n)
    data = [(rng.choice([0] * 4 + list(range(keys))), s, rng.random() < 0.4, rng.randint(-3, 3)) for s in seqs]
    return spark.createDataFrame(data, "k int, seq bigint, pick boolean, v int"), sorted(data, key=lambda r: r[1])


def test_carry_last(spark):
    df, data = _rows(spark)
    for inclusive in (False, True):
        got = {r.seq: r.out for r in ordered.carry_last(df, ["k"], F.col("pick"), F.struct("seq", "v"), "out",
                                                        inclusive=inclusive, segment=17).collect()}
        last = {}
        for k, s, pick, v in data:
            if inclusive and pick:
                last[k] = (s, v)
            assert (got[s] and tuple(got[s])) == last.get(k)
            if pick:
                last[k] = (s, v)


def test_running_sum_and_ordinals(spark):
    df, data = _rows(spark, seed=2)
    both = ordered.ordinals(ordered.running_sum(df, ["k"], F.col("v"), "total", segment=11), ["k"], "n", segment=11)
    got = {r.seq: (r.total, r.n) for r in both.collect()}
    totals, counts = {}, {}
    for k, s, _, v in data:
        totals[k] = totals.get(k, 0) + v
        assert got[s] == (totals[k], counts.get(k, 0))
        counts[k] = counts.get(k, 0) + 1


def test_match_levels(spark):
    for seed in range(3):
        df, data = _rows(spark, seed=seed, n=300)
        out = ordered.match_levels(df, ["k"], F.col("pick"), F.struct("seq") if seed else None, "opened", segment=13).collect()
        got = {r.seq: r for r in out}
        stacks = {}
        for k, s, enter, _ in data:
            stack = stacks.setdefault(k, [])
            if enter:
                stack.append(s)
            else:
                expected = stack.pop() if stack else None
                assert got[s].orphan == (expected is None)
                opened = got[s].opened
                assert (opened.seq if opened and seed else opened) == expected


def test_dyadic_cover_meets_each_point_once(spark):
    rng = random.Random(3)
    spans = [(i, *sorted(rng.choices(range(300), k=2))) for i in range(60)]
    spans += [(60, 0, ordered.LAST), (61, 7, ordered.LAST), (62, 9, 3), (63, 5, 5)]
    points = [(p,) for p in range(0, 300, 7)] + [(ordered.LAST,), (1 << 40,)]
    a = spark.createDataFrame(spans, "id int, lo bigint, hi bigint").withColumn(
        "node", F.explode(ordered.cover_nodes("lo", "hi")))
    b = spark.createDataFrame(points, "p bigint").withColumn("node", F.explode(ordered.point_nodes("p")))
    got = sorted((r.id, r.p) for r in a.join(b, "node").select("id", "p").collect())
    assert got == sorted((i, p) for i, lo, hi in spans for (p,) in points if lo <= p <= hi)


def test_number_changes(spark):
    """Against plain Python: pieces far smaller than histories, open ties, two keys; the rows are read once a pass."""
    for seed in range(3):
        rng = random.Random(seed)
        data = [(rng.choice([1, 1, 2]), rng.randrange(150), rng.choice([0.5, 1.5, float("nan"), None]),
                 rng.choice([0] * 9 + [1, 2, None]), rng.choice([b"a", b"a", b"b", None]) if seed else b"a") for _ in range(400)]
        df = spark.createDataFrame(data, "k int, at bigint, t double, place int, v binary")
        nulls_first = lambda x: (x is not None, x != x, x if x is not None and x == x else 0)
        rows = sorted(data, key=lambda r: (r[0], r[1], nulls_first(r[2]), nulls_first(r[3]), r[4] is not None, r[4] or b""))
        now, made, seen, want = {}, {}, {}, []
        for k, at, t, place, v in rows:
            new = (k, place) not in now or now[k, place][0] != v
            made[k] = made.get(k, 0) + new
            if new:
                now[k, place] = v, made[k]
            want.append((k, seen.get(k, 0), at, place, v, new, now[k, place][1]))
            seen[k] = seen.get(k, 0) + 1
        for segment in (7, 40, None):
            out = ordered.number_changes(df, ["k"], "place", ["v"], "new", "number", "n", order="at", tie=("t",), segment=segment)
            got = sorted((r.k, r.n, r["at"], r.place, r.v and bytes(r.v), r.new, r.number) for r in out.collect())
            assert got == want
        assert out._jdf.queryExecution().sparkPlan().toString().count("Scan ExistingRDD") == 1
    empty = ordered.number_changes(df.filter("k = 9"), ["k"], "place", ["v"], "new", "number", order="at")
    assert empty.collect() == [] and empty.columns == [*df.columns, "new", "number"]


def test_code_identity_reads_its_input_once(spark):
    rows = spark.createDataFrame([(1, 1, 5, 1, 2, b"a")], "run_id bigint, seq bigint, address bigint, module_id bigint, size bigint, encoding binary")
    plan = images.code_identity(rows)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1
