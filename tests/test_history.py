import random
from decimal import Decimal

from spoor.operators import history
from tests.builders import evidence

TOP = 1 << 64


def _accesses(rng, n):
    rows = []
    for seq in range(1, n + 1):
        width = rng.choice([0, 1, 2, 4, 8, 8, 64, 65, 300, 70000])
        base = rng.choice([rng.randint(0, 200), rng.randint(0, 200), TOP - rng.randint(1, 80), 100000])
        data = bytes(rng.randrange(256) for _ in range(rng.randint(0, min(width, 40))))
        rows.append(dict(kind=5, seq=seq, addr=base, requested=width, captured=data,
                         access=rng.choice(["read", "write_before", "write_after", "prefetch"])))
    return rows


def _watches(spark, rng, n):
    data = []
    for i in range(n):
        start = rng.choice([rng.randint(0, 260), TOP - rng.randint(1, 80), 70150, 100000 + rng.randint(0, 100)])
        data.append((i, 1, Decimal(start), rng.randint(1, 256 if i % 5 == 0 else 16), rng.randint(0, 130)))
    return data, spark.createDataFrame(data, "watch_id bigint, run_id bigint, address decimal(20,0), size int, cursor bigint")


def test_overlap_pairs_once(spark):
    rng = random.Random(7)
    rows = _accesses(rng, 120)
    watches, df = _watches(spark, rng, 40)
    got = sorted((r.watch_id, r.seq) for r in history.overlapping(evidence(spark, rows), df).collect())
    assert got == sorted((w[0], r["seq"]) for w in watches for r in rows if r["access"] != "prefetch" and r["seq"] <= w[4]
                         and r["addr"] < int(w[2]) + w[3] and r["addr"] + r["requested"] > int(w[2]))


def test_byte_state_newest_access_decides(spark):
    rng = random.Random(8)
    rows = _accesses(rng, 120)
    watches, df = _watches(spark, rng, 40)
    got = {r.watch_id: r for r in history.byte_state(evidence(spark, rows), df).collect()}
    for wid, _, start, size, cursor in watches:
        shown, sources, before = [], set(), False
        for at in range(int(start), int(start) + size):
            cover = [r for r in rows if r["access"] != "prefetch" and r["seq"] <= cursor
                     and r["addr"] <= at < r["addr"] + r["requested"]]
            if not cover:
                shown.append("??")
                continue
            newest = max(cover, key=lambda r: r["seq"])
            sources.add(newest["seq"])
            before |= newest["access"] == "write_before"
            i = at - newest["addr"]
            shown.append(f"{newest['captured'][i]:02x}" if i < len(newest["captured"]) else "??")
        assert got[wid].value == " ".join(shown)
        assert got[wid].sources == sorted(sources, reverse=True)
        assert got[wid].before_write == before


def test_truncated_newer_access_hides_older_bytes(spark):
    ev = evidence(spark, [dict(kind=5, seq=1, addr=0, requested=4, access="write_after", captured=b"\x01\x02\x03\xff"),
                          dict(kind=5, seq=2, addr=0, requested=4, access="write_after", captured=b"\x09")])
    df = spark.createDataFrame([(1, 1, Decimal(0), 4, 5), (2, 1, Decimal(0), 4, 1)],
                               "watch_id bigint, run_id bigint, address decimal(20,0), size int, cursor bigint")
    got = {r.watch_id: (r.value, r.number, r.signed_number) for r in history.byte_state(ev, df).collect()}
    assert got[1] == ("09 ?? ?? ??", None, None)
    assert got[2] == ("01 02 03 ff", 4278387201, -16580095)


def test_write_transition_in_small_pieces(spark):
    rng = random.Random(9)
    rows = []
    for seq in range(1, 500):
        kind = rng.choice([4, 5, 5, 6])
        rows.append(dict(kind=kind, seq=seq, tid=rng.choice([0, 0, 1]), iid=rng.randint(1, 2),
                         addr=rng.randint(0, 1) if kind == 5 else 0, operand=rng.randint(0, 1) if kind == 5 else 0,
                         reg=rng.randint(1, 2) if kind == 6 else 0, requested=4 if kind == 5 else 0,
                         access="" if kind == 4 else rng.choice(["read", "write_before", "write_after"]),
                         captured=None if kind == 4 else bytes(rng.randrange(3) for _ in range(rng.randint(0, 4)))))
    got = {r.seq: r for r in history.write_transition(evidence(spark, rows), segment=19).collect()}
    place = lambda r: (r["kind"], r["tid"], r["iid"], r["addr"], r["operand"], r["reg"])
    for r in rows:
        if r["access"] != "write_after" or r["kind"] == 4:
            continue
        older = [x for x in rows if x["access"] == "write_before" and x["seq"] < r["seq"] and place(x) == place(r)]
        out = got[r["seq"]]
        if not older:
            assert out.outcome == "no_before_sample"
            continue
        b = older[-1]
        if any(x["kind"] == 4 and x["tid"] == r["tid"] and x["iid"] == r["iid"] and b["seq"] < x["seq"] < r["seq"] for x in rows):
            assert (out.outcome, out.before_seq) == ("earlier_execution", None)
        else:
            assert (out.outcome, out.before_seq) == ("paired", b["seq"])
            assert out.changed == sum(p != q for p, q in zip(b["captured"], r["captured"]))
            assert out.compared == min(len(b["captured"]), len(r["captured"]))
