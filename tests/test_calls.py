import random
from decimal import Decimal

from spoor.operators import calls
from tests.builders import evidence


def replay(rows):
    """The call stack of one thread: (seq, kind, id, address) -> (id, depth, matched)."""
    frames, out = [], {}
    for seq, kind, cid, address in sorted(rows):
        if kind == 7:
            out[seq] = (cid, len(frames), True)
            frames.append((cid, address))
            continue
        at = max((i for i, f in enumerate(frames) if f[1] == address), default=None)
        if at is None:
            out[seq] = (0, len(frames), False)
        else:
            out[seq] = (frames[at][0], at, True)
            del frames[at:]
    return out


def _run(spark, rows, piece):
    df = spark.createDataFrame([(1, t, *r) for t, r in rows],
                               "run_id bigint, tid bigint, seq bigint, kind int, call_id bigint, address decimal(20,0)")
    return {(r.tid, r.seq): (r.call_id, r.depth, r.matched) for r in calls.correlate_calls(df, piece).collect()}


def test_nested_unwinding_and_orphan(spark):
    steps = [(7, 10, 0x1005), (7, 11, 0x2005), (8, 0, 0x2005), (7, 12, 0x3005), (8, 0, 0x1005), (8, 0, 0xdeadbeef)]
    rows = [(0, (i + 1, k, c, Decimal(a))) for i, (k, c, a) in enumerate(steps)]
    for piece in (1, 2, 100):
        got = _run(spark, rows, piece)
        assert [got[(0, s)] for s in range(1, 7)] == [
            (10, 0, True), (11, 1, True), (11, 1, True), (12, 1, True), (10, 0, True), (0, 0, False)]


def test_random_stacks_in_small_pieces(spark):
    rng = random.Random(5)
    rows, seq = [], 0
    for tid, bias in ((0, 0.5), (1, 0.6), (2, 0.35), (3, 0.5)):
        for _ in range(400):
            seq += rng.randint(1, 3)
            address = Decimal((1 << 64) - 1 - rng.randint(0, 4 if tid != 3 else 1))
            rows.append((tid, (seq, 7 if rng.random() < bias else 8, seq + 1000, address)))
    for piece in (1, 7, 64, 100000):
        got = _run(spark, rows, piece)
        for tid in range(4):
            for s, expected in replay([r for t, r in rows if t == tid]).items():
                assert got[(tid, s)] == expected, (piece, tid, s)


def test_active_calls_against_brute_force(spark):
    rng = random.Random(6)
    rows, cid = [], 0
    for seq in range(1, 400):
        tid, kind = rng.choice([0, 0, 1]), rng.choices([7, 8, 13, 4], [5, 4, 0.3, 3])[0]
        cid += kind == 7
        rows.append(dict(seq=seq, kind=kind, tid=tid, target=seq % 3,
                         cid=cid if kind == 7 else rng.randint(1, max(1, cid)) if kind == 8 else 0))
    ev = evidence(spark, rows)
    cursors = [(i, 1, rng.choice([0, 1, -1]), rng.randint(0, 410)) for i in range(80)]
    df = spark.createDataFrame(cursors, "cursor_id bigint, run_id bigint, tid bigint, cursor bigint")

    def expected(tid, cursor, limit):
        if tid < 0:
            return []
        boundary = max((r["seq"] for r in rows if r["kind"] == 13 and r["tid"] == tid and r["seq"] <= cursor), default=0)
        found = []
        for r in rows:
            if r["kind"] == 7 and r["tid"] == tid and boundary < r["seq"] < cursor:
                back = min((x["seq"] for x in rows if x["kind"] == 8 and x["cid"] == r["cid"] and x["tid"] == tid), default=None)
                if back is None or back > cursor:
                    found.append(r["seq"])
        return sorted(found, reverse=True)[:limit]

    for limit, piece in ((3, 16), (None, 5), (None, 1 << 16), (1, 1)):
        got = {}
        for r in calls.active_calls(ev, df, limit, piece).collect():
            got.setdefault(r.cursor_id, []).append(r.seq)
        for i, _, tid, cursor in cursors:
            assert sorted(got.get(i, []), reverse=True) == expected(tid, cursor, limit)


def test_frames_of_a_function_across_pieces(spark, monkeypatch):
    """The newest active call to the function, also when later ones have returned; calls that never return are kept once per
    piece that holds a cursor, not per piece."""
    rng = random.Random(7)
    rows, open_ = [], []
    for seq in range(1, 600):
        if open_ and rng.random() < 0.4:
            rows.append(dict(seq=seq, kind=8, tid=0, cid=open_.pop(rng.randrange(len(open_)))))
        else:
            rows.append(dict(seq=seq, kind=7, tid=0, cid=seq, target=seq % 5))
            if rng.random() < 0.7:
                open_.append(seq)
    ev, moments = evidence(spark, rows), sorted(rng.sample(range(1, 700), 25))
    watches = spark.createDataFrame([(10 * c + f, 1, 0, c, Decimal(f), 16, 8) for c in moments for f in range(5)],
                                    "watch_id bigint, run_id bigint, tid bigint, cursor bigint, target decimal(20,0), offset int, size int")
    pointers = ev.filter("kind = 7").selectExpr("run_id", "seq AS sequence", "CAST(5000 + seq AS DECIMAL(20,0)) AS stack_pointer")
    monkeypatch.setattr(calls._active, "__defaults__", (32,))
    back = {r["cid"]: r["seq"] for r in rows if r["kind"] == 8}
    got = {r.watch_id: (r.call_seq, r.address) for r in calls.resolve_stack(ev, pointers, watches).collect()}
    for c in moments:
        for f in range(5):
            want = max((r["seq"] for r in rows if r["kind"] == 7 and r["target"] == f and r["seq"] < c and back.get(r["cid"], 10**9) > c), default=None)
            assert got[10 * c + f] == (want, None if want is None else 5000 + want - 8 + 16)
    spans, _ = calls.stack_snapshots(calls._active_spans(ev), watches.selectExpr("watch_id AS cursor_id", "run_id", "tid", "cursor").filter("cursor = 0"), 32)
    assert spans.count() == 0


def test_snapshots_of_deep_stacks_grow_with_the_calls(spark):
    """Calls that stay open, or end together far away, are not kept once per piece of their lives."""
    rows = [dict(seq=s, kind=7, tid=0, cid=s, target=s % 3) for s in range(1, 640)] + [dict(seq=650, kind=13, tid=0)]
    rows += [dict(seq=s, kind=7, tid=0, cid=s, target=s % 3) for s in range(660, 1280)]
    ev = evidence(spark, rows)
    watches = spark.createDataFrame([(c, 1, 0, c, Decimal(c // 8 % 3)) for c in range(4, 1300, 8)],
                                    "cursor_id bigint, run_id bigint, tid bigint, cursor bigint, target decimal(20,0)")
    spans, _ = calls.stack_snapshots(calls._active_spans(ev), watches, 16, ("target",), 1)
    assert spans.count() < 3 * len(rows)
    got = {r.cursor_id: r.seq for r in calls._active(ev, watches, ["target"], 1, 16).collect()}
    for c in range(4, 1300, 8):
        assert got.get(c) == max((r["seq"] for r in rows if r["kind"] == 7 and (c < 650 or r["seq"] > 650) and r["seq"] < c
                                  and r["target"] == c // 8 % 3), default=None)


def test_syscall_epochs(spark):
    rows = spark.createDataFrame([(1, 0, 1, True), (1, 0, 2, True), (1, 0, 4, False), (1, 0, 5, True), (1, 0, 6, False)],
                                 "run_id bigint, tid bigint, seq bigint, entering boolean")
    changes = spark.createDataFrame([(1, 0, 3)], "run_id bigint, tid bigint, seq bigint")
    pairs = calls.correlate_syscalls(rows, changes, segment=2)
    assert {r.seq: r.enter_seq for r in pairs.collect() if not r.entering} == {4: None, 6: 5}
    assert [(r.seq, r.requested) for r in calls.interrupted_syscalls(pairs, changes).collect()] == [(3, 2)]


class _State:
    """Stands in for the state of one key; counts the bytes that are read and written."""

    def __init__(self):
        self.value, self.entries, self.timers, self.moved = None, {}, set(), 0

    def getValueState(self, name, schema):
        one = _State()
        one.exists, one.get = lambda: one.value is not None, lambda: one.value
        one.update = lambda value: setattr(one, "value", value)
        return one

    def getMapState(self, name, key_schema, schema):
        def write(key, value):
            self.moved += len(value[0])
            self.entries[key] = value

        def read(key):
            self.moved += len(self.entries[key][0])
            return self.entries[key]
        many = _State()
        many.updateValue, many.getValue, many.removeKey = write, read, self.entries.pop
        many.keys = lambda: iter(list(self.entries))
        return many

    def registerTimer(self, at):
        self.timers.add(at)


def test_waiting_rows_are_moved_once():
    """Many batches wait, one moment after the other is released: each row is written once and read once, not with all others."""
    import pandas as pd
    from types import SimpleNamespace

    from spoor.streaming import live
    rng, rows = random.Random(8), []
    for seq in range(1, 2001):
        rows.append((seq, 7 if rng.random() < 0.55 else 8, seq + 1000, rng.randint(0, 4)))
    state, replayer, got = _State(), live._stack_processor(False), []
    replayer.init(state)
    for a in range(0, 2000, 20):
        frame = pd.DataFrame(rng.sample(rows[a:a + 20], 20), columns=["seq", "kind", "call_id", "address"])
        frame["event_time"] = pd.to_datetime(frame["seq"], unit="ms")
        replayer.handleInputRows((1, 2), iter([frame]), None)
    for limit in (15, 15, *range(40, 2100, 30)):
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda limit=limit: limit)
        for _ in sorted(t for t in state.timers if t <= limit):
            got += [r for df in replayer.handleExpiredTimer((1, 2), now, None) for r in df.itertuples(index=False, name=None)]
    want = replay(rows)
    assert [(r[2], r[4:]) for r in got] == [(s, want[s]) for s, *_ in rows]
    assert not state.entries and state.moved < 4 * 40 * len(rows)
