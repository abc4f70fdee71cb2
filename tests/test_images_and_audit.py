import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spoor.functions import bytes as B
from spoor.functions import text as X
from spoor.operators import audit, coverage, evidence as ev_ops, images, memory_api, timeline
from tests.builders import evidence


def test_code_identity_ids(spark):
    rows = [(1, 1, 0x1000, 1, 2, b"\x90\x90"), (1, 2, 0x1000, 1, 2, b"\x90\x90"), (1, 3, 0x1000, 1, 2, b"\x90\xc3"),
            (1, 4, 0x1000, 2, 2, b"\x90\xc3"), (1, 5, 0x2000, 2, 2, b"\x90\xc3"), (1, 6, 0x1000, 1, 2, b"\x90\x90")]
    df = spark.createDataFrame(rows, "run_id bigint, seq bigint, address bigint, module_id bigint, size bigint, encoding binary")
    for segment in (2, 100):
        got = [r.instruction_id for r in images.code_identity(df, segment).orderBy("seq").collect()]
        assert got == [1, 1, 2, 3, 4, 5]


def test_api_names(spark):
    df = spark.createDataFrame([("VirtualAlloc",), ("NtUnmapViewOfSection",), ("virtualalloc",), ("HeapAllocEx",)], "name string")
    got = {r.name: (r.api_kind, r.action) for r in memory_api.classify(df).collect()}
    assert got == {"VirtualAlloc": (0, "allocate"), "NtUnmapViewOfSection": (18, "unmap"), "virtualalloc": (None, None),
                   "HeapAllocEx": (None, None)}


def test_failed_status_is_not_success(spark):
    df = spark.createDataFrame([(18, Decimal(0xC0000005), False), (18, Decimal((1 << 64) - 1), False), (18, Decimal(0), True),
                                (0, Decimal(0), False), (0, Decimal(5), False)],
                               "api_kind int, result decimal(20,0), entering boolean")
    df = df.withColumns({f"arg{i}": F.lit(i).cast("decimal(20,0)") for i in range(12)})
    got = [r.api_succeeded for r in memory_api.interpret(df).collect()]
    assert got == [True, False, False, False, True]


def test_pe_headers(spark):
    import struct
    head = bytearray(512)
    head[0:2] = b"MZ"
    struct.pack_into("<I", head, 0x3c, 0x80)
    struct.pack_into("<IHHIIIHH", head, 0x80, 0x4550, 0x8664, 1, 0x12345678, 0, 0, 240, 0)
    struct.pack_into("<H", head, 0x98, 0x20b)
    struct.pack_into("<I", head, 0x98 + 16, 0x2340)
    struct.pack_into("<I", head, 0x98 + 56, 0x9000)
    struct.pack_into("<I", head, 0x98 + 64, 0xabcdef01)
    bad = bytearray(head)
    bad[0x98] = 0
    far = bytearray(head)
    struct.pack_into("<I", far, 0x3c, 0xfffffff0)
    df = spark.createDataFrame([(1, bytes(head)), (2, bytes(bad)), (3, b"MZ" + bytes(8)), (4, bytes(far))], "n int, content binary")
    got = {r.n: r for r in images.pe_identities(df).collect()}
    assert (got[1].machine, got[1].pe_timestamp, got[1].pe_checksum, got[1].declared_image_size, got[1].entry_point_rva) == (
        0x8664, 0x12345678, 0xabcdef01, 0x9000, 0x2340)
    assert [got[n].pe_identity_valid for n in (1, 2, 3, 4)] == [True, False, False, False]


def test_module_reload_at_another_base(spark):
    life = spark.createDataFrame(
        [(1, 1, 10, 50, Decimal(0x10000), Decimal(0x1ffff)), (1, 2, 60, None, Decimal(0x10000), Decimal(0x8ffff)),
         (1, 3, 10, None, Decimal((1 << 64) - 0x10000), Decimal((1 << 64) - 1))],
        "run_id bigint, module_id bigint, load_seq bigint, unload_seq bigint, base decimal(20,0), high decimal(20,0)")
    points = [(1, 5, 0x10010), (1, 10, 0x10010), (1, 49, 0x1ffff), (1, 50, 0x10010), (1, 70, 0x8ffff), (1, 71, 0x90000),
              (1, 72, (1 << 64) - 1)]
    df = spark.createDataFrame([(r, s, Decimal(a)) for r, s, a in points], "run_id bigint, seq bigint, addr decimal(20,0)")
    got = {r.seq: (r.module_id, int(r.module_offset)) for r in images.attribute_module(df, life).collect()}
    assert got == {5: (0, 0x10010), 10: (1, 0x10), 49: (1, 0xffff), 50: (0, 0x10010), 70: (2, 0x7ffff), 71: (0, 0x90000),
                   72: (3, 0xffff)}


def test_images_loaded_again_and_again(spark):
    """Against brute force; many loads at one base, some at once with others, far apart in time and size."""
    rng = random.Random(3)
    loads = [(1, i, 10 * i, 10 * i + rng.choice([5, 9, 40]), 0x400000, 0x4fffff) for i in range(1, 300)]
    loads += [(1, 1000 + i, rng.randrange(3000), rng.choice([None, 2500, 3100]), base, base + rng.choice([100, 70_000, 1 << 33]))
              for i, base in enumerate(rng.randrange(0, 1 << 24) for _ in range(25))]
    loads = [x for x in loads if x[3] is None or x[3] > x[2]]
    life = spark.createDataFrame([(r, m, a, b, Decimal(x), Decimal(y)) for r, m, a, b, x, y in loads],
                                 "run_id bigint, module_id bigint, load_seq bigint, unload_seq bigint, base decimal(20,0), high decimal(20,0)")
    points = [(seq, rng.choice([0x400000 + rng.randrange(0x100000), rng.randrange(1 << 24), rng.randrange(1 << 34)])) for seq in range(0, 3200, 4)]
    df = spark.createDataFrame([(1, s, Decimal(a)) for s, a in points], "run_id bigint, seq bigint, addr decimal(20,0)")
    got = {r.seq: (r.module_id, int(r.module_offset)) for r in images.attribute_module(df, life).collect()}
    for seq, address in points:
        hits = [(a, -1 if b is None else b, x, m) for _, m, a, b, x, y in loads if a <= seq and (b is None or seq < b) and x <= address <= y]
        newest = max(hits, key=lambda h: (h[0], h[1] == -1, h[1], h[2]), default=None)
        assert got[seq] == ((0, address) if newest is None else (newest[3], address - newest[2]))


def test_module_attribution_keeps_rows(spark):
    """Sequence numbers may repeat, images of very different sizes may share addresses."""
    life = spark.createDataFrame([(1, 1, 1, None, Decimal(0), Decimal((1 << 63) - 1)), (1, 2, 5, 9, Decimal(0x12345), Decimal(0x12399))],
                                 "run_id bigint, module_id bigint, load_seq bigint, unload_seq bigint, base decimal(20,0), high decimal(20,0)")
    points = [(0, 0x12345), (0, 0x12345), (3, 0x12346), (5, 0x12346), (5, 0x12399), (5, 0x1239a), (9, 0x12346)]
    df = spark.createDataFrame([(1, s, Decimal(a)) for s, a in points], "run_id bigint, seq bigint, addr decimal(20,0)")
    got = sorted((r.seq, int(r.addr), r.module_id, int(r.module_offset)) for r in images.attribute_module(df, life).collect())
    assert got == [(0, 0x12345, 0, 0x12345)] * 2 + [(3, 0x12346, 1, 0x12346), (5, 0x12346, 2, 1), (5, 0x12399, 2, 0x54),
                                                    (5, 0x1239a, 1, 0x1239a), (9, 0x12346, 1, 0x12346)]
    assert images.attribute_module(df, life.limit(0)).filter("module_id = 0").count() == 7


def test_newest_function_definition_wins(spark):
    functions = spark.createDataFrame([(1, Decimal(16), 1, 5), (1, Decimal(16), 2, 5), (1, Decimal(16), 3, 20)],
                                      "run_id bigint, address decimal(20,0), function_id bigint, seq bigint")
    events = spark.createDataFrame([(1, 4, Decimal(16)), (1, 6, Decimal(16)), (1, 21, Decimal(16)), (1, 22, Decimal(17))],
                                   "run_id bigint, seq bigint, target decimal(20,0)")
    got = {r.seq: r.function_id for r in images.attribute_function(events, functions, segment=3).collect()}
    assert got == {4: 0, 6: 2, 21: 3, 22: 0}


def _edges(spark, rows):
    return spark.createDataFrame([(1, p, life, up) for p, life, up in rows],
                                 "run_id bigint, process_id bigint, life bigint, parent_process_id bigint")


def test_deep_process_chain(spark):
    edges = _edges(spark, [(i, i, i - 1 if i else 999) for i in range(150)])
    got = {r.process_id: (r.root, r.depth, r.cycle) for r in images.process_tree(edges).collect()}
    assert got == {i: (0, i, False) for i in range(150)}


def test_process_cycle_ends(spark):
    edges = _edges(spark, [(1, 0, 2), (2, 0, 1), (3, 0, 1), (4, 0, 4), (5, 7, 4), (5, 9, 3)])
    got = {(r.process_id, r.life): (r.root, r.depth, r.cycle) for r in images.process_tree(edges).collect()}
    assert got == {(1, 0): (1, None, True), (2, 0): (1, None, True), (3, 0): (1, None, True), (4, 0): (4, 0, False),
                   (5, 7): (4, 1, False), (5, 9): (1, None, True)}


def test_process_lives(spark):
    rows = [(1, 1, "start", 10, 1, 0), (1, 2, "child", 10, 0, 20), (1, 3, "start", 20, 10, 0), (1, 4, "finish", 20, 0, 0),
            (1, 5, "child", 10, 0, 20), (1, 6, "start", 20, 10, 0), (1, 7, "child", 20, 0, 30), (2, 1, "start", 20, 5, 0)]
    df = spark.createDataFrame([(run, seq, e, p, up, rel, e == "child", seq, "d", "c") for run, seq, e, p, up, rel in rows],
                               "run_id bigint, sequence bigint, event string, process_id bigint, parent_process_id bigint, "
                               "related_process_id bigint, followed boolean, exit_code int, output_directory string, command_line string")
    got = {(r.run_id, r.process_id, r.life): (r.parent_process_id, r.recorded, r.followed, r.exit_code)
           for r in images.process_edges(df).collect()}
    assert got == {(1, 10, 1): (1, True, False, None), (1, 20, 3): (10, True, True, 4), (1, 20, 6): (10, True, True, None),
                   (1, 30, 0): (20, False, True, None), (2, 20, 1): (5, True, False, None)}


def test_write_pairing_notices(spark):
    def w(seq, access, iid=1, **kw):
        return dict(kind=5, seq=seq, tid=1, iid=iid, addr=iid * 8, requested=8, access=access, **kw)
    rows = [w(1, "write_before"), w(2, "write_before"), w(4, "write_after"), w(5, "write_after"), w(6, "write_before", 2),
            dict(kind=13, seq=3, tid=1), dict(kind=13, seq=7, tid=1), dict(kind=13, seq=8, tid=1), dict(kind=13, seq=9, tid=2)]
    threads = spark.createDataFrame([(1, 1, 10, False)], "run_id bigint, thread_id bigint, sequence bigint, started boolean")
    for segment in (2, 100):
        got = sorted((r.iid, r.notice_seq, r.reason, r.times) for r in
                     audit.write_pairing_audit(evidence(spark, rows), threads, segment).collect())
        assert got == [(1, 2, "write_after_unobserved_before_reexecution", 1), (1, 2, "write_interrupted_by_context_change", 1),
                       (1, 5, "write_after_without_before", 1), (2, 6, "write_interrupted_by_context_change", 2),
                       (2, 10, "write_after_unobserved_at_thread_end", 1)]


def test_memory_oracle_faults(spark):
    expected = spark.createDataFrame([(1, Decimal(8), "fault", 1), (1, Decimal(16), "fault", 1), (1, Decimal(24), "byte", 1)],
                                     "run_id bigint, address decimal(20,0), slot_kind string, expected bigint")
    rows = [dict(kind=5, seq=1, addr=8, iid=1, requested=8, access="write_before", captured=b""),
            dict(kind=5, seq=2, addr=16, iid=1, requested=8, access="write_before", captured=b"\0"),
            dict(kind=5, seq=3, addr=24, iid=1, requested=1, access="write_before", captured=b"\0"),
            dict(kind=5, seq=4, addr=24, iid=1, requested=1, access="write_after", captured=b"\1")]
    notes = spark.createDataFrame([(1, Decimal(8), "memory_unreadable")], "run_id bigint, address decimal(20,0), reason string")
    code = spark.createDataFrame([(1, 1)], "run_id bigint, iid bigint")
    got = {int(r.address): (r.errors, r.observed) for r in
           audit.check_memory_oracle(expected, evidence(spark, rows), notes, code).collect()}
    assert got == {8: (0, 0), 16: (2, 0), 24: (0, 1)}


def test_register_oracle_aliases_and_high_lane(spark):
    rows = [dict(kind=6, seq=1, reg=1, iid=5, access="write_after", captured=bytes([7]) + bytes(7) + bytes([9]) + bytes(7)),
            dict(kind=6, seq=2, reg=2, iid=5, access="write_after", captured=b"\xff\0\0\0")]
    names = spark.createDataFrame([(1, 1, "zmm0"), (1, 2, "rflags")], "run_id bigint, reg bigint, register_name string")
    code = spark.createDataFrame([(1, 5, Decimal(64))], "run_id bigint, iid bigint, address decimal(20,0)")
    want = [("xmm0", 0, 255, 7), ("xmm0.high", 0, 255, 9), ("gflags", 0, 1, 1), ("gflags", 1, 1, 1), ("rip", 0, 1, 1)]
    expected = spark.createDataFrame([(1, Decimal(64), n, "write_after", i, Decimal(m), Decimal(v)) for n, i, m, v in want],
                                     "run_id bigint, pc decimal(20,0), register string, access string, ordinal bigint, "
                                     "mask decimal(20,0), value decimal(20,0)")
    got = {r.register: (r.observed, r.expected, r.errors) for r in
           audit.check_register_oracle(expected, evidence(spark, rows), code, names).collect()}
    assert got == {"xmm0": (1, 1, 0), "xmm0.high": (1, 1, 0), "gflags": (1, 2, 1), "rip": (0, 1, 1)}


@pytest.mark.parametrize("name", ["check_memory_oracle", "check_register_oracle"])
def test_oracle_checks_broadcast_nothing_that_grows(spark, name):
    """Slots, samples and code are merged; only the register names, one row here, may be sent to every task."""
    from spoor.plans import QUERIES
    plan = QUERIES[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_pages_across_pieces(spark):
    rows = [dict(kind=4, seq=s, tid=s % 3) for s in range(3, 400, 3)] + [dict(kind=4, seq=1, run_id=2)]
    ev = evidence(spark, rows)
    seqs = list(range(3, 400, 3))
    for page in (0, 1, 4, 99):
        shown = max(1, min(page, -(-len(seqs) // 20)))
        got = timeline.timeline_page(ev, page, 20, segment=25).filter("run_id = 1").orderBy("seq").collect()
        assert [r.seq for r in got] == seqs[(shown - 1) * 20:shown * 20]
        assert {(r.page, r.total, r.pages) for r in got} == {(shown, len(seqs), -(-len(seqs) // 20))}
    for cursor in (0, 61, 399, 10000):
        earlier = sum(s < cursor for s in seqs)
        shown = min(1 + earlier // 20, -(-len(seqs) // 20))
        got = timeline.timeline_page_at(ev, cursor, 20, segment=25).filter("run_id = 1").orderBy("seq").collect()
        assert [r.seq for r in got] == seqs[(shown - 1) * 20:shown * 20]
    with pytest.raises(ValueError):
        timeline.timeline_page(ev, 1, 0)


def test_guards(spark):
    good = dict(kind=5, seq=1, requested=2, captured=b"ab", access="read")
    bad = [dict(good, seq=0), dict(good, captured=b"abc"), dict(good, access="execute"), dict(good, requested=1 << 32, captured=b"")]
    assert ev_ops.ingest_rejects(evidence(spark, [good, *bad])).count() == 4
    assert ev_ops.ingest_strict(evidence(spark, [good])).count() == 1
    for row in bad:
        with pytest.raises(Exception, match="Rejected evidence row"):
            ev_ops.ingest_strict(evidence(spark, [row])).collect()


def test_missing_prepared_event(spark):
    wanted = spark.createDataFrame([(1, 1), (1, 2)], "run_id bigint, seq bigint")
    with pytest.raises(Exception, match="Listed event not found: 2"):
        ev_ops.events_at_sequences(evidence(spark, [dict(seq=1)]), wanted).collect()


def test_hot_spot_limits(spark):
    counts = spark.createDataFrame([(1, 1, 0, 5), (1, 2, 0, 5), (1, 3, 0, 9)], "run_id bigint, iid bigint, tid bigint, executions bigint")
    code = spark.createDataFrame([(1, i, 7, "r", "d") for i in (1, 2, 3)], "run_id bigint, iid bigint, mid bigint, routine string, disassembly string")
    assert [r.iid for r in coverage.hot_spots(counts, code, 7, 2).orderBy("position").collect()] == [3, 1]
    assert coverage.hot_spots(counts, code, 7).count() == 3


def test_unsigned_and_little_endian(spark):
    top = (1 << 64) - 1
    df = spark.createDataFrame([("0xFFFFFFFFFFFFFFFF", b"\xff" * 8), (str(top), b"\xfe"), ("", b""), ("0x0", b"\x00\x80")],
                               "t string, b binary")
    rows = df.select(B.parse_unsigned("t").alias("n"), B.hex_address(B.parse_unsigned("t")).alias("h"),
                     B.little_unsigned("b").alias("u"), B.little_signed("b").alias("s")).collect()
    assert [int(r.n) for r in rows] == [top, top, 0, 0]
    assert rows[0].h == "0xffffffffffffffff" and rows[3].h == "0x0"
    assert [(r.u and int(r.u), r.s and int(r.s)) for r in rows] == [(top, -1), (254, -2), (None, None), (32768, -32768)]


def test_text_helpers(spark):
    df = spark.createDataFrame([("C:\\a/b\\c.dll",), ("x",), ("dir/",)], "p string")
    assert [r[0] for r in df.select(X.basename("p")).collect()] == ["c.dll", "x", ""]


def test_byte_counts_are_rounded_by_their_exact_value(spark):
    """Halves go to the even digit, and a decimal that only looks like a half does not go up (as printf has it)."""
    rng = random.Random(4)
    values = [0, 1023, 1024, 1280, 1792, (1 << 20) - 1, 5 << 18, 7 << 18, (1 << 30) - 1, 9 << 27, 11 << 27, 5960129 ** 2 * 1024 + 5960129,
              6038322 ** 2 * 1024 + 6038322, (1 << 62) + 12345, *(rng.randrange(1 << rng.randint(1, 62)) for _ in range(300))]
    df = spark.createDataFrame([(v,) for v in values], "n bigint")

    def printf(n):
        return f"{n} B" if n < 1024 else "%.1f KiB" % (n / 1024) if n < 1 << 20 else "%.1f MiB" % (n / 1048576) if n < 1 << 30 else "%.2f GiB" % (n / 1073741824)
    assert [(r.n, r.shown) for r in df.select("n", X.format_bytes("n").alias("shown")).collect()] == [(v, printf(v)) for v in values]


def test_crc_check_value(spark):
    rows = spark.sql("SELECT crc32(X'313233343536373839') AS a, crc32(X'') AS b").first()
    assert (rows.a, rows.b) == (0xcbf43926, 0)


def test_gaps_and_duplicates_across_bitmaps(spark):
    seqs = [1, 2, 2, 32768, 32769, 32769, 32769, 100000]
    ev = evidence(spark, [dict(kind=4, seq=s) for s in seqs] + [dict(kind=3, seq=0), dict(kind=4, seq=7, run_id=2)])
    got = {r.run_id: (r.records, r.distinct_seqs, r.last_seq, r.duplicates, r.gaps) for r in audit.sequence_audit(ev).collect()}
    assert got == {1: (8, 5, 100000, 3, 99995), 2: (1, 1, 7, 0, 6)}


def test_thin_runs_are_audited_in_plain_numbers(spark):
    """No aggregation buffer holds bytes: runs that are thin over a long range take no more memory than their rows."""
    seqs = [1, 63, 64, 64, 127, 128, 1 << 40, (1 << 40) + 63]
    ev = evidence(spark, [dict(kind=4, seq=s, run_id=r) for r in (1, 2) for s in seqs])
    df = audit.sequence_audit(ev)
    assert {tuple(r) for r in df.collect()} == {(r, 8, 7, (1 << 40) + 63, 1, (1 << 40) + 56) for r in (1, 2)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
