import random
from decimal import Decimal

import pytest

from spoor import schemas
from spoor.sources import container
from tests.builders import RUN_END, RUN_START, block, container as build, encode, envelope, sample_values


def _write(tmp_path, data, name="trace.jkt"):
    path = tmp_path / name
    path.write_bytes(data)
    return str(path)


def _statuses(spark, path):
    rows = container.audit_blocks(spark, [path]).orderBy("block_offset").collect()
    return [(r.block_id, r.status) for r in rows]


def _lifecycles(first, count):
    out = b""
    for i in range(first, first + count):
        values = [i // 2 + 1, i + 2, i * 10, i % 12, 1, "allocate", *range(12), 7, 8, 9, 32, 4, True, i % 2 == 0, True]
        out += envelope(15, encode(15, values))
    return out


def test_ten_thousand_records_in_many_blocks(spark, tmp_path):
    blocks, number = [block(1, RUN_START, 1)], 2
    for first in range(0, 10000, 999):
        n = min(999, 10000 - first)
        blocks.append(block(number, _lifecycles(first, n), n))
        number += 1
    blocks += [block(number, b"", 0), block(number + 1, RUN_END, 1)]
    _write(tmp_path, build(*blocks))
    assert {s for _, s in _statuses(spark, str(tmp_path))} == {"Block"}
    tables, state = container.read_container(spark, [str(tmp_path)], str(tmp_path / "staging"))
    rows = tables["memory_lifecycle_events"].orderBy("sequence").collect()
    assert len(rows) == 10000
    assert all((r.operation_id, r.sequence, r.thread_id, r.size, r.entering, r.action) ==
               (i // 2 + 1, i + 2, i % 12, 32, i % 2 == 0, "allocate") for i, r in enumerate(rows))
    (s,) = state.collect()
    assert (s.incomplete, s.started, s.blocks) == (False, True, len(blocks))
    assert sorted(r.started for r in tables["run"].collect()) == [False, True]


def test_every_record_type_round_trips(spark, tmp_path):
    data, n = b"", 0
    for kind in schemas.RECORDS:
        for i in range(2):
            data += envelope(kind, encode(kind, sample_values(kind, i)))
            n += 1
    tables, _ = container.read_container(spark, [_write(tmp_path, build(block(1, data, n)))], str(tmp_path / "s"))
    for kind, name in schemas.NAMES.items():
        rows = tables[name].collect()
        fields = schemas.fields(kind)
        got = {tuple(bytes(r[f]) if c == "bytes" else r[f] for f, c in fields) for r in rows}
        expected = set()
        for i in range(2):
            expected.add(tuple(Decimal(v) if c == "address" else v for v, (f, c) in zip(sample_values(kind, i), fields)))
        assert got == expected, name


def test_truncation_keeps_whole_blocks(spark, tmp_path):
    whole = build(block(1, RUN_START, 1), block(2, _lifecycles(0, 50), 50), block(3, _lifecycles(50, 50), 50))
    last = len(build(block(1, RUN_START, 1), block(2, _lifecycles(0, 50), 50)))
    rng = random.Random(10)
    for i, cut in enumerate([last + 1, last + 31, last + 32, len(whole) - 17, len(whole) - 16, len(whole) - 1,
                             rng.randint(last + 40, len(whole) - 20)]):
        path = _write(tmp_path, whole[:cut], f"cut{i}.jkt")
        assert _statuses(spark, path) == [(1, "Block"), (2, "Block"), (3 if cut >= last + 32 else None, "Incomplete")]
    tables, state = container.read_container(spark, [path], str(tmp_path / "staged"))
    assert tables["memory_lifecycle_events"].count() == 50
    assert [(s.incomplete, s.started) for s in state.collect()] == [(True, True)]
    early = _write(tmp_path, whole[:40], "early.jkt")
    with pytest.raises(ValueError, match="No run start"):
        container.read_container(spark, [early], str(tmp_path / "staged-early"))


def test_damage_is_reported_and_refused(spark, tmp_path):
    good = _lifecycles(0, 3)
    flipped = bytearray(build(block(1, RUN_START, 1), block(2, good, 3)))
    flipped[-40] ^= 1
    bad_footer = bytearray(build(block(1, RUN_START, 1), block(2, good, 3)))
    bad_footer[-1] ^= 1
    cases = {
        "flip": (bytes(flipped), "Corrupt"),
        "footer": (bytes(bad_footer), "Incomplete"),
        "number": (build(block(1, RUN_START, 1), block(3, good, 3)), "Corrupt"),
        "flags": (build(block(1, RUN_START, 1), block(2, good, 3, flags=2)), "Corrupt"),
        "count": (build(block(1, RUN_START, 1), block(2, good, 4)), "Corrupt"),
        "envelope": (build(block(1, RUN_START, 1), block(2, good[:-1], 3)), "Corrupt"),
        "size": (build(block(1, RUN_START, 1), block(2, good, 3, decoded=len(good) + 1)), "Corrupt"),
        "codec": (build(block(1, RUN_START, 1), block(2, good, 3, codec=1)), "UnsupportedCodec"),
    }
    for name, (data, status) in cases.items():
        path = _write(tmp_path, data, name)
        assert [s for _, s in _statuses(spark, path)] == ["Block", status], name
        with pytest.raises(Exception):
            container.read_records(spark, [path]).count()
    header = _write(tmp_path, b"NOTTRACE" + b"\0" * 40, "header")
    assert [s for _, s in _statuses(spark, header)] == ["Corrupt"]
    unknown = _write(tmp_path, build(block(1, RUN_START + envelope(19, b"x"), 2)), "unknown")
    assert [s for _, s in _statuses(spark, unknown)] == ["Block"]
    with pytest.raises(Exception, match="Unknown record type 19"):
        container.read_records(spark, [unknown]).count()


def test_malformed_fields_fail(spark, tmp_path):
    event = encode(4, [1, 2, 3, 4])
    flag = encode(9, [1, 2, 3, 4, True])[:-1] + b"\x02"
    for i, (kind, payload) in enumerate([(4, event + b"\0"), (4, event[:-1]), (9, flag), (10, encode(10, [1, "rax", 8])[:-5])]):
        path = _write(tmp_path, build(block(1, RUN_START + envelope(kind, payload), 2)), f"m{i}")
        tables, _ = container.read_container(spark, [path], str(tmp_path / f"m{i}-staged"))
        with pytest.raises(Exception, match="Undecodable record|Bytes left over"):
            tables[schemas.NAMES[kind]].collect()


def test_several_files_get_run_ids_in_order(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "trace.jkt").write_bytes(build(block(1, RUN_START + envelope(4, encode(4, [1, 2, 3, ord(name)])), 2)))
    tables, state = container.read_container(spark, [str(tmp_path / "b"), str(tmp_path / "a")], str(tmp_path / "staged"))
    assert {(r.run_id, r.instruction_id) for r in tables["instruction_events"].collect()} == {(1, ord("b")), (2, ord("a"))}
    assert state.count() == 2
