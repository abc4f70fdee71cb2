import hashlib
import json

import pytest

from spoor import schemas
from spoor.operators import evidence
from spoor.plans import tables as t
from spoor.sources import catalog, csv_run, prepared

SF = "/root/testdata/sf0.001"


def _csv_dir(tmp_path, **replace):
    for kind, name in schemas.NAMES.items():
        header = ",".join(n for n, _ in csv_run._columns(kind))
        body = "20,1700000000,5,8,\"all\",64,64,true,start\n" if kind == 1 else ""
        (tmp_path / f"{name}.csv").write_text(replace.get(name, f"{header}\n{body}"))
    return str(tmp_path)


HEADER4 = "sequence,monotonic_ns,thread_id,instruction_id"


def test_missing_files(spark, tmp_path):
    path = _csv_dir(tmp_path)
    (tmp_path / "capture_diagnostics.csv").unlink()
    assert "capture_diagnostics" not in csv_run.read_csv_run(spark, path)
    (tmp_path / "branch_events.csv").unlink()
    with pytest.raises(FileNotFoundError, match="branch_events"):
        csv_run.read_csv_run(spark, path)
    (tmp_path / "run.csv").unlink()
    with pytest.raises(FileNotFoundError, match="No recording found"):
        csv_run.read_csv_run(spark, path)


@pytest.mark.parametrize("text,message", [
    ("sequence,sequence,monotonic_ns,thread_id,instruction_id\n", "Repeated column"),
    ("sequence,monotonic_ns,thread_id\n", "not in CSV header: instruction_id")])
def test_headers(spark, tmp_path, text, message):
    with pytest.raises(ValueError, match=message):
        csv_run.read_csv_run(spark, _csv_dir(tmp_path, instruction_events=text))


@pytest.mark.parametrize("line", ["1,2,3", "1,2,3,4,5", "1,2,x,4", "1,2,4294967296,4", "-1,2,3,4", ",2,3,4"])
def test_bad_rows_fail(spark, tmp_path, line):
    tables = csv_run.read_csv_run(spark, _csv_dir(tmp_path, instruction_events=f"{HEADER4}\n1,2,3,4\n{line}\n"))
    with pytest.raises(Exception):
        tables["instruction_events"].collect()


def test_malformed_text_is_refused(spark, tmp_path):
    path = _csv_dir(tmp_path)
    (tmp_path / "register_definitions.csv").write_bytes(b'register_id,name,size\n1,"r\xffx",8\n')
    with pytest.raises(ValueError, match="Malformed UTF-8 in .*register_definitions"):
        csv_run.read_csv_run(spark, path)
    assert csv_run.read_csv_run(spark, path, strict=False)["register_definitions"].count() == 1


def test_extra_columns_are_kept_and_order_is_free(spark, tmp_path):
    text = 'instruction_id,note,thread_id,sequence,monotonic_ns,address\n4,"a ""b"",\nc",3,1,2,0xFF\n'
    (row,) = csv_run.read_csv_run(spark, _csv_dir(tmp_path, instruction_events=text))["instruction_events"].collect()
    assert (row.sequence, row.instruction_id, row.note, row.address) == (1, 4, 'a "b",\nc', 255)


def test_wrong_version_or_no_start(spark, tmp_path):
    header = ",".join(n for n, _ in csv_run._columns(1))
    with pytest.raises(ValueError, match="format 20"):
        csv_run.read_csv_run(spark, _csv_dir(tmp_path, run=f"{header}\n19,1,5,8,\"all\",64,64,true,start\n"))
    with pytest.raises(ValueError, match="no start row"):
        csv_run.read_csv_run(spark, _csv_dir(tmp_path, run=f"{header}\n20,1,5,8,\"all\",64,64,true,finish\n"))


def test_function_size_may_be_decimal_and_info_negative(spark, tmp_path):
    path = _csv_dir(tmp_path, function_definitions="function_id,module_id,address,module_offset,size,name\n1,2,0x10,0x0,77,\"f\"\n2,2,0x10,0x0,0x10,\"g\"\n",
                    context_change_events="sequence,monotonic_ns,thread_id,reason,info,from_instruction_pointer,to_instruction_pointer\n1,2,3,4,-5,0x1,0xffffffffffffffff\n")
    tables = csv_run.read_csv_run(spark, path)
    assert sorted(r.size for r in tables["function_definitions"].collect()) == [16, 77]
    (row,) = tables["context_change_events"].collect()
    assert (row.info, int(row.to_instruction_pointer)) == (-5, (1 << 64) - 1)


def test_publish_is_refused_when_the_source_changes(spark, tmp_path):
    source = tmp_path / "source"
    source.mkdir()
    (source / "trace.jkt").write_bytes(b"one")
    tables = t.all_tables(spark, SF)
    out = str(tmp_path / "out")
    with pytest.raises(RuntimeError, match="changed"):
        prepared.prepare_run(spark, tables, out, [str(source)],
                             before_publish=lambda: (source / "trace.jkt").write_bytes(b"two!"))
    with pytest.raises(FileNotFoundError):
        prepared.open_run(spark, out)
    again = str(tmp_path / "again")
    prepared.prepare_run(spark, tables, again, [str(source)])
    opened = prepared.open_run(spark, again, [str(source)])
    assert opened["evidence"].filter("kind = 4").count() == 340
    plan = opened["evidence"].filter("kind = 5 AND seq > 500").select("seq")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "GreaterThan(seq,500)" in plan
    with pytest.raises(ValueError, match="prepared already"):
        prepared.prepare_run(spark, tables, again, [str(source)])
    assert prepared.open_run(spark, again, version=1)["evidence"].count() == opened["evidence"].count()
    with pytest.raises(FileNotFoundError):
        prepared.open_run(spark, again, version=2)
    (source / "trace.jkt").write_bytes(b"three")
    with pytest.raises(RuntimeError, match="does not belong"):
        prepared.open_run(spark, again, [str(source)])


def test_provenance(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "trace.jkt").write_bytes(b"x" * 100000)
    (row,) = catalog.source_provenance(spark, [str(tmp_path)]).collect()
    assert (row.length, row.sha256) == (100000, hashlib.sha256(b"x" * 100000).hexdigest())


def test_session_catalog(spark, tmp_path):
    def put(rel, data):
        path = tmp_path / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data if isinstance(data, bytes) else data.encode())

    put("2024-01/session.info", '"C:\\\\a \\"b\\".exe" "-x 1" "all" 1700000000')
    put("2024-01/session.done", "1700000009 -5")
    put("2024-01/trace.jkt", b"1" * 10)
    put("2024-01/process-7/trace.jkt", b"1" * 5)
    put("2024-01/other/trace.jkt", b"1" * 100)
    put("2024-01/writer-performance.json", json.dumps({"completed_blocks": 3, "storage_failed": True}, indent=2))
    put("2024-01/instrumentation-performance.json", json.dumps({"translation_callback_seconds": 1.5}))
    put("2024-02/run.csv", b"ab")
    put("2024-02/modules.csv", b"abc")
    put("2024-02/notes.txt", b"abcdef")
    put("2024-03/readme.txt", b"none")
    rows = catalog.session_catalog(spark, str(tmp_path)).collect()
    assert [r.session for r in rows] == ["2024-02", "2024-01"]
    a, b = rows[1], rows[0]
    assert (a.target, a.arguments, a.scope, a.started_at) == ('C:\\a "b".exe', "-x 1", "all", 1700000000)
    assert (a.finished_at, a.exit_code, a.has_trace, a.trace_bytes) == (1700000009, -5, True, 15)
    assert (a.completed_blocks, a.storage_failed, a.translation_seconds) == (3, True, 1.5)
    assert (b.has_trace, b.trace_bytes, b.completed_blocks, b.storage_failed, b.exit_code) == (False, 5, 0, False, None)


def test_both_forms_load_together(spark, tmp_path):
    from tests.builders import RUN_START, block, container as build, encode, envelope
    for name in ("text", "binary"):
        (tmp_path / name).mkdir()
    _csv_dir(tmp_path / "text", instruction_events=f"{HEADER4}\n1,2,3,4\n")
    whole = build(block(1, RUN_START + envelope(4, encode(4, [1, 2, 3, 9])), 2), block(2, b"", 0))
    (tmp_path / "binary" / "trace.jkt").write_bytes(whole[:-1])
    tables, labels = prepared.read_runs(spark, [str(tmp_path / "text"), str(tmp_path / "binary")], str(tmp_path / "staging"))
    assert {(r.run_id, r.instruction_id) for r in tables["instruction_events"].collect()} == {(1, 4), (2, 9)}
    assert {(r.run_id, r.label, r.incomplete) for r in labels.collect()} == {(1, "text", False), (2, "binary", True)}


def test_container_profile(spark, tmp_path):
    from spoor.operators import audit
    from spoor.sources import container
    from tests.builders import RUN_END, RUN_START, block, container as build
    path = tmp_path / "trace.jkt"
    path.write_bytes(build(block(1, RUN_START, 1), block(2, RUN_END, 1)))
    (row,) = audit.container_profile(container.read_records(spark, [str(path)])).collect()
    assert (row.type, row.records, row.decoded_bytes) == (1, 2, len(RUN_START) + len(RUN_END))


def test_load_runs_of_all_event_types(spark):
    tables = t.typed_tables(spark, SF, runs=True)
    merged, labels = prepared.load_runs([(label, {n: df.filter(df.run_id == i) for n, df in tables.items()}) for i, label in enumerate(t.RUNS, 1)])
    count = lambda df: {(r.run_id, r.kind): r["count"] for r in df.groupBy("run_id", "kind").count().collect()}
    got = count(evidence.to_evidence(merged))
    assert got == count(t.evidence(spark, SF, runs=True)) and len({kind for _, kind in got}) == len(tables)
    assert {r.run_id: r.label for r in labels.collect()} == dict(enumerate(t.RUNS, 1))
