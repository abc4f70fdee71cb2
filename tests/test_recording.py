"""The data source of binary recordings: batches, growing files, restarts, damage."""

import pytest

from spoor import schemas
from spoor.sources import container, recording
from tests.builders import RUN_START, block, container as build, encode, envelope, sample_values


def _events(first, n):
    return b"".join(envelope(4, encode(4, [i, 2, 3, 9])) for i in range(first, first + n))


def _seen(df):
    return sorted((r.path, r.block_id, r.position, r.type, bytes(r.payload)) for r in df.collect())


def test_batches_are_the_records_of_the_container(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(recording, "PART_BYTES", 100)
    data = b"".join(envelope(kind, encode(kind, sample_values(kind, i))) for kind in schemas.RECORDS for i in range(3))
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "trace.jkt").write_bytes(build(block(1, RUN_START, 1), block(2, data, 54), block(3, b"", 0), block(4, _events(1, 500), 500))
                                                    + (b"JBLK" if name == "b" else b""))
    paths = [str(tmp_path / name) for name in ("a", "b")]
    got = _seen(recording.read(spark, paths))
    assert got == _seen(container.read_records(spark, paths)) and len(got) == 2 * 555


def test_a_growing_file_gives_each_record_once(spark, tmp_path):
    path, out, state = tmp_path / "grows.jkt", str(tmp_path / "out"), str(tmp_path / "state")
    blocks = [block(1, RUN_START, 1), block(2, _events(1, 10), 10), block(3, _events(11, 20), 20), block(4, _events(31, 5), 5)]
    whole = build(*blocks)
    ends = [len(build(*blocks[:n])) for n in range(5)]

    def arrived():
        run = (recording.stream(spark, [str(path)]).writeStream.format("parquet").option("checkpointLocation", state)
               .trigger(availableNow=True).start(out))
        run.awaitTermination()
        return sorted((r.block_id, r.position) for r in spark.read.schema(container.RECORDS).parquet(out).collect())

    sizes = [1, 10, 20, 5]
    for stop, n in ((ends[2] + 7, 2), (ends[3] - 1, 2), (ends[3], 3), (len(whole), 4), (len(whole), 4)):   # every run is a restart
        path.write_bytes(whole[:stop])
        assert arrived() == sorted((b + 1, i) for b in range(n) for i in range(sizes[b]))


def test_damage_fails(spark, tmp_path):
    bad = bytearray(build(block(1, RUN_START, 1), block(2, _events(1, 3), 3)))
    bad[-40] ^= 1
    (tmp_path / "bad.jkt").write_bytes(bytes(bad))
    with pytest.raises(Exception, match="checksum differs"):
        recording.read(spark, [str(tmp_path / "bad.jkt")]).count()
    text = encode(10, [1, "rax", 8]).replace(b"rax", b"r\xffx")
    (tmp_path / "text.jkt").write_bytes(build(block(1, RUN_START + envelope(10, text), 2)))
    tables, _ = container.read_container(spark, [str(tmp_path / "text.jkt")], str(tmp_path / "staged"))
    with pytest.raises(Exception, match="UTF-8"):
        tables["register_definitions"].collect()


def test_small_files_share_tasks_and_are_read_once(spark, tmp_path, monkeypatch):
    files = [tmp_path / f"{i}.jkt" for i in range(12)]
    for i, file in enumerate(files):
        file.write_bytes(build(block(1, RUN_START, 1), block(2, _events(1 + 10 * i, 10), 10)))
    paths = [str(file) for file in files]
    assert len(recording.RecordingReader(paths).partitions()) == 1
    monkeypatch.setattr(recording, "PART_BYTES", 3 * sum(run.blocks[0][3] + run.blocks[1][3] for run in recording._runs(paths[0], 16, 1)))
    assert [len(part.runs) for part in recording.RecordingReader(paths).partitions()] == [3] * 4
    staged = recording.read_by_type(spark, paths, str(tmp_path / "staged"))
    for file in files:
        file.unlink()                                            # the types are decoded from the staged records
    decoded = container.decode_records(staged.selectExpr("*", "1L AS run_id"), 4)
    assert sorted(r.sequence for r in decoded.collect()) == list(range(1, 121))
