"""Archives and files whose size in a task's memory does not grow with the tables."""

import io
import tarfile

import pyarrow as pa
import pytest

from loomset.plans import catalog, endtoend
from loomset.sources import archives, files, tar
from tests.oracle import assert_same, connection


@pytest.fixture
def small(monkeypatch):
    """Archives of some 64 kB, so that the small tables need several."""
    monkeypatch.setattr(tar, "ARCHIVE", 64 << 10)


def test_archives_are_as_many_as_their_bytes_need(spark, sf, small):
    held = catalog.archives(spark, sf)
    sizes = [len(r.content) for r in held.collect()]
    total, largest = sum(sizes), max(len(r.data) for r in catalog.member_files(spark, sf).collect())
    assert len(sizes) >= total // (128 << 10) > 2
    assert max(sizes) <= tar.ARCHIVE + largest + 4 * tarfile.RECORDSIZE


def test_members_come_in_batches_of_bounded_size(monkeypatch):
    monkeypatch.setattr(tar, "FLUSH", 1000)
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:") as out:
        for i in range(50):
            info = tarfile.TarInfo(str(i))
            info.size = 100 * (i % 3)
            out.addfile(info, io.BytesIO(b"x" * info.size))
    with tarfile.open(fileobj=pa.BufferReader(raw.getvalue()), mode="r:") as held:
        batches = list(tar.member_batches("a", held))
    assert all(sum(b.column(2).to_pylist()) <= 1200 for b in batches) and len(batches) >= 4
    assert [n for b in batches for n in b.column(1).to_pylist()] == [str(i) for i in range(50)]


@pytest.mark.parametrize("name", ["src6_tar_index", "src9_tar_members", "snk3_verify_tar", "flow1_archive_samples", "join1_read_member", "snk2_packed_by_pattern", "src7_refreshed_index", "sql7_index_versions"])
def test_queries_over_many_archives(name, spark, sf, small):
    assert_same(catalog.QUERIES[name](spark, sf), connection(sf), catalog.SQL[name])


def test_archives_that_are_written_again_leave_no_old_ones(spark, sf, small, tmp_path):
    docs = endtoend.documents(spark, sf)
    endtoend.shards(spark, docs, f"{tmp_path}/a")
    many = len(list(tmp_path.glob("a/*.tar")))
    endtoend.shards(spark, docs.where("doc_id % 20 = 1"), f"{tmp_path}/a")
    assert 0 < len(list(tmp_path.glob("a/*.tar"))) < many
    index = spark.read.format("tarindex").load(f"{tmp_path}/a")
    assert index.count() == docs.where("doc_id % 20 = 1").count()


def test_tensors_come_in_batches_of_bounded_size(spark, monkeypatch):
    rows = [("k", f"t{i:03d}", [2, 50], [float(i + j) for j in range(100)]) for i in range(40)] + [("k", "none", [0], [])]
    df = spark.createDataFrame(rows, "key string, name string, shape array<int>, values array<float>")
    (raw,) = [r.content for r in files.tensors_packed(df, "key").collect()]
    import zstandard

    monkeypatch.setattr(files, "UNPACKED", 4000)
    data = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    batches = list(files.tensor_batches("key", "k", pa.string(), data))
    assert len(batches) >= 5 and max(b.num_rows for b in batches) <= 8
    assert sorted((r["key"], r["name"], r["shape"], r["values"]) for b in batches for r in b.to_pylist()) == sorted(rows)


def test_a_key_of_many_tensors_has_files_of_bounded_size(spark):
    rows = spark.range(40).selectExpr("1 as key", "concat('t', id) as name", "array(250000) as shape", "array_repeat(cast(id as float), 250000) as values")
    assert files.tensors_packed(rows, "key").count() > 1


def test_a_folder_is_packed_by_as_many_tasks_as_its_bytes_need(spark, sf, monkeypatch):
    monkeypatch.setattr(archives, "PACK", 16 << 10, raising=False)
    made, pack = [], archives.pack_folder
    monkeypatch.setattr(archives, "pack_folder", lambda *a, **k: made.append(pack(*a, **k)) or made[0])
    assert_same(catalog.QUERIES["snk2_packed_folder"](spark, sf), connection(sf), catalog.SQL["snk2_packed_folder"])
    assert made[0].count() > 4
