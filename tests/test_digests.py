"""SHA-256 of long files, range by range, against hashlib over whole files."""

import gzip
import hashlib

import numpy as np
import pytest

from tarnwave.sources import digests, io


def contents():
    r = np.random.default_rng(5)
    noise = r.integers(0, 256, 90_000, dtype=np.uint8).tobytes()
    return {
        "noise": noise,
        "again": noise,
        "one bit %41 ü": noise[:-1] + bytes([noise[-1] ^ 1]),
        "feeds": b"\n" * 5003,
        "returns": b"a\r\n\rb\r\n" * 900,
        "ends": noise[:9000] + b"\n",
        "ends twice": noise[:9000] + b"\n\n",
        "open": b"x" * 30_001,
        "zeros": bytes(20_480),
        "mark": digests.BOM + noise[:5000] + b"\n",
        "mark, open": digests.BOM + b"y" * 5000,
        "mark alone": digests.BOM,
        "two marks": digests.BOM * 2 + b"\n",
        "feed": b"\n",
        "packed.gz": gzip.compress(noise, mtime=0),
    }


def test_state_goes_on_where_it_stopped():
    lib, data = digests.library(), contents()["noise"]
    for cut in (0, 1, 55, 56, 63, 64, 65, 4096, len(data)):
        assert digests.digest(lib, digests.further(lib, digests.further(lib, digests.begun(lib), data[:cut]), data[cut:])) == hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize(("whole", "reach", "split"), [(0, 20_000, 9000), (2000, 1 << 20, 30_000), (40_000, 30_001, 16_000)])
def test_ranges_give_the_digests_of_whole_files(spark, tmp_path, whole, reach, split):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    made = contents()
    for i, (name, data) in enumerate(made.items()):
        (tmp_path / "in" / ("deep" if i % 2 else ".") / name).write_bytes(data)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for k, v in zip(before, (split, 1, 17), strict=True):
            spark.conf.set(k, v)
        got = io.list_files(spark, str(tmp_path / "in"), whole=whole, reach=reach).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r["name"], r["bytes"], r["sha256"]) for r in got) == sorted((k, len(x), hashlib.sha256(x).hexdigest()) for k, x in made.items())
    assert {r["path"] for r in got} == {r["path"] for r in io.list_files(spark, str(tmp_path / "in")).select("path").collect()}


def test_no_long_file_is_read_whole(spark, tmp_path):
    """Spark refuses to read contents of more than this as a whole, in any task."""
    data = contents()["noise"]
    (tmp_path / "long").write_bytes(data * 3)
    (tmp_path / "short").write_bytes(data)
    key = "spark.sql.sources.binaryFile.maxLength"
    known = spark.conf.get(key)
    try:
        spark.conf.set(key, len(data))
        got = {r["name"]: r["sha256"] for r in io.list_files(spark, str(tmp_path), whole=len(data)).collect()}
    finally:
        spark.conf.set(key, known)
    assert got == {"long": hashlib.sha256(data * 3).hexdigest(), "short": hashlib.sha256(data).hexdigest()}


def test_without_the_library_files_are_read_whole(spark, tmp_path, monkeypatch):
    (tmp_path / "a").write_bytes(b"abc" * 999)
    monkeypatch.setattr(digests, "library", lambda: None)
    assert [r["sha256"] for r in io.list_files(spark, str(tmp_path), whole=5).collect()] == [hashlib.sha256(b"abc" * 999).hexdigest()]
