"""The content digest: published vectors, and files in pieces."""

import os
import random

import pytest
from pyspark.sql import functions as F

from stowage.functions import blake3
from stowage.sources import filetree

#: Published test vectors: digests of the first n bytes of 0, 1, ..., 250, 0, 1, ... (fixed values).
VECTORS = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
    1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
    1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
    2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a",
    2049: "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030",
    3072: "b98cb0ff3623be03326b373de6b9095218513e64f1ee2edd2525c7ad1e5cffd2",
    4096: "015094013f57a5277b59d8475c0501042c0b642e531b0a1c8f58d2163229e969",
    102400: "bc3e3d41a1146b069abffad3c0d44860cf664390afce4d9661f7902e7943e085",
}


def bytes_of(n):
    return bytes(i % 251 for i in range(n))


def test_published_vectors():
    assert dict(zip(VECTORS, blake3.digests([bytes_of(n) for n in VECTORS]), strict=True)) == VECTORS
    for n, want in VECTORS.items():
        data = bytes_of(n)
        assert blake3.span_digest(lambda at, k, data=data: data[at:at + k], n) == want


@pytest.mark.parametrize("n", [1025, 4096, 5000, 16_384, 33_000])
def test_pieces_and_windows_give_the_digest_of_the_whole(n, monkeypatch):
    data = random.Random(n).randbytes(n)
    want, read = blake3.digests([data])[0], lambda at, k: data[at:at + k]
    monkeypatch.setattr(blake3, "WINDOW", 2048)
    assert blake3.span_digest(read, n) == want
    for segment in (1024, 2048, 8192):
        if n > segment:
            assert blake3.joined([blake3.piece_value(read, n, k, segment) for k in range(-(-n // segment))]) == want


def test_one_file_is_many_tasks_work(spark, tmp_path):
    sizes = {"a": 70_000, "b": 4096, "c": 4097, "d": 0, "e": 12, "f": 16_384}
    for name, n in sizes.items():
        (tmp_path / name).write_bytes(random.Random(n).randbytes(n))
    rows = [(str(tmp_path / name), n) for name, n in sizes.items()] + [(str(tmp_path / "gone"), 9000), (str(tmp_path / "gone2"), 1), (str(tmp_path / "e"), 12)]
    (tmp_path / "short").write_bytes(b"x")
    got = {os.path.basename(r["path"]): (r["content_hash"], r["warning"]) for r in filetree.hashed(spark.createDataFrame([*rows, (str(tmp_path / "short"), 5000)], "path string, size_bytes bigint"), 4096).collect()}
    assert {k: v[0] for k, v in got.items() if k in sizes} == {k: filetree.digest(str(tmp_path / k)) for k in sizes}
    assert got["gone"][0] is None and "No such file" in got["gone"][1] and got["gone2"][0] is None and "changed" in got["short"][1] and len(got) == 9


def test_digest_of_a_column(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, ""), (4, "abc")], "k int, t string")
    got = {r["k"]: r["digest"] for r in blake3.with_digest(df, "t").collect()}
    assert got == {1: "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85", 2: None, 3: VECTORS[0], 4: got[1]}
    assert blake3.with_digest(df.limit(0), "t").count() == 0 and blake3.with_digest(df.select(F.col("t")), "t").columns == ["t", "digest"]
