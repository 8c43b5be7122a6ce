"""FASTA in byte ranges against the whole read: plain, blocked gzip, plain gzip, every range size."""

import gzip
import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqfold.sources import blocks, readers


def blocked(data: bytes, size: int) -> bytes:
    """data as blocked gzip, size bytes of text a block, with the empty block that ends such files."""
    out = b""
    for part in [data[i : i + size] for i in range(0, len(data), size)] + [b""]:
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def plain_parse(text: bytes) -> list[tuple[str, str, str]]:
    out, now = [], None
    for line in text.split(b"\n"):
        if line.startswith(b">"):
            now = [line[1:].decode().strip(), ""]
            out.append(now)
        elif now is not None:
            now[1] += "".join(line.decode().split())
    return [(h.split()[0], h, s) for h, s in out if h]


def rows_of(path: str, span: int, columns=blocks.COLUMNS):
    """What the tasks of all ranges read, one after another, without Spark."""
    from pyspark.sql.types import StringType, StructField, StructType

    reader = blocks.Reader({"path": path, "range": span}, StructType([StructField(c, StringType()) for c in columns]))
    return [tuple(r[c] for c in columns) for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]


PIECES = st.sampled_from([b">", b"\n", b"\n>", b">a b\n", b"ACGT", b"\r\n", b" ", b"x>y", b">g1 d\nACG\nTTT\n", b"\n\n", b">\n"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=25), st.integers(1, 12), st.integers(1, 9), st.integers(1, 7))
def test_any_ranges_give_the_whole_read(tmp_path_factory, pieces, span, size, read):
    text, folder = b"".join(pieces), tmp_path_factory.mktemp("any")
    want = plain_parse(text)
    files = {"a.fa": text, "b.fa.gz": blocked(text, size), "c.fa.gz": gzip.compress(text[:7]) + gzip.compress(text[7:])}
    was, blocks.READ = blocks.READ, read * 16
    try:
        for name, data in files.items():
            (folder / name).write_bytes(data)
            assert rows_of(str(folder / name), span * (1 if name == "a.fa" else 17)) == want
            assert rows_of(str(folder / name), span * 20, ("header", "gene")) == [(h, g) for g, h, _ in want]
    finally:
        blocks.READ = was


def test_tasks_share_a_file(spark, tmp_path):
    rng, text = random.Random(1), b""
    for i in range(3000):
        seq = "".join(rng.choices("ACGT", k=rng.choice([0, 30, 300, 3000]))).encode()
        text += b">gene%d some text\n" % i + b"".join(seq[j : j + 60] + b"\n" for j in range(0, len(seq), 60))
    for name, data, several in (("a.fa", text, True), ("b.fa.gz", blocked(text, 60_000), True), ("c.fa.gz", gzip.compress(text), False)):
        path = str(tmp_path / name)
        (tmp_path / name).write_bytes(data)
        df = blocks.sequences(spark, path, span=100_000)
        assert sorted(map(tuple, df.collect())) == sorted(plain_parse(text))
        assert (df.rdd.getNumPartitions() > 5) == several
        if name == "a.fa":
            assert sorted(map(tuple, df.collect())) == sorted((r.gene, r.header, r.seq) for r in readers.fasta(spark, path).collect())
    (tmp_path / "_SUCCESS").write_bytes(b"")
    assert blocks.sequences(spark, str(tmp_path), ("gene",)).groupBy("gene").count().where("count <> 3").count() == 0


def test_odd_files(spark, tmp_path):
    (tmp_path / "empty.fa").write_bytes(b"")
    assert blocks.sequences(spark, str(tmp_path)).count() == 0
    (tmp_path / "late.fa").write_bytes(b"; told before\nACGT\n>\nAC\n> a one\nAC GT\r\nac\n>b")
    assert [tuple(r) for r in blocks.sequences(spark, str(tmp_path)).collect()] == [("a", "a one", "ACGTac"), ("b", "b", "")]
    with pytest.raises(Exception, match="nowhere"):
        blocks.sequences(spark, str(tmp_path / "nowhere.fa")).collect()
    whole = blocked(b">a\nACGT\n" * 50, 100)
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "x.gz").write_bytes(whole[:-40])
    with pytest.raises(ValueError, match="block"):
        rows_of(str(tmp_path / "cut"), 10**6)
    plain = gzip.compress(b">a\n" + b"ACGT" * 10_000_000)  # 40 MB from 40 KB: unpacked piece by piece
    (tmp_path / "y.gz").write_bytes(plain)
    assert [len(r[2]) for r in rows_of(str(tmp_path / "y.gz"), 10**6)] == [40_000_000]
    (tmp_path / "y.gz").write_bytes(plain[:-9])
    with pytest.raises(ValueError, match="end is missing"):
        rows_of(str(tmp_path / "y.gz"), 10**6)
