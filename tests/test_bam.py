"""Binary alignments: round trips in splits of any size, broken files, long records."""

import io
import struct

import numpy as np
import pytest

from tallyhelix.sources import bam

CONTIGS = [("chr1", 1_000_000), ("chr2", 500_000), ("chrX_alt", 70_000)]


def rows(n: int, seed: int = 0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        ref = int(rng.integers(-1, 3))
        pos = int(rng.integers(1, 60_000)) if ref >= 0 else 0
        cigar = "*" if ref < 0 else f"{rng.integers(1, 99)}S{rng.integers(1, 99)}M{rng.integers(1, 9)}D{rng.integers(1, 60)}M"
        out.append((f"read:{i}/{'x' * int(rng.integers(0, 40))}", int(rng.integers(0, 4096)), ref, pos, int(rng.integers(0, 61)), cigar))
    return out


def file_of(records, block: int = bam.BLOCK_IN, contigs=CONTIGS) -> bytes:
    data = bam.head_bytes(contigs) + b"".join(bam.record(*r) for r in records)
    return b"".join(bam.packed(data[i : i + block]) for i in range(0, len(data), block)) + bam.LAST_BLOCK


def read(raw: bytes, split: int):
    """All ranges of a file, one after the other; records per range."""
    out, per = [], []
    for a in range(0, len(raw), split):
        got = [r for b in bam.decoded(io.BytesIO(raw), "x.bam", len(raw), a, min(a + split, len(raw)), "x") for r in b.to_pylist()]
        out += got
        per.append(len(got))
    return out, per


def want(records):
    names = [n for n, _ in CONTIGS] + ["*"]
    return [(q, f, names[c], p, m, g) for q, f, c, p, m, g in records]


@pytest.mark.parametrize("block", [300, 5_000, bam.BLOCK_IN])
@pytest.mark.parametrize("split", [97, 1_000, 20_000, 1 << 20])
def test_every_record_once_in_any_splits(block, split):
    records = rows(700, block)
    got, per = read(file_of(records, block), split)
    assert [(r["qname"], r["flag"], r["chrom"], r["pos"], r["mapq"], r["cigar"]) for r in got] == want(records)
    order = [r["ord"] for r in got]
    assert order == sorted(set(order))
    if block <= 5_000 and split == 1_000:
        assert sum(n > 0 for n in per) > 3


def test_records_longer_than_blocks_and_splits():
    long = [("a" * 200, 99, 0, 5, 60, "3M2I" * 30_000 + "5M"), ("b", 147, 0, 9, 60, "10M"), ("c", 99, 1, 7, 60, "1M1D" * 40_000), *rows(50)]
    for split in (500, 7_000):
        got, _ = read(file_of(long, 4_000), split)
        assert [(r["qname"], r["cigar"]) for r in got] == [(q, g) for q, *_, g in long]


def test_a_long_header_and_an_empty_file():
    contigs = [(f"contig_{i}", 1000 + i) for i in range(3_000)]
    records = [(f"q{i}", 99, i, 10, 60, "5M") for i in range(300)]
    got, _ = read(file_of(records, 700, contigs), 1_500)
    assert [(r["qname"], r["chrom"]) for r in got] == [(f"q{i}", f"contig_{i}") for i in range(300)]
    assert read(file_of([]), 50)[0] == []


def test_broken_files_raise():
    raw = file_of(rows(400), 2_000)
    at = raw.index(bam.MAGIC, len(raw) // 2)
    for bad in (raw[: at + 40], raw[: at + 30] + b"\0\0\0" + raw[at + 33 :], raw[:at] + b"\0" + raw[at + 1 :]):
        for split in (900, 1 << 20):
            with pytest.raises(ValueError, match="broken block"):
                read(bad, split)
    data = bam.head_bytes(CONTIGS) + b"".join(bam.record(*r) for r in rows(20))
    for bad in (data[:-7], data + struct.pack("<i", 5) + b"12345"):
        with pytest.raises(ValueError, match="within a record|broken record"):
            read(bam.packed(bad) + bam.LAST_BLOCK, 1 << 20)
    with pytest.raises(ValueError, match="no alignments"):
        read(bam.packed(b"something else") + bam.LAST_BLOCK, 1 << 20)


def test_source_reads_files_and_folders_in_splits(spark, tmp_path):
    one, two = rows(3_000, 1), rows(800, 2)
    (tmp_path / "S01.bam").write_bytes(file_of(one, 3_000))
    (tmp_path / "S02.bam").mkdir()
    for i in range(2):
        (tmp_path / "S02.bam" / f"part-{i}.bam").write_bytes(file_of(two[i::2], 3_000))
    paths = [str(tmp_path / "S01.bam"), f"file://{tmp_path}/S02.bam"]
    df = bam.read_bam(spark, paths, split_bytes=8_000)
    assert df.rdd.getNumPartitions() > 8
    got = df.orderBy("sample", "ord").collect()
    assert [tuple(r)[1:7] for r in got if r.sample == "S01"] == want(one)
    assert [tuple(r)[1:7] for r in got if r.sample == "S02"] == want(two[0::2] + two[1::2])
    assert len({(r.sample, r.ord) for r in got}) == len(got)
    assert bam.read_bam(spark, []).count() == 0
    with pytest.raises(Exception, match="nothing.bam"):
        bam.read_bam(spark, [str(tmp_path / "nothing.bam")]).count()


def test_written_files_are_read_back(spark, tmp_path):
    a = [(s, f"q{i}", 99 if k == 0 else 147, "chr1", 100 * i + k + 1, 60, "20M", k) for s in ("A", "B") for i in range(50) for k in range(2)]
    df = spark.createDataFrame(a, bam.SCHEMA)
    for _ in range(2):  # again: the same files
        bam.write_bam(df, str(tmp_path), CONTIGS, tasks=3)
    got = bam.read_bam(spark, [str(tmp_path / "A.bam"), str(tmp_path / "B.bam")], split_bytes=300).orderBy("sample", "qname", "ord").collect()
    assert [tuple(r)[:7] for r in got] == [r[:7] for r in sorted(a, key=lambda r: (r[0], r[1], r[7]))]


def test_files_follow_the_alignments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bam, "SORTED", 50, raising=False)
    data = [(f"S{i % 3}", f"q{i // 2}", 99, "chr1", 100 + i, 60, "50M", i) for i in range(600)]
    df = spark.createDataFrame(data, "sample string, qname string, flag int, chrom string, pos long, mapq int, cigar string, ord long")
    bam.write_bam(df, str(tmp_path), CONTIGS)
    files = list(tmp_path.glob("S*.bam/part-*.bam"))
    sizes = [bam.read_bam(spark, [str(f)]).count() for f in files]
    assert sum(sizes) == 600 and max(sizes) <= 150
    # a range for each task, not a file of each sample in each task
    assert len(files) <= 12 + 3
    got = bam.read_bam(spark, [str(tmp_path / f"S{k}.bam") for k in range(3)]).collect()
    assert sorted((r.sample, r.qname, r.pos) for r in got) == sorted((r[0], r[1], r[4]) for r in data)
