"""Block-compressed text: every way of splitting gives the lines of the plain text."""

import gzip
import io
import os
import random
import tempfile

import pytest

from locusframe.sources import blocks as B
from locusframe.sources import vcf as V

from .test_io import VCF


def blocked(text: bytes, sizes) -> bytes:
    parts, at = [], 0
    while at < len(text):
        n = next(sizes)
        parts.append(B.block(text[at : at + n]))
        at += n
    return b"".join(parts) + B.END


def lines_of(path: str, split: int) -> list[str]:
    size = os.path.getsize(path)
    return [line for a in range(0, size, split) for batch in B.split_lines(path, a, a + split) for line in batch]


@pytest.mark.parametrize("seed", range(6))
def test_splits_give_the_lines(tmp_path, seed):
    r = random.Random(seed)
    rows = ["".join(r.choices("abcé\t", k=r.choice([0, 1, 5, 40, 700]))) for _ in range(120)]
    text = ("\r\n" if seed == 1 else "\n").join(rows) + ("" if seed == 2 else "\n")
    rows = rows[:-1] if seed == 2 and not rows[-1] else rows
    data = blocked(text.encode(), iter(lambda: r.choice([1, 7, 60, 300, 2000]), None))
    path = tmp_path / "x.gz"
    path.write_bytes(data)
    assert gzip.decompress(data).decode() == text
    for split in (64, 100, 333, 1500, 9000, len(data) - 1, len(data), 10**9):
        assert lines_of(str(path), split) == rows


def test_header_bytes_inside_a_block_are_passed_over(tmp_path):
    noise = random.Random(1).randbytes(3000).replace(b"\n", b" ")
    # Stored, not squeezed: the text of the block holds whole headers.
    body = noise + B.MAGIC + B.block(b"x\n")[:30] + noise
    squeezed = B.zlib.compressobj(0, B.zlib.DEFLATED, -15)
    raw = squeezed.compress(body) + squeezed.flush()
    one = B.block(b"")[:16] + (len(raw) + 25).to_bytes(2, "little") + raw + B.zlib.crc32(body).to_bytes(4, "little") + len(body).to_bytes(4, "little")
    data = one + B.block(b"\nsecond\n") + B.END
    assert B.first_block(io.BytesIO(data), 1, len(data)) == len(one)


def test_plain_gzip_empty_and_cut_files(tmp_path):
    plain = tmp_path / "p.gz"
    plain.write_bytes(gzip.compress(b"a\nb\n") + gzip.compress(b"c\nd"))
    assert lines_of(str(plain), 10) == ["a", "b", "c", "d"]
    empty = tmp_path / "e.gz"
    empty.write_bytes(B.END)
    assert lines_of(str(empty), 10) == []
    cut = tmp_path / "c.gz"
    cut.write_bytes(blocked(b"some\nlines\n" * 50, iter(lambda: 90, None))[:-40])
    for split in (30, 100, 10**6):
        with pytest.raises(ValueError, match="no whole block"):
            lines_of(str(cut), split)


def test_a_task_for_each_split(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(0, 2000, 1, 4).selectExpr("concat('line ', id) as value")
    for _ in range(2):  # the second time replaces the first
        B.write_lines(rows, path, 500)
    files = spark.read.text(path).inputFiles()
    assert len(files) == 4 and B.is_compressed(files)
    sizes = [os.path.getsize(f.removeprefix("file://")) for f in files]
    read = B.read_lines(spark, files, 1000)
    assert read.rdd.getNumPartitions() == sum(-(-n // 1000) for n in sizes) > 4
    assert [r["value"] for r in read.collect()] == [f"line {i}" for i in range(2000)] == [r["value"] for r in spark.read.text(files).orderBy("_metadata.file_path").collect()]


def test_vcf_in_blocks(spark, tmp_path):
    plain = tmp_path / "x.vcf"
    plain.write_text(VCF)
    path = tmp_path / "x.vcf.gz"
    path.write_bytes(blocked(VCF.encode(), iter(lambda: 37, None)))
    want, names = V.read_vcf(spark, str(plain))
    got, names2 = V.read_vcf(spark, str(path), split=90)
    order = lambda df: [tuple(r) for r in df.select("site_id", "snp_id", "raw", "calls").orderBy("site_id").collect()]
    assert names == names2 and order(got) == order(want)
    out = tempfile.mkdtemp(dir=tmp_path) + "/out"
    V.write_vcf(got, names, out, compress=True)
    again, names3 = V.read_vcf(spark, out, split=64)
    assert names3 == names and order(again) == order(want)


def test_many_small_splits_share_tasks(spark, monkeypatch, tmp_path):
    splits = [B.Split("f", i * 64, (i + 1) * 64) for i in range(2000)]
    own = B.runs(splits, 64)
    assert len(own) <= B.TASKS and [s for run in own for s in run] == splits
    assert all(len(run) == 1 for run in B.runs(splits, B.SPLIT)) and B.runs(splits[:256], 64) == [[s] for s in splits[:256]] and B.runs([], 64) == []
    path = tmp_path / "x.vcf.gz"
    rows = [f"RAD_{i}\t{i}\tl{i}\tA\tT\t13\tPASS\tNS=1\tGT:DP\t0/1:{i % 50}" for i in range(6000)]
    head = "##fileformat=VCFv4.2\n" + "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "s"]) + "\n"
    path.write_bytes(blocked((head + "\n".join(rows) + "\n").encode(), iter(lambda: 300, None)))
    size, split = os.path.getsize(path), 64
    assert -(-size // split) > 2 * B.TASKS and B.read_lines(spark, [str(path)], split).rdd.getNumPartitions() <= B.TASKS
    sites, names = V.read_vcf(spark, str(path), split=split)
    got = V.to_lines(sites, "site_id", sort=False).collect()
    assert names == ["s"] and sorted((r["site_id"], r["value"]) for r in got) == list(enumerate(rows))
