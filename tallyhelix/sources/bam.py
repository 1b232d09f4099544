"""Binary alignment files (BAM) as a splittable source, and a writer of them.

A file is cut into byte ranges. A task looks for the first compressed block that begins in its range, then, as records need not begin
with a block, for the first place from which plausible records follow each other, and decodes from there every record that begins in a block of its range; the last may
end beyond it. So every record is read once, whatever the ranges are. Blocks are checked against their lengths and checksums; what is broken or cut off raises.

A path stands for one sample: a file, or a folder of files. Files are opened through the file systems of Arrow, in tasks only.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "sample string, qname string, flag int, chrom string, pos long, mapq int, cigar string, ord long"
COLUMNS = [f.split()[0] for f in SCHEMA.split(", ")]
#: Bytes of a file that a task reads, and of decoded records that are held at a time.
SPLIT, HELD = 64 << 20, 4 << 20
#: Fixed values of the format: first bytes of a block, letters of the operations, the block that ends a file, most bytes of a block before and after compression.
MAGIC = b"\x1f\x8b\x08\x04"
OPERATIONS = "MIDNSHP=X"
LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK_IN, BLOCK_OUT = 65_280, 1 << 16
#: Fixed part of a record: its size, reference, position, length of the name, quality, bin, operations, flags, length of the sequence, the mate's reference and position, span.
FIXED = struct.Struct("<iiiBBHHHiiii")
#: Records that must follow each other from a place for it to count as the start of one, and the largest record.
CHAIN, MOST = 4, 1 << 28
#: A folder's files are numbered; their records follow those of the file before.
FILE_BITS = 52
#: Names that Spark's file systems have in Arrow.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfs", "wasb": "abfs", "abfss": "abfs"}


def filesystem(path: str):
    """(file system, path in it) of a path or an address with a scheme."""
    from pyarrow import fs

    m = re.match(r"(\w+):/+(?=[^/])", path)
    if m is None:
        return fs.LocalFileSystem(), path
    if m.group(1) == "file":
        return fs.LocalFileSystem(), "/" + path[m.end() :]
    scheme, rest = path.split("://", 1)
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files of a folder in the order of their names; names that begin with a dot or an underscore are left out."""
    from pyarrow import fs

    at, inner = filesystem(path)
    info = at.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = sorted((f.base_name, f.size) for f in at.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File and f.base_name[0] not in "._")
    return [(f"{path.rstrip('/')}/{name}", size) for name, size in found]


# --- blocks


def block_size(buf: bytes, at: int) -> tuple[int, int] | None:
    """(bytes of the block that begins there, where its data begin in it), or None if none does."""
    if buf[at : at + 4] != MAGIC or len(buf) < at + 18:
        return None
    extra = int.from_bytes(buf[at + 10 : at + 12], "little")
    i, end = at + 12, at + 12 + extra
    while i + 4 <= min(end, len(buf)):
        size = int.from_bytes(buf[i + 2 : i + 4], "little")
        if buf[i : i + 2] == b"BC" and size == 2:
            return int.from_bytes(buf[i + 4 : i + 6], "little") + 1, 12 + extra
        i += 4 + size
    return None


def inflated(block: bytes, data: int) -> bytes:
    """The content of a block; ValueError where lengths or checksum do not fit."""
    crc, size = struct.unpack("<II", block[-8:])
    try:
        out = zlib.decompress(block[data:-8], -15, max(size, 1))
    except zlib.error as e:
        raise ValueError(str(e)) from None
    if len(out) != size or zlib.crc32(out) != crc:
        raise ValueError("checksum")
    return out


class Blocks:
    """The blocks of an open file from a place on, as (place, content)."""

    def __init__(self, file, path: str, size: int, at: int):
        self.file, self.path, self.size, self.at = file, path, size, at
        self.buf, self.from_ = b"", at

    def _have(self, at: int, n: int) -> bytes:
        """n bytes from a place, fewer at the end of the file."""
        if at < self.from_ or at + n > self.from_ + len(self.buf):
            self.file.seek(at)
            self.buf, self.from_ = self.file.read(max(n, 1 << 20)), at
        return self.buf[at - self.from_ : at - self.from_ + n]

    def _whole(self, at: int) -> tuple[int, bytes] | None:
        """(bytes, content) of the block at a place, or None."""
        head = self._have(at, BLOCK_OUT + 64)
        found = block_size(head, 0)
        if found is None or found[0] > len(head) or found[0] < found[1] + 8:
            return None
        try:
            return found[0], inflated(head[: found[0]], found[1])
        except ValueError:
            return None

    def seek_block(self, end: int) -> bool:
        """Moves on to the first block that begins before ``end`` and whose content checks. A broken one is met by the reader of the range before."""
        while self.at < min(end, self.size):
            head = self._have(self.at, BLOCK_OUT + 64)
            here = head.find(MAGIC)
            if here < 0:
                self.at += max(1, len(head) - 3)
                continue
            self.at += here
            if self.at >= end:
                return False
            if self._whole(self.at):
                return True
            self.at += 1
        return False

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        while self.at < self.size:
            block = self._whole(self.at)
            if block is None:
                raise ValueError(f"broken block at byte {self.at} of {self.path}")
            at, self.at = self.at, self.at + block[0]
            if block[1]:
                yield at, block[1]


# --- records


@dataclass
class Header:
    names: list[str]
    lengths: np.ndarray
    #: Where the first record begins: the block, and the place in its content.
    block: int
    offset: int


def header(file, path: str, size: int) -> Header:
    data, blocks, marks = b"", iter(Blocks(file, path, size, 0)), []

    def need(n: int) -> None:
        nonlocal data
        while len(data) < n:
            more = next(blocks, None)
            if more is None:
                raise ValueError(f"no header in {path}")
            marks.append((len(data), more[0]))
            data += more[1]

    need(8)
    if data[:4] != b"BAM\1":
        raise ValueError(f"no alignments in {path}")
    at = 8 + int.from_bytes(data[4:8], "little")
    need(at + 4)
    n, at = int.from_bytes(data[at : at + 4], "little"), at + 4
    names, lengths = [], []
    for _ in range(n):
        need(at + 4)
        k = int.from_bytes(data[at : at + 4], "little")
        need(at + 8 + k)
        names.append(data[at + 4 : at + 3 + k].decode())
        lengths.append(int.from_bytes(data[at + 4 + k : at + 8 + k], "little"))
        at += 8 + k
    place, block = next(m for m in reversed(marks) if m[0] <= at)
    return Header(names, np.array(lengths, np.int64), block, at - place)


def plausible(data: bytes, at: int, head: Header) -> int | None:
    """Where the record that may begin there would end; None if none can begin there."""
    size, ref, pos, name, _, _, ops, _, seq, mate, mate_pos, _ = FIXED.unpack_from(data, at)
    n = len(head.names)
    if not (34 <= size <= MOST and -1 <= ref < n and -1 <= mate < n and pos >= -1 and mate_pos >= -1 and name >= 1 and seq >= 0):
        return None
    if 32 + name + 4 * ops + (seq + 1) // 2 + seq > size or ref >= 0 and pos >= head.lengths[ref]:
        return None
    text = data[at + 36 : at + 36 + name]
    if len(text) == name and (text[-1] != 0 or any(not 33 <= c <= 126 for c in text[:-1])):
        return None
    codes = data[at + 36 + name : at + 36 + name + 4 * ops : 4]
    return None if any(c & 15 > 8 for c in codes) else at + 4 + size


def first_record(data: bytes, limit: int, head: Header, ended: bool) -> int | None:
    """The first place before ``limit`` from which records follow each other; -1 if more data are needed to tell, None if there is none."""
    n = len(data) - FIXED.size
    if n < 0:
        return None if ended else -1
    # all places at once, by the sizes and references alone
    word = lambda k: np.ndarray((min(limit, n + 1),), "<i4", data, k, (1,))
    size, ref, pos, seq, mate = word(0), word(4), word(8), word(20), word(24)
    refs = len(head.names)
    may = (size >= 34) & (size <= MOST) & (ref >= -1) & (ref < refs) & (pos >= -1) & (seq >= 0) & (seq < size) & (mate >= -1) & (mate < refs)
    for at in np.flatnonzero(may).tolist():
        here, links = at, 0
        while links < CHAIN:
            if here == len(data) and ended:
                return at
            if here + FIXED.size > len(data):
                if ended:
                    break
                return -1
            end = plausible(data, here, head)
            if end is None:
                break
            here, links = end, links + 1
        else:
            return at
    return None


def cigar_text(raw: bytes) -> str:
    return "".join(f"{v >> 4}{OPERATIONS[v & 15]}" for v in struct.unpack(f"<{len(raw) // 4}I", raw)) or "*"


#: Bytes of one value of a tag, by its type.
TAG_BYTES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}


def long_cigar(tags: bytes) -> bytes | None:
    """The operations of a record that has too many for their own field: the tag ``CG``."""
    at = 0
    while at + 3 <= len(tags):
        tag, kind = tags[at : at + 2], chr(tags[at + 2])
        at += 3
        if kind in "ZH":
            at = tags.index(0, at) + 1
        elif kind == "B":
            n = int.from_bytes(tags[at + 1 : at + 5], "little")
            if tag == b"CG":
                return tags[at + 5 : at + 5 + 4 * n]
            at += 5 + n * TAG_BYTES[chr(tags[at])]
        else:
            at += TAG_BYTES[kind]
    return None


def batch_of(data: bytes, starts: list[int], order: np.ndarray, head: Header, sample: str, known: dict[bytes, str]) -> pa.RecordBatch:
    """The records that begin at ``starts``, each whole within the data."""
    at = np.array(starts, np.int64)
    buf = np.frombuffer(data, np.uint8)

    def field(offset: int, kind: str) -> np.ndarray:
        width = np.dtype(kind).itemsize
        return buf[at[:, None] + offset + np.arange(width)].copy().view(kind).ravel()

    ref, pos, flag = field(4, "<i4"), field(8, "<i4"), field(18, "<u2")
    name, mapq, ops, seq = buf[at + 12].astype(np.int64), buf[at + 13], field(16, "<u2").astype(np.int64), field(20, "<i4")
    size = field(0, "<i4").astype(np.int64)
    if (ref >= len(head.names)).any() or (36 + name + 4 * ops > 4 + size).any():
        raise ValueError("broken record")
    cut = np.concatenate([[0], np.cumsum(name - 1)]).astype(np.int32)
    letters = buf[np.repeat(at + 36 - cut[:-1], name - 1) + np.arange(cut[-1])]
    names = pa.StringArray.from_buffers(len(at), pa.py_buffer(cut), pa.py_buffer(letters.tobytes()))
    cigars, first = [], at + 36 + name
    for a, z, n, end in zip(first.tolist(), (first + 4 * ops).tolist(), seq.tolist(), (at + 4 + size).tolist(), strict=True):
        raw = data[a:z]
        if z - a == 8 and raw[:4] == (n << 4 | 4).to_bytes(4, "little") and raw[4] & 15 == 3:
            raw = long_cigar(data[z + (n + 1) // 2 + n : end]) or raw
        text = known.get(raw)
        if text is None:
            text = cigar_text(raw)
            if len(known) < 100_000:
                known[raw] = text
        cigars.append(text)
    chroms = pa.DictionaryArray.from_arrays(pa.array(np.where(ref < 0, len(head.names), ref)), pa.array([*head.names, "*"])).cast(pa.string())
    values = [pa.array([sample]).take(pa.array(np.zeros(len(at), np.int64))), names, pa.array(flag.astype(np.int32)), chroms, pa.array(pos.astype(np.int64) + 1), pa.array(mapq.astype(np.int32)), pa.array(cigars, pa.string()), pa.array(order)]
    return pa.RecordBatch.from_arrays(values, names=COLUMNS)


def decoded(file, path: str, size: int, start: int, end: int, sample: str, number: int = 0) -> Iterator[pa.RecordBatch]:
    """The records that begin in blocks from ``start`` to before ``end``; ``ord`` has the block's place and the place in it."""
    head = header(file, path, size)
    blocks = Blocks(file, path, size, start)
    if start and not blocks.seek_block(end):
        return
    exact = not start or blocks.at <= head.block
    if exact:
        blocks.at = head.block
    source = iter(blocks)
    data, marks, ended = b"", [], False  # marks: (place in the data, place of the block)
    known: dict[bytes, str] = {}

    def more() -> bool:
        nonlocal data, ended
        block = next(source, None)
        if block is None:
            ended = True
            return False
        marks.append((len(data), block[0]))
        data += block[1]
        return True

    def limit() -> int:
        """Where blocks of the range end in the data."""
        return next((place for place, block in marks if block >= end), len(data))

    at: int | None = head.offset if exact else -1
    while at == -1:
        if not more() and not data:
            return
        at = first_record(data, limit(), head, ended)
        if at is None and not ended and marks[-1][1] < end:
            at = -1
    if at is None:
        return
    while True:
        while not ended and (not marks or marks[-1][1] < end) and len(data) < at + HELD:
            more()
        starts, here, stop = [], at, limit()
        while here < stop and here + 4 <= len(data):
            n = int.from_bytes(data[here : here + 4], "little")
            if not 32 <= n <= MOST:
                raise ValueError(f"broken record in {path}")
            if here + 4 + n > len(data):
                break
            starts.append(here)
            here += 4 + n
        if starts:
            places, offsets = (np.array(x, np.int64) for x in zip(*marks, strict=True))
            s = np.array(starts, np.int64)
            which = np.searchsorted(places, s, "right") - 1
            order = offsets[which] << 16 | s - places[which]
            if number and offsets[-1] >> (FILE_BITS - 16):
                raise ValueError(f"{path} is too large for a folder of files")
            yield batch_of(data, starts, order + (number << FILE_BITS), head, sample, known)
        if here >= stop and (ended or marks[-1][1] >= end):
            return
        if ended and not starts:
            raise ValueError(f"{path} ends within a record")
        keep = max((i for i, (place, _) in enumerate(marks) if place <= here), default=0)
        base = marks[keep][0]
        data, at = data[base:], here - base
        marks[:] = [(place - base, block) for place, block in marks[keep:]]
        if not starts:
            more()


# --- the source


@dataclass
class Range(InputPartition):
    path: str
    size: int
    start: int
    end: int
    sample: str
    number: int

    def __post_init__(self):
        super().__init__((self.path, self.start))


class BamReader(DataSourceReader):
    def __init__(self, paths: list[str], split: int):
        self.paths, self.split = paths, split

    def partitions(self):
        out = []
        for path in self.paths:
            sample = re.sub(r"\.[bs]am$", "", path.rstrip("/").split("/")[-1])
            for number, (file, size) in enumerate(files_of(path)):
                out += [Range(file, size, a, min(a + self.split, size), sample, number) for a in range(0, size, self.split)]
        return out

    def read(self, partition: Range):
        at, inner = filesystem(partition.path)
        with at.open_input_file(inner) as f:
            yield from decoded(f, partition.path, partition.size, partition.start, partition.end, partition.sample, partition.number)


class BamSource(DataSource):
    """Format ``bam``: options ``paths`` (a list as JSON, a sample each) and ``splitBytes``."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        o = self.options
        return BamReader(json.loads(o["paths"]) if "paths" in o else [o["path"]], int(o.get("splitBytes", SPLIT)))


def read_bam(spark: SparkSession, paths: list[str], split_bytes: int = SPLIT) -> DataFrame:
    """sample, qname, flag, chrom, pos, mapq, cigar, ord of binary files, in as many tasks as ranges of ``split_bytes``; no path gives no rows."""
    from tallyhelix.session import ship

    ship(spark)
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("paths", json.dumps(paths)).option("splitBytes", split_bytes).load()


# --- the writer

#: Alignments that a task of the writer sorts.
SORTED = 500_000


def _bin(start: int, end: int) -> int:
    """The smallest bin of the format's index that holds [start, end)."""
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == end >> shift:
            return first + (start >> shift)
    return 0


def record(qname: str, flag: int, ref: int, pos: int, mapq: int, cigar: str) -> bytes:
    """One alignment without its sequence; pos counts from 1."""
    ops = [int(n) << 4 | OPERATIONS.index(o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    span = sum(v >> 4 for v in ops if OPERATIONS[v & 15] in "MDN=X")
    tags = b""
    if len(ops) > 0xFFFF:
        tags, ops = b"CGBI" + struct.pack(f"<I{len(ops)}I", len(ops), *ops), [0 << 4 | 4, span << 4 | 3]
    name = qname.encode() + b"\0"
    body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(name), mapq, _bin(max(pos - 1, 0), max(pos - 1, 0) + max(span, 1)), len(ops), flag, 0, -1, -1, 0)
    body += name + struct.pack(f"<{len(ops)}I", *ops) + tags
    return struct.pack("<i", len(body)) + body


def packed(data: bytes) -> bytes:
    """One block."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return MAGIC + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def head_bytes(contigs: list[tuple[str, int]]) -> bytes:
    text = "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in contigs).encode()
    out = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs))
    for n, k in contigs:
        out += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k)
    return out


def write_bam(alignments: DataFrame, folder: str, contigs: list[tuple[str, int]], tasks: int | None = None) -> None:
    """``folder``/``sample``.bam, a folder of files a sample, in which the alignments of a name stand together in the order of ``ord``.

    A task writes a file for each of its samples: aside, then renamed, so that one that is run again leaves the same files. There are as many tasks as
    hold ``SORTED`` alignments each, dealt by ranges, so that neither what a task sorts grows with the table nor the files with tasks times samples.
    """
    from tallyhelix.session import ship

    ship(alignments.sparkSession)
    tasks = tasks or max(1, -(-alignments.count() // SORTED))
    ref = {n: i for i, (n, _) in enumerate(contigs)}

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        at, inner = filesystem(folder)
        out, held, now, rows = None, bytearray(), None, 0

        def close():
            if out is not None:
                for i in range(0, len(held), BLOCK_IN):
                    out.write(packed(bytes(held[i : i + BLOCK_IN])))
                out.write(LAST_BLOCK)
                out.close()
                at.move(f"{inner}/{now}.bam/_{task.partitionId()}-{task.taskAttemptId()}", f"{inner}/{now}.bam/part-{task.partitionId():05d}.bam")

        for b in batches:
            for r in b.to_pylist():
                if r["sample"] != now:
                    close()
                    now = r["sample"]
                    at.create_dir(f"{inner}/{now}.bam")
                    out, held = at.open_output_stream(f"{inner}/{now}.bam/_{task.partitionId()}-{task.taskAttemptId()}"), bytearray(head_bytes(contigs))
                held += record(r["qname"], r["flag"], ref.get(r["chrom"], -1), r["pos"], r["mapq"], r["cigar"])
                rows += 1
                while len(held) >= BLOCK_IN:
                    out.write(packed(bytes(held[:BLOCK_IN])))
                    del held[:BLOCK_IN]
        close()
        yield pa.RecordBatch.from_pydict({"rows": pa.array([rows], pa.int64())})

    a = alignments.select(*COLUMNS).repartitionByRange(tasks, "sample", "qname").sortWithinPartitions("sample", "qname", "ord")
    a.mapInArrow(run, "rows long").write.format("noop").mode("overwrite").save()
