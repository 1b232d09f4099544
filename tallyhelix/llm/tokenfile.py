"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Documents are range-partitioned by doc_id, tokenized, and written in ascending doc_id order to
binary files in the shared folder. Each file ranks the ids by how often they occur in it (its
header holds the table), so the commonest 256 ids take one byte. Lengths stand apart as 2-bit
codes, four to a control byte, and a table lookup turns control bytes into lengths and so into the
offsets of all values at once. Files have fixed names and are put in place by a rename, so a task
that runs again writes the same file.

File: magic; little-endian int64 counts (documents, tokens, table size, control bytes, data bytes);
doc ids int64; null marks of doc ids uint8; tokens per document int64; ids by rank uint32; control; data.

Defined cases: a null or empty text is the end id alone; null ids come first; rows with equal ids
lie in the order of their text's hash; any Unicode text is encoded whole; special names in a text
become their ids, as the library does by default; an empty table writes no file.
"""

from __future__ import annotations

import functools
import gc
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhelix.sources.bam import filesystem

from .common import Scratch, read
from .words import Splitter, byte_chars, chunks, default_path

TOKENIZER = "byte_bpe_50k.json"
MAGIC = b"THTOK001"
END = 0
#: A file is closed at the first document that takes it past so many tokens.
FILE_TOKENS = 1 << 22
#: Words remembered lately and before that, at most so many each: some 60 MB a worker.
CACHE = 250_000
#: Words encoded in one call: they come one by one.
BATCH = 1
#: Lengths of the four values of a control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


class Words:
    """Words that are split off already: their bytes are mapped here, and the library's model does the merges.

    A call of the whole tokenizer would build a text, places and masks of every token as well, which takes longer than the merges.
    """

    def __init__(self, tokenizer):
        self.merged = tokenizer.model.tokenize
        self.shown = byte_chars()
        self.ascii = {b: self.shown[b] for b in range(128)}

    def encode_batch_fast(self, words: list[str]) -> list[bytes]:
        out = []
        for w in words:
            chars = w.translate(self.ascii) if w.isascii() else "".join([self.shown[b] for b in w.encode()])
            out.append(array("I", [t.id for t in self.merged(chars)]).tobytes())
        return out


class Known(dict):
    """The ids of words, found when a word is first asked for; when full, what was known is kept until it is full again, so words that come back are not encoded anew."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        e = self.encoder
        if len(self) >= CACHE:
            e.before = dict(self)
            self.clear()
        ids = e.before.get(word)
        if ids is None:
            [ids] = e.of_words.encode_batch_fast([word])
        self[word] = ids
        return ids


class Encoder:
    """The tokenizers library with a cache of words, as its merges never cross words."""

    def __init__(self, path: str):
        self.splitter = Splitter(path)
        self.of_words = Words(self.splitter.tokenizer)
        self.known = Known(self)
        self.before: dict[str, bytes] = {}

    def encode(self, texts: list) -> list[bytes]:
        get, out = self.known.__getitem__, []
        collects = gc.isenabled()
        gc.disable()  # millions of words are made here, and nothing that refers to itself
        try:
            for t in texts:
                out.append(b"".join([b"".join(map(get, w)) if s is None else s.to_bytes(4, "little") for s, w in self.splitter.pieces(t or "")]))
        finally:
            if collects:
                gc.enable()
        return out


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(default_path(path))


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    v = values.astype(np.uint32, copy=False)
    n = np.ones(len(v), np.uint8)
    for top in (0xFF, 0xFFFF, 0xFFFFFF):
        if len(v) and v.max() > top:
            n += v > top
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = n - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    at = np.cumsum(n, dtype=np.int64)
    data = np.zeros(int(at[-1]) if len(v) else 0, np.uint8)
    at -= n
    data[at] = v & 0xFF
    for k in range(1, int(n.max()) if len(v) else 1):
        more = np.flatnonzero(n > k)
        data[at[more] + k] = v[more] >> np.uint32(8 * k) & np.uint32(0xFF)
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    lens = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(lens) - lens
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lens > k)
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def file_bytes(doc_ids: list, ids: list[bytes]) -> bytes:
    per = np.array([len(x) // 4 for x in ids], "<i8")
    flat = np.frombuffer(b"".join(ids), "<u4")
    count = np.bincount(flat) if len(flat) else np.zeros(0, int)
    table = np.argsort(-count, kind="stable")[: int((count > 0).sum())].astype("<u4")
    rank = np.zeros(len(count), np.uint32)
    rank[table] = np.arange(len(table))
    control, data = pack(rank[flat])
    head = np.array([len(ids), len(flat), len(table), len(control), len(data)], "<i8").tobytes()
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    nulls = np.array([d is None for d in doc_ids], np.uint8).tobytes()
    return b"".join([MAGIC, head, keys, nulls, per.tobytes(), table.tobytes(), control, data])


def read_file(raw: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc ids, tokens per document, all ids) of a file."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, tokens, table_n, control_n, data_n = np.frombuffer(raw, "<i8", 5, 8).tolist()
    at = 48
    keys = np.frombuffer(raw, "<i8", docs, at)
    nulls = np.frombuffer(raw, np.uint8, docs, at + 8 * docs)
    at += 9 * docs
    per = np.frombuffer(raw[at : at + 8 * docs], "<i8")
    at += 8 * docs
    table = np.frombuffer(raw[at : at + 4 * table_n], "<u4")
    at += 4 * table_n
    rank = unpack(raw[at : at + control_n], raw[at + control_n : at + control_n + data_n], tokens)
    return [None if z else k for k, z in zip(keys.tolist(), nulls.tolist(), strict=True)], per, table[rank]


def write_tokens(docs: DataFrame, folder: str, path: str = TOKENIZER, end: int = END) -> DataFrame:
    """Lazily writes the files when acted on; a row (file, documents, tokens) for each."""

    def run(batches):
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        enc, part, made = encoder(path), TaskContext.get().partitionId(), 0
        stop = end.to_bytes(4, "little")
        keys, ids, n = [], [], 0

        def put():
            nonlocal keys, ids, n, made
            name, tmp = f"part-{part:06d}-{made:06d}.tok", f"{root}/.{uuid.uuid4().hex}"
            with store.open_output_stream(tmp) as f:
                f.write(file_bytes(keys, ids))
            store.move(tmp, f"{root}/{name}")
            out = pa.RecordBatch.from_pydict({"file": [name], "documents": pa.array([len(ids)], pa.int64()), "tokens": pa.array([n], pa.int64())})
            keys, ids, n, made = [], [], 0, made + 1
            return out

        for b in batches:
            texts, doc = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
            for a, z in chunks(texts):
                for d, x in zip(doc[a:z], enc.encode(texts[a:z]), strict=True):
                    keys.append(d)
                    ids.append(x + stop)
                    n += len(x) // 4 + 1
                    if n >= FILE_TOKENS:
                        yield put()
        if keys:
            yield put()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select("doc_id", "text").withColumn("h", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    return d.select("doc_id", "text").mapInArrow(run, "file string, documents long, tokens long")


def read_tokens(files: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and token_ids) of every document in the files."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    at = files.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", token_ids binary" * with_ids

    def run(batches):
        store, root = filesystem(folder)
        for b in batches:
            for name, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                with store.open_input_stream(f"{root}/{name}") as f:
                    keys, per, ids = read_file(f.read())
                ends = np.cumsum(per)
                raw, begin = ids.astype("<u4").tobytes(), (ends - per).tolist()
                parts = [raw[4 * s : 4 * e] for s, e in zip(begin, ends.tolist(), strict=True)]
                cols = [pa.array(keys, pa.int64()), pa.array([start + s for s in begin], pa.int64()), pa.array(per, pa.int64()), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(parts, pa.binary())] * with_ids, names=[x.split()[0] for x in schema.split(", ")])

    n = max(1, files.count())
    return at.repartition(min(n, 4096), "file").mapInArrow(run, schema)


def op6_tokens(spark, sf_dir):
    s = Scratch(spark, "op6")
    folder = s.path("files")
    files = s.table(write_tokens(read(spark, sf_dir, "documents"), folder), "written")
    return s.table(read_tokens(files, folder), "documents")
