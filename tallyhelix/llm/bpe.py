"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word exactly one token can come last in the encoding of that prefix. An
automaton over the vocabulary (trie with suffix links) gives the tokens that end at a position,
longest first; a token is the last one if it is compatible with the last token of the prefix
before it, that is, if no merge would cross their border. Back-pointers then give the ids.
Two neighbours u, v are incompatible if some merge (a, b) joins a token a on the right edge of u
to a token b on the left edge of v before a and b are taken up by merges inside u and v.
Words of up to ``SHORT`` bytes are advanced together in numpy, one position at a time.

Defined cases: a null or empty text has no ids and decodes to the empty text; texts of any length
and characters are encoded whole; names of special tokens within a text become their ids, as
the library does by default; a byte that no token covers is an error; extra columns are kept by ``encode`` and not read by the query.
"""

from __future__ import annotations

import functools
import hashlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import read
from .words import CACHE, Splitter, byte_chars, chunks, default_path, slices, tidy

TOKENIZER = "word_bpe_49k.json"
SHORT = 48
NEVER = 1 << 30


class Model:
    def __init__(self, path: str):
        self.splitter = Splitter(path)
        model = self.splitter.spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.marked = bool(suffix)
        n = max([*vocab.values(), *self.splitter.special.values()]) + 1
        self.names = [""] * n
        for k, v in [*vocab.items(), *self.splitter.special.items()]:
            self.names[v] = k
        seq: dict[int, tuple] = {}
        for b, c in byte_chars().items():  # a last byte of a word counts as another symbol
            for name, sym in ((c, b), (c + suffix, b + 256))[: 1 + self.marked]:
                if name in vocab:
                    seq[vocab[name]] = (sym,)
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.merge: dict[int, int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            t, x, y = vocab[a + b], vocab[a], vocab[b]
            self.merge[x << 20 | y] = r
            if t not in seq:
                seq[t], self.rank[t], self.left[t], self.right[t] = seq[x] + seq[y], r, x, y
        self.length = np.zeros(n + 1, np.int64)
        for t, s in seq.items():
            self.length[t] = len(s)
        self._automaton(seq)
        self.splitter.spec = None  # read
        self.keys = np.array(sorted(self.merge), np.int64)
        self.ranks = np.array([self.merge[k] for k in self.keys.tolist()], np.int64)
        self.word_ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _automaton(self, seq: dict) -> None:
        edges, out = {}, [-1]
        for t, s in seq.items():
            at = 0
            for c in s:
                nxt = edges.get(at << 9 | c)
                if nxt is None:
                    nxt = edges[at << 9 | c] = len(out)
                    out.append(-1)
                at = nxt
            out[at] = t
        below: dict[int, list] = {}
        for k, v in edges.items():
            below.setdefault(k >> 9, []).append((k & 511, v))
        fail, shorter = [0] * len(out), [0] * len(out)
        queue = deque([0])
        while queue:
            at = queue.popleft()
            for c, v in below.get(at, ()):
                f = fail[at]
                while at and f and (f << 9 | c) not in edges:
                    f = fail[f]
                fail[v] = edges.get(f << 9 | c, 0) if at else 0
                shorter[v] = fail[v] if out[fail[v]] >= 0 else shorter[fail[v]]
                queue.append(v)
        self.edges = edges
        self.edge_keys = np.array(sorted(edges), np.int64)
        self.edge_to = np.array([edges[k] for k in self.edge_keys.tolist()], np.int64)
        self.out, self.fail, self.shorter = np.array(out), np.array(fail), np.array(shorter)
        self.lists = self.out.tolist(), self.fail.tolist(), self.shorter.tolist(), self.length.tolist(), self.rank.tolist(), self.left.tolist(), self.right.tolist()

    def symbols(self, word: str) -> list[int]:
        s = list(word.encode("utf-8", "surrogatepass"))
        if s and self.marked:
            s[-1] += 256
        return s

    # --- one word, in plain Python: long words
    def _fits(self, u: int, v: int) -> bool:
        rank, left, right = self.lists[4:]
        pu = pv = NEVER
        while True:
            m = self.merge.get(u << 20 | v)
            if m is not None and m < pu and m <= pv:
                return False
            if rank[u] < 0 and rank[v] < 0:
                return True
            if rank[u] >= rank[v]:
                pu, u = rank[u], right[u]
            else:
                pv, v = rank[v], left[v]

    def encode_long(self, syms: list[int]) -> list[int]:
        out, fail, shorter, length = self.lists[:4]
        edges, last, at = self.edges, [-1], 0
        known: dict[int, bool] = {}
        for j, c in enumerate(syms, 1):
            while at and (at << 9 | c) not in edges:
                at = fail[at]
            at = edges.get(at << 9 | c, 0)
            s, got = at if out[at] >= 0 else shorter[at], -1
            while s:
                t = out[s]
                p = last[j - length[t]]
                if j == length[t]:
                    got = t
                elif p >= 0:
                    k = p << 20 | t
                    if k not in known:
                        known[k] = self._fits(p, t)
                    if known[k]:
                        got = t
                if got >= 0:
                    break
                s = shorter[s]
            last.append(got)
        ids, j = [], len(syms)
        while j:
            if last[j] < 0:
                raise ValueError("a byte that no token covers")
            ids.append(last[j])
            j -= length[last[j]]
        return ids[::-1]

    # --- many words at once
    def _lookup(self, keys, values, want):
        i = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where(keys[i] == want, values[i], -1)

    def _fit(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        pair, back = np.unique(u << 20 | v, return_inverse=True)
        u, v = pair >> 20, pair & 0xFFFFF
        ok = np.ones(len(u), bool)
        at = np.arange(len(u))
        pu = np.full(len(u), NEVER)
        pv = pu.copy()
        while len(at):
            m = self._lookup(self.keys, self.ranks, u << 20 | v)
            bad = (m >= 0) & (m < pu) & (m <= pv)
            ok[at[bad]] = False
            ru, rv = self.rank[u], self.rank[v]
            go = ~bad & ((ru >= 0) | (rv >= 0))
            at, u, v, pu, pv, ru, rv = (x[go] for x in (at, u, v, pu, pv, ru, rv))
            first = ru >= rv
            pu, pv = np.where(first, ru, pu), np.where(first, pv, rv)
            u, v = np.where(first, self.right[u], u), np.where(first, v, self.left[v])
        return ok[back]

    def encode_short(self, words: list[list[int]]) -> list[list[int]]:
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        lens = np.array([len(words[i]) for i in order])
        wide = int(lens[0]) if len(lens) else 0
        syms = np.zeros((wide, len(order)), np.int64)
        for k, i in enumerate(order):
            syms[: lens[k], k] = words[i]
        last = np.full((wide + 1, len(order)), -1, np.int64)
        state = np.zeros(len(order), np.int64)
        for j in range(1, wide + 1):
            n = int(np.searchsorted(-lens, -j, "right"))  # words that reach this position
            c, state = syms[j - 1, :n], state[:n]
            todo, nxt = np.arange(n), np.zeros(n, np.int64)
            at = state
            while len(todo):
                got = self._lookup(self.edge_keys, self.edge_to, at << 9 | c[todo])
                hit = got >= 0
                nxt[todo[hit]] = got[hit]
                go = ~hit & (at > 0)
                todo, at = todo[go], self.fail[at[go]]
            state = nxt
            s = np.where(self.out[state] >= 0, state, self.shorter[state])
            todo = np.arange(n)
            while len(todo):
                t = self.out[s[todo]]
                before = j - self.length[t]
                p = last[before, todo]
                ok = (before == 0) & (t >= 0)
                test = np.flatnonzero((before > 0) & (p >= 0) & (t >= 0))
                if len(test):
                    ok[test] = self._fit(p[test], t[test])
                last[j, todo[ok]] = t[ok]
                rest = todo[~ok]
                s[rest] = self.shorter[s[rest]]
                todo = rest[s[rest] > 0]
        out: list = [None] * len(words)
        for k, i in enumerate(order):
            ids, j, col = [], int(lens[k]), last[:, k]
            while j:
                t = int(col[j])
                if t < 0:
                    raise ValueError("a byte that no token covers")
                ids.append(t)
                j -= int(self.length[t])
            out[i] = ids[::-1]
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        syms = [self.symbols(w) for w in words]
        short = [i for i, s in enumerate(syms) if len(s) <= SHORT]
        out = [None if len(s) <= SHORT else self.encode_long(s) for s in syms]
        for a in range(0, len(short), 20_000):
            part = short[a : a + 20_000]
            for i, ids in zip(part, self.encode_short([syms[i] for i in part]), strict=True):
                out[i] = ids
        return out

    # --- texts
    def learn(self, words: set[str]) -> None:
        """Remembers the ids, as little-endian 32 bits, of words not met yet.

        When the table is full a new one begins, which takes words that are met again over from the last one.
        """
        if len(self.word_ids) > CACHE:
            self.older, self.word_ids = self.word_ids, {}
        new = []
        for w in words:
            if w not in self.word_ids:
                ids = self.older.get(w)
                if ids is None:
                    new.append(w)
                else:
                    self.word_ids[w] = ids
        for w, ids in zip(new, self.encode_words(new), strict=True):
            self.word_ids[w] = np.array(ids, "<u4").tobytes()

    def encode_texts(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian 32 bits, the text that they decode to in UTF-8) of each text."""
        out = []
        for a, b in chunks(texts):
            pieces = [self.splitter.pieces(t or "") for t in texts[a:b]]
            self.learn(set().union(*[w for p in pieces for _, w in p]))
            known = self.word_ids
            for p in pieces:
                ids = b"".join([known[w] if special is None else special.to_bytes(4, "little") for special, words in p for w in (words if special is None else ("",))])
                out.append((ids, self.decode(ids).encode("utf-8", "surrogatepass")))
        return out

    def decode(self, ids: bytes) -> str:
        """The tokens' names joined by a space: the library's rule for a tokenizer without decoder."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(2)
def model(path: str) -> Model:
    return Model(default_path(path))


#: Bytes of text that a worker takes at a time; a longer text is taken alone.
AT_ONCE = 1 << 22


def encode(df: DataFrame, path: str = TOKENIZER, text: str = "text", names: tuple[str, ...] = ("n_tokens", "token_ids", "decoded")) -> DataFrame:
    """The rows with three columns called ``names``, which the others must lack: number of ids, ids (binary, little-endian 32 bits each), decoded text; ``text`` is dropped."""
    keep = [f for f in df.schema.fields if f.name != text]

    def run(batches):
        tidy("bpe")
        m = model(path)
        for b in batches:
            for a, z, texts in slices(b.column(text), AT_ONCE):
                got = m.encode_texts(texts)
                part = b.slice(a, z - a)
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in keep], pa.array([len(x) // 4 for x, _ in got], pa.int64()), pa.array([x for x, _ in got], pa.large_binary()).cast(pa.binary()), pa.array([y.decode("utf-8", "surrogatepass") for _, y in got], pa.string())], names=[*[f.name for f in keep], *names])

    schema = type(df.schema)([*keep]).add(names[0], "long").add(names[1], "binary").add(names[2], "string")
    return df.select(*[f.name for f in keep], text).mapInArrow(run, schema)


def digests(df: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches):
        tidy("bpe")
        m, sha = model(path), lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            ids, got = b.column("doc_id"), []
            for _, _, texts in slices(b.column("text"), AT_ONCE):
                got += [(len(x) // 4, sha(x), sha(y)) for x, y in m.encode_texts(texts)]
            yield pa.RecordBatch.from_arrays([ids, pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.string()), pa.array([x[2] for x in got], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark, sf_dir):
    return digests(read(spark, sf_dir, "documents"))
