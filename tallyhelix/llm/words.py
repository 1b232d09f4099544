"""Splitting text as the pre-tokenizers of the two public tokenizers do, with a cache per word.

Texts made of characters on which every regex engine agrees (a fixed set of Latin letters, digits
and punctuation) are split by the standard library; any other text goes through the tokenizer's
own normalizer and pre-tokenizer, so the split is always the library's.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import json
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Tab, line ends, printable ASCII, Latin-1 and Latin Extended-A letters and signs, common dashes and quotes.
_SPANS = ((9, 10), (13, 13), (32, 126), (0xA1, 0xAC), (0xAE, 0x12F), (0x131, 0x148), (0x14A, 0x17E), (0x2013, 0x2014), (0x2018, 0x201E), (0x2026, 0x2026), (0x20AC, 0x20AC))
_CHARS = [chr(c) for a, b in _SPANS for c in range(a, b + 1)]
SAFE = re.compile("[%s]*" % "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in _SPANS))
LETTERS = "".join(re.escape(c) for c in _CHARS if unicodedata.category(c)[0] == "L")
NUMBERS = "".join(re.escape(c) for c in _CHARS if unicodedata.category(c)[0] == "N")
#: At most so many words are remembered by a worker; beyond, it starts afresh.
CACHE = 100_000


def default_path(name: str) -> str:
    """Where a worker finds a public tokenizer file; a path is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte: itself if printable, else 256 and on in byte order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in out:
            out[b], n = chr(256 + n), n + 1
    return out


@functools.cache
def char_bytes() -> dict[str, int]:
    return {c: b for b, c in byte_chars().items()}


class Splitter:
    """Splits a text into pieces of (special id or None, words)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        alone = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(%s)" % "|".join(map(re.escape, alone))) if alone else None
        self.lower = self.spec["normalizer"] is not None
        if self.lower:
            pattern = rf"[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{NUMBERS}]|[^\t\n\r {LETTERS}{NUMBERS}]+"
        else:
            pattern = rf" ?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{NUMBERS}]+| ?[^\t\n\r {LETTERS}{NUMBERS}]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+"
        self.find = re.compile(pattern).findall

    def words(self, text: str) -> list[str]:
        if SAFE.fullmatch(text):
            return self.find(text.lower() if self.lower else text)
        t, back = self.tokenizer, char_bytes()
        if t.normalizer is not None:
            text = t.normalizer.normalize_str(text)
        return [bytes(back[c] for c in w).decode("utf-8", "surrogatepass") for w, _ in t.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[tuple[int | None, list[str]]]:
        """Special tokens are cut out first; the words between them follow in order."""
        if self.cut is None or not any(s in text for s in self.special):
            return [(None, self.words(text))]
        return [(self.special.get(x), []) if x in self.special else (None, self.words(x)) for x in self.cut.split(text) if x]


def chunks(texts: list, size: int = 1 << 21):
    """Runs of about ``size`` characters, as (start, end)."""
    start, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= size:
            yield start, i + 1
            start, n = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def slices(column: pa.Array, size: int):
    """(start, end, texts) of runs of about ``size`` bytes of a column of texts, so that no more than a run is in Python at a time."""
    if not len(column):
        return
    n = np.asarray(pa.compute.binary_length(column).fill_null(0)).cumsum()
    start = 0
    while start < len(column):
        before = n[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(n, before + size, "right")))
        yield start, end, column.slice(start, end - start).to_pylist()
        start = end


def tidy(keep: str = "") -> None:
    """At the start of a task: gives back what other operators left in this worker, which the engine uses again and again."""
    for name, loaded in (("bpe", "model"), ("tokenfile", "encoder")):
        there = sys.modules.get(f"tallyhelix.llm.{name}")
        if there is not None and name != keep:
            getattr(there, loaded).cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass
