"""Baseline JPEG: writing payloads as coefficients, and reading any baseline scan in numpy.

A payload of n x 64 bytes becomes a grayscale baseline JPEG of n blocks: each byte is one
quantised coefficient (values -128..-1 and 1..128, so none is zero), in zigzag order, with a
restart marker after each block. Entropy coding keeps coefficients exactly, so reading them back gives the
payload. The reader parses markers, cuts the scan at restart markers, and decodes all intervals of
many images side by side: one Huffman symbol of every interval per step. It takes any baseline
file (several components, sampling factors, scans with or without interleaving, any tables).
From the DC terms of the first component it builds the luminance thumbnail at an eighth of the
size, and hashes it.

Defined cases: a null text is empty; the empty text is a payload of 64 zero bytes; a null or
unreadable medium gives null features and the reason in ``error``; texts of any length are stored
whole; equal texts give equal media; extra columns are kept by ``to_jpeg`` and not read by the query.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import read
from .words import chunks

#: Blocks side by side in a written image, at most.
WIDE = 1024
#: Blocks or intervals handled at once.
LANES = 1 << 15
#: Code lengths of (run 0, size) and of the end of block in written files; all other symbols take 16 bits.
AC_LENGTHS = {0x05: 2, 0x07: 2, 0x04: 3, 0x06: 3, 0x03: 4, 0x08: 4, 0x02: 6, 0x01: 6, 0x00: 6}
DC_LENGTHS = {s: 4 for s in range(12)}


def table_of(lengths: dict[int, int]) -> tuple[bytes, bytes]:
    """(counts of codes by length, symbols) as a DHT segment holds them."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes([sum(lengths[s] == n for s in order) for n in range(1, 17)]), bytes(order)


def codes_of(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), codes given out in order."""
    out, code, at = {}, 0, 0
    for n, c in enumerate(counts, 1):
        for s in symbols[at : at + c]:
            out[s] = (code, n)
            code += 1
        at += c
        code <<= 1
    return out


@functools.cache
def lookup_of(counts: bytes, symbols: bytes) -> np.ndarray:
    """For every 16 bits ahead: symbol * 32 + length of the code; 0 where none fits."""
    out = np.zeros(1 << 16, np.int32)
    for s, (code, n) in codes_of(counts, symbols).items():
        out[code << (16 - n) : (code + 1) << (16 - n)] = s << 5 | n
    return out


@functools.cache
def _written_tables():
    ac = table_of({**{r << 4 | s: 16 for r in range(16) for s in range(1, 11)}, 0xF0: 16, **AC_LENGTHS})
    dc = table_of(DC_LENGTHS)
    value = np.arange(256) - 128 + (np.arange(256) >= 128)
    size = np.array([abs(v).bit_length() for v in value.tolist()])
    bits = np.where(value < 0, value + (1 << size) - 1, value)

    def coded(t):
        codes = codes_of(*t)
        return np.array([codes[s][0] for s in size.tolist()]) << size | bits, np.array([codes[s][1] for s in size.tolist()]) + size

    return dc, ac, coded(dc), coded(ac)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(blocks: int, n_bytes: int) -> bytes:
    dc, ac, *_ = _written_tables()
    wide = min(blocks, WIDE)
    high = -(-blocks // wide)
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"),
            _segment(0xFE, b"payload blocks=%d bytes=%d" % (blocks, n_bytes)),
            _segment(0xDB, b"\0" + bytes([8] + [1] * 63)),
            _segment(0xC0, struct.pack(">BHHBBBB", 8, high * 8, wide * 8, 1, 1, 0x11, 0)),
            _segment(0xC4, b"\0" + dc[0] + dc[1]),
            _segment(0xC4, b"\x10" + ac[0] + ac[1]),
            _segment(0xDD, struct.pack(">H", 1)),
            _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
        ]
    )


def _scan(blocks: np.ndarray, number: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy-coded blocks, each with the restart marker that follows it; and where each ends."""
    _, _, (dc, dc_n), (ac, ac_n) = _written_tables()
    code, n = ac[blocks], ac_n[blocks]
    code[:, 0], n[:, 0] = dc[blocks[:, 0]], dc_n[blocks[:, 0]]
    ends = np.cumsum(n, 1)
    size = (ends[:, -1] + 7) >> 3
    start = np.cumsum(size) - size
    at = (start[:, None] * 8 + ends - n).ravel()
    value = code.ravel() << (24 - n.ravel() - (at & 7))
    first, total = at >> 3, int(size.sum())
    raw = np.zeros(total + 2)
    for k in range(3):
        raw[k:] += np.bincount(first, (value >> (16 - 8 * k)) & 255, total + 2)[: total + 2 - k]
    raw = raw[:total].astype(np.int64)
    raw[start + size - 1] += (1 << (size * 8 - ends[:, -1])) - 1
    stuffed = raw == 255
    block = np.repeat(np.arange(len(size)), size)
    place = np.arange(total) + np.cumsum(stuffed) - stuffed + 2 * block
    over = np.bincount(block, stuffed, len(size)).astype(np.int64)
    stop = np.cumsum(size + over + 2)
    out = np.zeros(int(stop[-1]), np.uint8)
    out[place] = raw
    out[stop - 2] = 0xFF
    out[stop - 1] = 0xD0 + (number & 7)
    return out.tobytes(), stop


def encode(payloads: list[bytes]) -> list[bytes]:
    """JPEG files that hold the texts' bytes, padded with zeros to a positive multiple of 64."""
    n = [max(1, -(-len(p) // 64)) for p in payloads]
    flat = np.frombuffer(b"".join(p.ljust(64 * k, b"\0") for p, k in zip(payloads, n, strict=True)), np.uint8).reshape(-1, 64)
    first = np.cumsum([0, *n])
    number = np.arange(len(flat)) - np.repeat(first[:-1], n)
    data, stops, base = [], [], 0
    for a in range(0, len(flat), LANES):
        raw, stop = _scan(flat[a : a + LANES], number[a : a + LANES])
        data.append(raw)
        stops.append(stop + base)
        base += len(raw)
    data, stops = b"".join(data), np.concatenate([[0], *stops])
    out = []
    for i, p in enumerate(payloads):
        body = data[stops[first[i]] : stops[first[i + 1]]]
        spare = -n[i] % min(n[i], WIDE)  # blocks that only fill the last row: zero difference, end of block
        dc, ac, *_ = _written_tables()
        (z, zn), (e, en) = codes_of(*dc)[0], codes_of(*ac)[0]
        empty = ((z << en | e) << 16 - zn - en | (1 << 16 - zn - en) - 1).to_bytes(2, "big")
        fill = b"".join(empty + bytes([0xFF, 0xD0 + (n[i] + k & 7)]) for k in range(spare))
        out.append(_header(n[i], len(p)) + (body + fill)[:-2] + b"\xff\xd9")
    return out


class Image:
    """Markers of one file: sizes, components, scans cut into intervals, comment."""

    def __init__(self, raw: bytes):
        if raw[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        self.comment, self.parts, self.scans = b"", [], []
        quant, tables, restart, at = {}, {}, 0, 2
        while at < len(raw) - 1:
            if raw[at] != 0xFF:
                raise ValueError("marker expected")
            m = raw[at + 1]
            if m == 0xFF:
                at += 1
                continue
            if m == 0xD9:
                break
            size = struct.unpack_from(">H", raw, at + 2)[0]
            body, at = raw[at + 4 : at + 2 + size], at + 2 + size
            if m == 0xDB:
                while body:
                    wide = 1 + (body[0] >> 4)
                    quant[body[0] & 15] = struct.unpack_from(">H" if wide > 1 else "B", body, 1)[0]
                    body = body[1 + 64 * wide :]
            elif m == 0xC4:
                while body:
                    n = sum(body[1:17])
                    tables[body[0]] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif m in (0xC0, 0xC1):
                depth, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                if depth != 8 or not self.height or not self.width:
                    raise ValueError("8 bits and a size are expected")
                for i, hv, q in (body[6 + 3 * k : 9 + 3 * k] for k in range(n)):
                    self.parts.append({"id": i, "h": hv >> 4, "v": hv & 15, "q": q})
                top_h, top_v = max(p["h"] for p in self.parts), max(p["v"] for p in self.parts)
                self.mcus = -(-self.width // (8 * top_h)), -(-self.height // (8 * top_v))
                at_block = 0
                for p in self.parts:
                    p["cols"], p["rows"] = self.mcus[0] * p["h"], self.mcus[1] * p["v"]
                    p["own"] = -(-self.width * p["h"] // (8 * top_h)), -(-self.height * p["v"] // (8 * top_v))
                    p["first"], at_block = at_block, at_block + p["cols"] * p["rows"]
                self.blocks = at_block
            elif 0xC2 <= m <= 0xCF and m not in (0xC8, 0xCC):
                raise ValueError("not baseline")
            elif m == 0xDD:
                restart = struct.unpack(">H", body[:2])[0]
            elif m == 0xFE:
                self.comment = body
            elif m == 0xDA:
                use = []
                for k in range(body[0]):
                    p = next(p for p in self.parts if p["id"] == body[1 + 2 * k])
                    t = body[2 + 2 * k]
                    use.append((p, tables[t >> 4], tables[16 | t & 15]))
                at = self._scan(raw, at, use, restart)
        if not self.scans:
            raise ValueError("no scan")
        self.quant = quant.get(self.parts[0]["q"], 1)

    def _scan(self, raw: bytes, at: int, use: list, restart: int) -> int:
        data = np.frombuffer(raw, np.uint8, offset=at)
        mark = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] != 0))
        kind = data[mark + 1]
        last = np.flatnonzero((kind & 0xF8) != 0xD0)
        end = int(mark[last[0]]) if len(last) else len(data)
        cuts = mark[mark < end]
        if len(use) == 1:  # not interleaved: the blocks that hold pixels, row by row
            p = use[0][0]
            cols, rows = p["own"]
            order = (p["first"] + np.arange(rows)[:, None] * p["cols"] + np.arange(cols)).reshape(-1, 1)
        else:
            x, y = np.meshgrid(np.arange(self.mcus[0]), np.arange(self.mcus[1]))
            x, y = x.ravel(), y.ravel()
            order = np.stack([p["first"] + (y * p["v"] + j) * p["cols"] + x * p["h"] + i for p, *_ in use for j in range(p["v"]) for i in range(p["h"])], 1)
        which = [k for k, (p, *_) in enumerate(use) for _ in range(p["h"] * p["v"] if len(use) > 1 else 1)]
        per = restart or len(order)
        starts = np.concatenate([[0], cuts + 2])
        stops = np.concatenate([cuts, [end]])
        n = -(-len(order) // per)
        if len(starts) < n:
            raise ValueError("restart markers are missing")
        body = data[:end]
        keep = np.ones(end, bool)
        keep[1:] = ~((body[1:] == 0) & (body[:-1] == 0xFF))
        keep[cuts] = False
        keep[cuts + 1] = False
        new = np.concatenate([[0], np.cumsum(keep)])
        self.scans.append((body[keep], new[starts[:n]], new[stops[:n]], order, per, which, use))
        return at + end


def coefficients(images: list[Image]) -> list[np.ndarray]:
    """Quantised coefficients of every image: a row of 64 per block, in zigzag order."""
    first = np.cumsum([0, *[im.blocks for im in images]])
    out = np.zeros((int(first[-1]), 64), np.int16)
    tables: dict = {}
    data, lane_at, order_of, kinds, base, o_base, k_base = [], [], [], [], 0, 0, 0
    for i, im in enumerate(images):
        for raw, starts, stops, order, per, which, use in im.scans:
            width = order.shape[1]
            n = np.minimum(per, len(order) - np.arange(len(starts)) * per) * width
            lane_at.append(np.stack([starts + base, stops + base, n, o_base + np.arange(len(starts)) * per * width, np.full(len(starts), k_base), np.full(len(starts), width)], 1))
            order_of.append(order.ravel() + first[i])
            kinds += [(tables.setdefault(use[k][1], len(tables)), tables.setdefault(use[k][2], len(tables)), k) for k in which]
            data.append(raw)
            base, o_base, k_base = base + len(raw), o_base + order.size, k_base + width
    flat = np.concatenate([*data, np.full(8, 255, np.uint8)]).astype(np.int64)
    ahead = flat[:-3] << 24 | flat[1:-2] << 16 | flat[2:-1] << 8 | flat[3:]
    lanes, order, kind = np.concatenate(lane_at), np.concatenate(order_of), np.array(kinds, np.int64)
    look = np.concatenate([lookup_of(*t) for t in tables])
    for a in range(0, len(lanes), LANES):
        _decode(lanes[a : a + LANES], ahead, order, kind, look, out)
    return [out[first[i] : first[i + 1]] for i in range(len(images))]


def _decode(lanes, ahead, order, kind, look, out) -> None:
    """Advances all intervals by a symbol at a time until each has its blocks."""
    pos, limit, left, at, k0, width = (lanes[:, i].copy() for i in range(6))
    pos, limit = pos * 8, limit * 8
    turn, k = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
    guess = np.zeros((len(pos), 4), np.int64)
    alive = np.arange(len(pos))
    top = len(ahead) - 1
    while len(alive):
        kd = kind[k0 + turn]
        dc = k == 0
        peek = (ahead[np.minimum(pos >> 3, top)] >> (16 - (pos & 7))) & 0xFFFF
        e = look[np.where(dc, kd[:, 0], kd[:, 1]) << 16 | peek]
        pos += e & 31
        sym = e >> 5
        size, run = sym & 15, np.where(dc, 0, sym >> 4)
        bits = (ahead[np.minimum(pos >> 3, top)] >> (32 - (pos & 7) - size)) & ((1 << size) - 1)
        pos += size
        if (pos > limit).any() or (e == 0).any():
            raise ValueError("the scan is broken")
        value = np.where(bits < (1 << size >> 1), bits - (1 << size) + 1, bits)
        block = order[at]
        if dc.any():
            d = np.flatnonzero(dc)
            guess[alive[d], kd[d, 2]] += value[d]
            out[block[d], 0] = guess[alive[d], kd[d, 2]]
        ac = np.flatnonzero(~dc & (size > 0))
        if len(ac):
            to = k[ac] + run[ac]
            if (to > 63).any():
                raise ValueError("the scan is broken")
            out[block[ac], to] = value[ac]
        k = np.where(dc | (size > 0), k + run + 1, np.where(run == 15, k + 16, 64))
        over = k >= 64
        if over.any():
            k[over] = 0
            turn[over] += 1
            turn[turn == width] = 0
            at[over] += 1
            left[over] -= 1
            if (left == 0).any():
                go = left > 0
                pos, limit, left, at, k0, width, turn, k, alive = (x[go] for x in (pos, limit, left, at, k0, width, turn, k, alive))


def thumbnail(im: Image, coef: np.ndarray) -> np.ndarray:
    """Luminance at an eighth of the size, from DC terms alone."""
    p = im.parts[0]
    dc = coef[p["first"] : p["first"] + p["cols"] * p["rows"], 0].reshape(p["rows"], p["cols"])
    return np.clip(dc.astype(np.int64) * im.quant // 8 + 128, 0, 255).astype(np.uint8)


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: which cells of an 8 x 8 grid over the thumbnail are above its mean."""
    sums = np.zeros((9, 9))
    whole = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1))
    whole[1:, 1:] = thumb.astype(np.float64).cumsum(0).cumsum(1)
    ys, xs = (np.linspace(0, n, 9).round().astype(int) for n in thumb.shape)
    sums = whole[np.ix_(ys, xs)]
    cell = sums[1:, 1:] - sums[:-1, 1:] - sums[1:, :-1] + sums[:-1, :-1]
    area = np.maximum(np.diff(ys)[:, None] * np.diff(xs), 1)
    return np.packbits(cell / area > thumb.mean()).tobytes().hex()


def payload_of(im: Image, coef: np.ndarray) -> tuple[int, bytes]:
    """(bytes before padding, payload) of a file made by ``encode``."""
    m = re.fullmatch(rb"payload blocks=(\d+) bytes=(\d+)", im.comment)
    if not m:
        raise ValueError("no payload")
    c = coef[: int(m[1])].astype(np.int64)
    return int(m[2]), (c + 128 - (c > 0)).astype(np.uint8).tobytes()


def decode(media: list[bytes | None]) -> list[tuple]:
    """(image, coefficients, error) of each file; broken files don't harm the others."""
    out: list = [(None, None, "null")] * len(media)
    good = []
    for i, raw in enumerate(media):
        try:
            if raw is not None:
                good.append((i, Image(raw)))
        except (ValueError, IndexError, KeyError, StopIteration, struct.error) as e:
            out[i] = (None, None, str(e) or "broken")
    try:
        for (i, im), c in zip(good, coefficients([im for _, im in good]) if good else [], strict=True):
            out[i] = (im, c, None)
    except (ValueError, IndexError):
        for i, im in good:  # find the broken one
            try:
                out[i] = (im, coefficients([im])[0], None)
            except (ValueError, IndexError) as e:
                out[i] = (None, None, str(e) or "broken")
    return out


def to_jpeg(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``media`` in place of the text column."""
    keep = [f for f in df.schema.fields if f.name not in (text, "media")]

    def run(batches):
        for b in batches:
            texts = b.column(text).to_pylist()
            for a, z in chunks(texts):
                media = encode([(t or "").encode("utf-8", "surrogatepass") for t in texts[a:z]])
                part = b.slice(a, z - a)
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in keep], pa.array(media, pa.binary())], names=[*[f.name for f in keep], "media"])

    return df.select(*[f.name for f in keep], text).mapInArrow(run, type(df.schema)([*keep]).add("media", "binary"))


COLUMNS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, thumbnail_sha256 string, thumbnail_hash string, error string"


def jpeg_features(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, and the features of ``media``: size, thumbnail hashes, and the payload if it holds one."""
    names = [key, *[c.split()[0] for c in COLUMNS.split(", ")]]

    def row(raw, im, coef, error):
        if im is None:
            return (None,) * 4 + ((len(raw), hashlib.sha256(raw).hexdigest()) if raw is not None else (None, None)) + (None,) * 5 + (error,)
        n, payload = payload_of(im, coef) if im.comment.startswith(b"payload") else (None, None)
        thumb = thumbnail(im, coef)
        sha, short = hashlib.sha256(thumb.tobytes()).hexdigest(), average_hash(thumb)
        own = (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])) if payload is not None else (None,) * 4
        return (*own, len(raw), hashlib.sha256(raw).hexdigest(), f"jpeg {im.width}x{im.height} dc:{sha[:16]} mean:{short}", im.width, im.height, sha, short, None)

    def run(batches):
        for b in batches:
            media = b.column("media").to_pylist()
            for a, z in chunks(media):
                got = [row(raw, *d) for raw, d in zip(media[a:z], decode(media[a:z]), strict=True)]
                part = pa.RecordBatch.from_pylist([dict(zip(names[1:], g, strict=True)) for g in got], schema=types)
                yield pa.RecordBatch.from_arrays([b.column(key).slice(a, z - a), *part.columns], names=names)

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    types = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in COLUMNS.split(", ")])
    return df.select(key, "media").mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, {COLUMNS}")


def op2_jpeg(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return jpeg_features(to_jpeg(docs)).drop("error")
