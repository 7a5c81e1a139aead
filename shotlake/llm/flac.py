"""FLAC media columns: 8-bit mono streams written and read in numpy.

The writer picks, for each frame, a constant, verbatim or fixed-predictor
subframe (order 0 to 2) with one Rice parameter, and puts a seek point for
every frame into the stream. The reader finds frames by their seek points (or,
without them, by sync codes and checksums), verifies each frame's CRC-8 and
CRC-16, decodes Rice residuals of all frames of a batch side by side, undoes
fixed and linear predictors, and returns PCM blocks with sample offsets.
The MD5 of the stream's header is checked too.

A null text counts as empty; its payload is 64 bytes of 0. Texts of any length
are cut into frames of BLOCK samples. Equal texts give equal streams and
features, so do repeated rows. A damaged stream raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, raw_texts, table

BLOCK = 4096
RATE = 8000
PAD = 64
#: Payload bytes that a batch encodes or decodes side by side.
TOGETHER = 1 << 20


@lru_cache(maxsize=1)
def _crc8_table() -> list[int]:
    out = []
    for b in range(256):
        for _ in range(8):
            b = (b << 1) ^ 0x07 if b & 0x80 else b << 1
        out.append(b & 0xFF)
    return out


def crc8(data: bytes) -> int:
    t, c = _crc8_table(), 0
    for b in data:
        c = t[c ^ b]
    return c


@lru_cache(maxsize=1)
def _crc16_table() -> np.ndarray:
    """[d, b]: what byte b with d bytes after it adds to a CRC-16 (polynomial 0x8005, start 0)."""
    one = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        one = np.where(one & 0x8000, (one << 1) ^ 0x8005, one << 1) & 0xFFFF
    rows = [one]
    for _ in range(BLOCK + 64):
        last = rows[-1]
        rows.append(((last << 8) & 0xFFFF) ^ one[last >> 8])
    return np.stack(rows).astype(np.uint16)


def crc16_all(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of data[start:end] for each frame; frames lie one after the other."""
    t = _crc16_table()
    out = np.zeros(len(starts), np.uint16)
    sizes = ends - starts
    short = np.nonzero((sizes > 0) & (sizes <= len(t)))[0]
    if len(short):
        n = sizes[short]
        first = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(first, n)
        values = t[np.repeat(n, n) - 1 - within, data[np.repeat(starts[short], n) + within]]
        out[short] = np.bitwise_xor.reduceat(values, first)
    for i in np.nonzero(sizes > len(t))[0]:
        c = 0
        for b in data[starts[i] : ends[i]].tolist():
            c = ((c << 8) & 0xFFFF) ^ int(t[0][(c >> 8) ^ b])
        out[i] = c
    return out


def utf8_number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    tail = []
    room = 0x3F
    while n > room:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        room >>= 1
    return bytes([(~room << 1) & 0xFF | n, *reversed(tail)])


def read_number(data: bytes, at: int) -> tuple[int, int]:
    b = data[at]
    if b < 0x80:
        return b, at + 1
    more = 0
    while b & (0x40 >> more):
        more += 1
    n = b & (0x3F >> more)
    for i in range(more):
        n = n << 6 | data[at + 1 + i] & 0x3F
    return n, at + 1 + more


def frame_header(number: int, size: int) -> bytes:
    head = b"\xff\xf8" + (b"\xc0\x02" if size == BLOCK else b"\x70\x02") + utf8_number(number) + (b"" if size == BLOCK else struct.pack(">H", size - 1))
    return head + bytes([crc8(head)])


def padded(text: bytes) -> bytes:
    return text + b"\0" * (PAD - len(text) if not text else -len(text) % PAD)


def _lockstep(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of frames from the longest to the shortest, and how many are still running at each step."""
    order = np.argsort(-sizes, kind="stable")
    running = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")
    return order, running


def encode(payloads: list[bytes], lpc: int | None = None) -> list[bytes]:
    """One FLAC stream for each payload of at least one byte. lpc: a first-order coefficient in sixteenths, -32 to 31, to use instead of the fixed predictors."""
    flat = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32) - 128
    owners, sizes = [], []
    for i, p in enumerate(payloads):
        for s in range(0, len(p), BLOCK):
            owners.append(i)
            sizes.append(min(BLOCK, len(p) - s))
    size = np.array(sizes)
    start = np.cumsum(size) - size
    within = np.arange(len(flat)) - np.repeat(start, size)

    def residual(order: int) -> np.ndarray:
        e = flat
        for k in range(order):
            e = np.where(within > k, e - np.concatenate([[0], e[:-1]]), e)
        return e

    if lpc is None:
        each = [residual(k) for k in range(3)]
        costs = np.stack([np.add.reduceat(np.where(within >= k, np.abs(e), 0), start) for k, e in enumerate(each)])
        order = costs.argmin(0)
        picked = np.repeat(order, size)
        e = np.where(picked == 0, each[0], np.where(picked == 1, each[1], each[2]))
    else:
        order = np.ones(len(size), np.int64)
        e = flat - ((lpc * np.concatenate([[0], flat[:-1]])) >> 4)
    coded = within >= np.repeat(order, size)
    zz = np.where(coded, (e << 1) ^ (e >> 31), 0).astype(np.int64)
    mean = np.add.reduceat(zz, start) / np.maximum(size - order, 1)
    k = np.clip(np.floor(np.log2(np.maximum(mean, 1) * 0.6931 + 0.5)).astype(np.int64), 0, 12)
    kk = np.repeat(k, size)
    lengths = np.where(coded, (zz >> kk) + 1 + kk, 8)
    head_bits = 8 + 10 + (0 if lpc is None else 4 + 5 + 6)
    body = head_bits + np.add.reduceat(lengths, start)
    same = np.add.reduceat((flat != np.repeat(flat[start], size)).astype(np.int64), start) == 0
    verbatim = ~same & (body > 8 + 8 * size)
    body = np.where(same, 16, np.where(verbatim, 8 + 8 * size, body))
    heads, number = [], 0
    for f, owner in enumerate(owners):
        number = number + 1 if f and owners[f - 1] == owner else 0
        heads.append(frame_header(number, int(size[f])))
    head_size = np.array([len(h) for h in heads])
    frame_bytes = head_size + -(-body // 8)
    at = np.cumsum(frame_bytes) - frame_bytes
    bits = np.zeros(int(frame_bytes.sum()) * 8, np.uint8)
    sub = (at + head_size) * 8

    def put(where: np.ndarray, values: np.ndarray, width: int) -> None:
        for j in range(width):
            bits[where + j] = (values >> (width - 1 - j)) & 1

    predicted = ~same & ~verbatim
    kind = np.where(same, 0, np.where(verbatim, 1, (8 + order) if lpc is None else 32))
    put(sub, kind << 1, 8)
    put(sub[same] + 8, flat[start][same] & 0xFF, 8)
    raw = np.nonzero(np.repeat(verbatim, size))[0]
    put(np.repeat(sub, size)[raw] + 8 + 8 * within[raw], flat[raw] & 0xFF, 8)
    warm = np.nonzero(~coded & np.repeat(predicted, size))[0]
    put(np.repeat(sub, size)[warm] + 8 + 8 * within[warm], flat[warm] & 0xFF, 8)
    after = sub + 8 + 8 * order
    if lpc is not None:
        put(after[predicted], np.full(int(predicted.sum()), 5), 4)  # precision less one
        put(after[predicted] + 4, np.full(int(predicted.sum()), 4), 5)
        put(after[predicted] + 9, np.full(int(predicted.sum()), lpc & 63), 6)
        after = after + 15
    put(after[predicted] + 6, k[predicted], 4)
    rest = np.nonzero(coded & np.repeat(predicted, size))[0]
    own = lengths[rest]
    place = np.cumsum(own) - own
    firsts = np.nonzero(np.concatenate([[True], np.repeat(np.arange(len(size)), size)[rest][1:] != np.repeat(np.arange(len(size)), size)[rest][:-1]]))[0] if len(rest) else np.zeros(0, np.int64)
    frame_of = np.repeat(np.arange(len(size)), size)[rest]
    base = np.zeros(len(size), np.int64)
    base[frame_of[firsts]] = place[firsts]
    place = place - base[frame_of] + (after + 10)[frame_of]
    q, kr, z = zz[rest] >> kk[rest], kk[rest], zz[rest]
    bits[place + q] = 1
    for j in range(int(kr.max(initial=0))):
        has = np.nonzero(kr > j)[0]
        bits[(place + q + 1)[has] + j] = (z[has] >> (kr[has] - 1 - j)) & 1
    data = np.packbits(bits)
    joined = bytearray(data.tobytes())
    for a, h in zip(at.tolist(), heads, strict=True):
        joined[a : a + len(h)] = h
    whole = np.frombuffer(bytes(joined), np.uint8)
    checks = crc16_all(whole, at, at + frame_bytes)
    out, f = [], 0
    for p in payloads:
        n = -(-len(p) // BLOCK)
        frames = [whole[at[g] : at[g] + frame_bytes[g]].tobytes() + struct.pack(">H", int(checks[g])) for g in range(f, f + n)]
        points, offset = [], 0
        for g, frame in enumerate(frames):
            points.append(struct.pack(">QQH", g * BLOCK, offset, int(size[f + g])))
            offset += len(frame)
        lens = [len(x) for x in frames]
        samples = bytes(np.frombuffer(p, np.uint8) ^ 0x80)
        # a stream of one frame has that frame's size as its block size
        info = struct.pack(">HH", *[BLOCK if n > 1 else max(16, len(p))] * 2) + min(lens).to_bytes(3, "big") + max(lens).to_bytes(3, "big") + (RATE << 44 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(samples).digest()
        table_ = b"".join(points)
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table_).to_bytes(3, "big") + table_ + b"".join(frames))
        f += n
    return out


class Stream(NamedTuple):
    samples: int
    md5: bytes
    frames: list[tuple[int, int]]


def parse(data: bytes) -> Stream:
    """The stream's header and the byte range of each frame, by seek points or else by sync codes and checksums."""
    if data[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, last, info, points = 4, False, b"", []
    while not last:
        last, kind, n = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + n]
        if kind == 0:
            info = body
        elif kind == 3:
            points = [p for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1]
        at += 4 + n
    packed = int.from_bytes(info[10:18], "big")
    if (packed >> 36 & 31) != 7 or (packed >> 41 & 7) != 0:
        raise ValueError("not 8-bit mono")
    total = packed & (1 << 36) - 1
    if points and sum(p[2] for p in points) == total:
        starts = [at + p[1] for p in points]
    else:
        starts, spot = [], at
        while spot < len(data):
            starts.append(spot)
            follow = data.find(b"\xff\xf8", spot + 2)
            while follow >= 0:
                if header(data, follow, False) and int(crc16_all(np.frombuffer(data, np.uint8), np.array([spot]), np.array([follow - 2]))[0]) == int.from_bytes(data[follow - 2 : follow], "big"):
                    break
                follow = data.find(b"\xff\xf8", follow + 1)
            spot = follow if follow >= 0 else len(data)
    return Stream(total, info[18:34], list(zip(starts, [*starts[1:], len(data)], strict=True)))


def header(data: bytes, at: int, strict: bool = True) -> tuple[int, int, int] | None:
    """(frame number, block size, end of the header) after its CRC-8 held."""
    try:
        code = data[at + 2] >> 4
        number, p = read_number(data, at + 4)
        if code == 6:
            size, p = data[p] + 1, p + 1
        elif code == 7:
            size, p = int.from_bytes(data[p : p + 2], "big") + 1, p + 2
        else:
            size = 192 if code == 1 else 576 << code - 2 if code < 6 else 256 << code - 8
        if data[at : at + 2] == b"\xff\xf8" and crc8(data[at:p]) == data[p]:
            return number, size, p + 1
    except IndexError:
        pass
    if strict:
        raise ValueError(f"frame header at byte {at} is damaged")
    return None


def decode(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """For each stream its PCM blocks, as (sample offset, bytes with 128 for zero)."""
    parsed = [parse(s) for s in streams]
    joined = np.frombuffer(b"".join(streams), np.uint8)
    shift = np.cumsum([0, *(len(s) for s in streams)])
    owner, size, body, end = [], [], [], []
    for i, (s, p) in enumerate(zip(streams, parsed, strict=True)):
        for a, b in p.frames:
            _, n, q = header(s, a)
            owner.append(i), size.append(n), body.append(shift[i] + q), end.append(shift[i] + b)
    size, body, end = np.array(size), np.array(body), np.array(end)
    begin = np.array([shift[i] + a for i, p in enumerate(parsed) for a, _ in p.frames])
    said = joined[end - 2].astype(np.int64) << 8 | joined[end - 1]
    if (crc16_all(joined, begin, end - 2) != said).any():
        raise ValueError("a frame's CRC-16 is wrong")
    kind = joined[body] >> 1
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.int64)
    within = np.arange(len(out)) - np.repeat(start, size)
    signed = joined.view(np.int8)
    for f in np.nonzero(kind == 0)[0]:
        out[start[f] : start[f] + size[f]] = signed[body[f] + 1]
    raw = np.nonzero(np.repeat(kind == 1, size))[0]
    out[raw] = signed[np.repeat(body + 1, size)[raw] + within[raw]]
    coded = np.nonzero(kind >= 8)[0]
    if len(coded):
        _residuals(joined, signed, kind, size, body, end, start, out, coded)
    blocks: list[list[tuple[int, bytes]]] = [[] for _ in streams]
    offset = [0] * len(streams)
    bytes_out = ((out + 128) & 0xFF).astype(np.uint8)
    for f, i in enumerate(owner):
        blocks[i].append((offset[i], bytes_out[start[f] : start[f] + size[f]].tobytes()))
        offset[i] += int(size[f])
    for own, p in zip(blocks, parsed, strict=True):
        whole = b"".join(b for _, b in own)
        if len(whole) != p.samples or p.md5 != bytes(16) and hashlib.md5(bytes(np.frombuffer(whole, np.uint8) ^ 0x80)).digest() != p.md5:
            raise ValueError("the decoded samples differ from the stream's MD5")
    return blocks


def _residuals(joined, signed, kind, size, body, end, start, out, coded) -> None:
    """Decode Rice residuals of the frames `coded` side by side and undo their predictors, in place."""
    lo, hi = body[coded], end[coded] - 2
    n_bytes = hi - lo
    first = np.cumsum(n_bytes) - n_bytes
    within = np.arange(int(n_bytes.sum())) - np.repeat(first, n_bytes)
    bits = np.unpackbits(joined[np.repeat(lo, n_bytes) + within])
    # the place of the next 1 at or after each bit
    ones = np.nonzero(bits)[0]
    nxt = np.full(len(bits) + 1, len(bits), np.int32)
    gaps = np.diff(np.concatenate([[-1], ones]))
    nxt[: int(gaps.sum())] = np.repeat(ones, gaps)
    padded_bits = np.concatenate([bits, np.zeros(40, np.uint8)])
    # 16 bits from each byte on, so that k bits anywhere take two look-ups
    packed = np.concatenate([joined[np.repeat(lo, n_bytes) + within], np.zeros(4, np.uint8)]).astype(np.uint32)
    three = packed[:-2] << 16 | packed[1:-1] << 8 | packed[2:]

    def read(at: np.ndarray, width: int | np.ndarray) -> np.ndarray:
        word = three[at >> 3].astype(np.int64)
        return (word >> (24 - (at & 7) - width)) & ((1 << width) - 1)

    def wide(at: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Up to 32 bits."""
        head = np.minimum(width, 16)
        return read(at, head) << (width - head) | read(at + head, width - head)

    lpc = kind[coded] >= 32
    order = np.where(lpc, (kind[coded] & 31) + 1, kind[coded] - 8).astype(np.int64)
    pos = first * 8 + 8
    for f, o in enumerate(order.tolist()):
        s, b = start[coded[f]], lo[f] + 1
        out[s : s + o] = signed[b : b + o]
    pos = pos + 8 * order
    coefs: list[list[int]] = [[] for _ in coded]
    move = np.zeros(len(coded), np.int64)
    for f in np.nonzero(lpc)[0].tolist():
        at = int(pos[f])
        take = lambda w, at: int("".join(map(str, padded_bits[at : at + w].tolist())), 2)
        precision, move[f] = take(4, at) + 1, take(5, at + 4)
        at += 9
        for _ in range(int(order[f])):
            c = take(precision, at)
            coefs[f].append(c - (1 << precision) if c >> precision - 1 else c)
            at += precision
        pos[f] = at
    method, parts = read(pos, 2), read(pos + 2, 4)
    if (method > 1).any():
        raise ValueError("unknown residual coding")
    pos = pos + 6
    sizes = size[coded]
    rank, running = _lockstep(sizes)
    part_size = sizes >> parts
    k = np.zeros(len(coded), np.int64)
    place, base = pos[rank], start[coded][rank]
    o_r, ps_r = order[rank], part_size[rank]
    simple = bool((parts == 0).all())
    ks, bits_of = k[rank], 4 + method[rank]
    # width of the samples in an escaped partition, else -1
    escape, escapes, long = np.full(len(coded), -1, np.int64), False, bool(method.any())
    for i in range(int(sizes.max())):
        m = int(running[i])
        if not simple or i == 0 or i <= int(o_r[:m].max()):
            fresh = np.nonzero((i >= o_r[:m]) & ((i == o_r[:m]) | (i % ps_r[:m] == 0)))[0]
            if len(fresh):
                ks[fresh] = read(place[fresh], bits_of[fresh])
                place[fresh] += bits_of[fresh]
                escape[fresh] = -1
                escaped = fresh[ks[fresh] == (1 << bits_of[fresh]) - 1]
                if len(escaped):
                    ks[escaped], escape[escaped], escapes = 0, read(place[escaped], 5), True
                    place[escaped] += 5
            active = np.nonzero(i >= o_r[:m])[0]
            if not len(active):
                continue
            at, kk, to = place[active], ks[active], base[active] + i
        else:
            active, at, kk, to = slice(0, m), place[:m], ks[:m], base[:m] + i
        if escapes and ((plain := escape[active] < 0) == False).any():  # noqa: E712
            active = np.arange(m)[active]
            raw, to_raw = active[~plain], to[~plain]
            width = escape[raw]
            value = wide(place[raw], width)
            out[to_raw] = value - ((value >> np.maximum(width - 1, 0) & 1) << width)
            place[raw] += width
            active, at, kk, to = active[plain], at[plain], kk[plain], to[plain]
        stop = nxt[at].astype(np.int64)
        z = (stop - at) << kk | (wide(stop + 1, kk) if long else read(stop + 1, kk))
        out[to] = (z >> 1) ^ -(z & 1)
        place[active] = stop + 1 + kk
    for f in np.nonzero(~lpc & (order > 0))[0].tolist():
        s, n, o = start[coded[f]], sizes[f], int(order[f])
        x = out[s : s + n]
        warm = x[:o].copy()
        for level in range(o, 0, -1):
            # the first sample of the (level-1)-th difference that the warm-up gives
            d = np.diff(warm, level - 1)[-1]
            tail = np.cumsum(np.concatenate([[d], x[o:]]))
            x[o:] = tail[1:]
    for f in np.nonzero(lpc)[0].tolist():
        s, n, o = start[coded[f]], int(sizes[f]), int(order[f])
        x = out[s : s + n].tolist()
        for i in range(o, n):
            x[i] += sum(c * x[i - 1 - j] for j, c in enumerate(coefs[f])) >> int(move[f])
        out[s : s + n] = x


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, flac): the padded text as an 8-bit FLAC stream."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = raw_texts(batch, text_col)
        streams = encode([padded(x) for x in raw])
        return pa.RecordBatch.from_arrays([batch.column(id_col), pa.array([len(x) for x in raw], pa.int64()), pa.array(streams, pa.binary())], [id_col, "n_bytes", "flac"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs.select(id_col, text_col), run, f"{id_col} {kind}, n_bytes long, flac binary", text_col, TOGETHER)


def blocks(stored: DataFrame, id_col: str = "doc_id", flac_col: str = "flac") -> DataFrame:
    """(id_col, sample_offset, n_samples, pcm): the PCM blocks of each stream, seekable by sample offset."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, rows = batch.column(id_col), []
        for i, own in enumerate(decode(batch.column(flac_col).to_pylist())):
            rows += [(i, offset, pcm) for offset, pcm in own]
        return pa.RecordBatch.from_arrays([keys.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int64()), pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], [id_col, "sample_offset", "n_samples", "pcm"])

    kind = stored.schema[id_col].dataType.simpleString()
    return map_texts(stored.where(F.col(flac_col).isNotNull()).select(id_col, flac_col), run, f"{id_col} {kind}, sample_offset long, n_samples long, pcm binary", flac_col, TOGETHER)


def _feature(x: bytes) -> str:
    s = np.frombuffer(x, np.uint8).astype(np.int64) - 128
    crossings = int(((s[1:] < 0) != (s[:-1] < 0)).sum())
    return f"samples={len(s)};peak={int(np.abs(s).max())};energy={int((s * s).sum())};crossings={crossings};mean_milli={int(s.sum()) * 1000 // len(s)}"


def digests(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the read-back samples of each stream give; all frames of a stream are read in one task."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        streams = batch.column("flac").to_pylist()
        back = [b"".join(b for _, b in own) for own in decode(streams)]
        columns = {
            id_col: batch.column(id_col),
            "n_bytes": batch.column("n_bytes"),
            "payload_bytes": pa.array([len(x) for x in back], pa.int64()),
            "payload_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in back]),
            "tail_crc32": pa.array([zlib.crc32(x[-PAD:]) for x in back], pa.int64()),
            "media_bytes": pa.array([len(x) for x in streams], pa.int64()),
            "media_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in streams]),
            "feature": pa.array([_feature(x) for x in back]),
        }
        return pa.RecordBatch.from_pydict(columns)

    kind = stored.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_texts(stored, run, schema, "flac", TOGETHER)


def op8(spark, sf_dir: str) -> DataFrame:
    return digests(store(table(spark, sf_dir, "documents")))
