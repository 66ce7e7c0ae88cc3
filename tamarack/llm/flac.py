"""FLAC media columns: texts as 8-bit mono audio, encoded and decoded in numpy.

Encoder: blocks of 4096 samples, the better of a fixed or a quantized linear predictor (verbatim where
neither pays), Rice-coded residuals, a frame checksum, and a seek table with one point for each block.
Decoder: finds blocks through the seek table, verifies both frame checksums, decodes Rice
residuals and predictors, and checks the stream's MD5. Blocks of many rows are decoded side by side,
one sample index at a time, so that the serial parts of the format run on whole vectors.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.common import added, documents, prepare, text_udf

BLOCK, UNIT, RATE = 4096, 64, 8000
LPC_ORDER, PRECISION, PARTITION_ORDER = 2, 12, 2
#: Samples that are worked on side by side; bounds the memory of a worker, not what it can read.
CELLS = 1 << 19
#: Payload bytes of an Arrow batch that are encoded or decoded at a time (a single longer text is taken alone).
SLICE = 2 << 20


class FlacError(ValueError):
    """A stream that is damaged or not supported."""


# ---------------------------------------------------------------- checksums


def _crc_rows(poly: int, width: int, length: int) -> np.ndarray:
    """(length, 256): what a byte adds to the checksum when it stands that far from the end (checksums are linear)."""
    top, mask = 1 << (width - 1), (1 << width) - 1
    first = []
    for byte in range(256):
        crc = byte << (width - 8)
        for _ in range(8):
            crc = ((crc << 1) ^ poly) & mask if crc & top else (crc << 1) & mask
        first.append(crc)
    table = np.array(first, dtype=np.uint16)
    out = np.empty((length, 256), dtype=np.uint16)
    out[0] = table
    for d in range(1, length):
        prev = out[d - 1].astype(np.uint32)
        out[d] = ((prev << 8) & mask) ^ table[(prev >> (width - 8)) & 0xFF]
    return out


_TABLES: dict[int, np.ndarray] = {}


def _crc16_table(length: int) -> np.ndarray:
    have = _TABLES.get(16)
    if have is None or len(have) < length:
        _TABLES[16] = _crc_rows(0x8005, 16, max(length, BLOCK + 64))
    return _TABLES[16]


def crc16(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of stretches of ``flat``; the stretches lie one after another without gaps."""
    distance = np.repeat(starts + sizes - 1, sizes) - np.arange(len(flat))
    parts = _crc16_table(int(sizes.max()))[distance, flat]
    return np.bitwise_xor.reduceat(parts, starts)


_CRC8 = [int(x) for x in _crc_rows(0x07, 8, 1)[0]]


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = _CRC8[crc ^ b]
    return crc


# ---------------------------------------------------------------- encoder


def _number(value: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if value < 0x80:
        return bytes([value])
    tail = []
    limit = 0x3F
    while value > limit:
        tail.append(0x80 | (value & 0x3F))
        value >>= 6
        limit = 0x1F if len(tail) == 1 else limit >> 1
    lead = (0xFF << (7 - len(tail))) & 0xFF
    return bytes([lead | value, *reversed(tail)])


def _frame_header(number: int, size: int) -> bytes:
    code = 0xC if size == BLOCK else 0x7
    head = bytes([0xFF, 0xF8, code << 4 | 0x4, 0x02]) + _number(number)
    if code == 0x7:
        head += struct.pack(">H", size - 1)
    return head + bytes([crc8(head)])


def _fold(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _linear(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantized linear predictors (rows, LPC_ORDER) and their shifts, by autocorrelation and Levinson's recursion."""
    z = x.astype(np.float32)
    lags = np.stack([np.einsum("rt,rt->r", z[:, : z.shape[1] - lag], z[:, lag:]) for lag in range(LPC_ORDER + 1)], axis=1).astype(np.float64)
    error = lags[:, 0] * (1 + 1e-9) + 1e-9
    a = np.zeros((len(x), LPC_ORDER))
    for i in range(LPC_ORDER):
        k = (lags[:, i + 1] - (a[:, :i] * lags[:, i:0:-1]).sum(axis=1)) / error
        a[:, :i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    most = np.maximum(np.abs(a).max(axis=1), 1e-6)
    shift = np.clip(PRECISION - 2 - np.ceil(np.log2(most)), 0, 14).astype(np.int64)
    bound = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -bound, bound).astype(np.int64), shift


def _residuals(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Folded residuals, order and type (0 and 1: fixed order, 3: linear), predictors and shifts of every row.

    ``x`` must hold zeros beyond ``sizes``.
    """
    coefs, shift = _linear(x, sizes)
    pred = coefs[:, 0, None].astype(np.int32) * x[:, LPC_ORDER - 1 : -1]
    for j in range(1, LPC_ORDER):
        pred += coefs[:, j, None].astype(np.int32) * x[:, LPC_ORDER - 1 - j : x.shape[1] - 1 - j]
    pred >>= shift[:, None].astype(np.int32)
    best = x.copy()
    best[:, LPC_ORDER:] -= pred
    choices = [_fold(x), _fold(np.diff(x, axis=1, prepend=0)), _fold(best)]
    orders, kinds = np.array([0, 1, LPC_ORDER]), np.array([0, 1, 3])
    short = np.flatnonzero(sizes < x.shape[1])
    for c, order in zip(choices, orders, strict=True):
        for r in short:
            c[r, sizes[r] :] = 0
        c[:, :order] = 0
    costs = np.stack([c.sum(axis=1, dtype=np.int64) for c in choices], axis=1)
    costs[:, 2] += 60  # predictor and warm-up
    pick = costs.argmin(axis=1)
    folded = choices[0]
    for i in (1, 2):
        rows = pick == i
        folded[rows] = choices[i][rows]
    return folded, orders[pick], kinds[pick], coefs, shift


def _put(bits: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at if not j else at + j] = (values >> (width - 1 - j)) & 1


def encode_blocks(samples: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """Frames of blocks of signed 8-bit samples: (rows, longest) with ``sizes`` used; sizes are multiples of 4."""
    rows, longest = samples.shape
    folded, order, kind, coefs, shift = _residuals(samples.astype(np.int32), sizes)
    parts = 1 << PARTITION_ORDER
    counts = np.repeat((sizes >> PARTITION_ORDER)[:, None], parts, axis=1)
    counts[:, 0] -= order
    counts = counts.ravel()
    place = np.arange(longest, dtype=np.int32)
    u = folded[(place >= order[:, None]) & (place < sizes[:, None])]
    opening = np.concatenate(([0], np.cumsum(counts)[:-1]))
    mean = np.add.reduceat(u, opening, dtype=np.int64) / counts
    k = np.clip(np.floor(np.log2(mean * 0.75 + 0.5)), 0, 14).astype(np.int32)
    kk = np.repeat(k, counts)
    q = u >> kk
    lens = q + kk
    lens += 1
    spent = np.add.reduceat(lens, opening, dtype=np.int64).reshape(rows, parts)
    payload = spent.sum(axis=1)
    fore = 8 + 8 * order + np.where(kind == 3, 9 + LPC_ORDER * PRECISION, 0)  # header, warm-up, predictor
    coded = fore + 6 + 4 * parts + payload
    verbatim = coded >= 8 + 8 * sizes
    total = np.where(verbatim, 8 + 8 * sizes, coded)
    heads = [_frame_header(int(n), int(s)) for n, s in zip(numbers, sizes, strict=True)]
    head_bytes = np.array([len(h) for h in heads], dtype=np.int64)
    body = -(-total // 8)
    frame = head_bytes + body
    begin = np.concatenate(([0], np.cumsum(frame)[:-1]))
    bits = np.zeros(int(frame.sum()) * 8, dtype=np.uint8)
    at = (begin + head_bytes) * 8
    types = np.where(verbatim, 1, np.where(kind == 3, 32 + LPC_ORDER - 1, 8 + kind))
    _put(bits, at, types << 1, 8)
    plain = np.flatnonzero(verbatim)
    if len(plain):
        r, t = np.nonzero(np.arange(longest) < sizes[plain][:, None])
        _put(bits, at[plain][r] + 8 + 8 * t, samples[plain[r], t].astype(np.int64) & 0xFF, 8)
    for j in range(LPC_ORDER):
        use = np.flatnonzero(~verbatim & (order > j))
        _put(bits, at[use] + 8 + 8 * j, samples[use, j].astype(np.int64) & 0xFF, 8)
    use = np.flatnonzero(~verbatim & (kind == 3))
    if len(use):
        p = at[use] + 8 + 8 * LPC_ORDER
        _put(bits, p, np.full(len(use), PRECISION - 1), 4)
        _put(bits, p + 4, shift[use], 5)
        for j in range(LPC_ORDER):
            _put(bits, p + 9 + j * PRECISION, coefs[use, j] & ((1 << PRECISION) - 1), PRECISION)
    rest = at + fore
    coded_rows = np.flatnonzero(~verbatim)
    _put(bits, rest[coded_rows], np.full(len(coded_rows), PARTITION_ORDER), 6)
    opens = rest[:, None] + 6 + 4 * np.arange(parts) + np.cumsum(spent, axis=1) - spent
    _put(bits, opens[coded_rows].ravel(), k.reshape(rows, parts)[coded_rows].ravel(), 4)
    ends = np.cumsum(lens, dtype=np.int64)
    base = opens.ravel() + 4 - (ends[opening] - lens[opening])
    stop = ends - lens
    stop += q
    stop += np.repeat(base, counts)
    if len(plain):
        keep = np.repeat(np.repeat(~verbatim, parts), counts)
        stop, u, kk = stop[keep], u[keep], kk[keep]
    bits[stop] = 1
    for width in np.unique(kk):
        if width:
            mine = np.flatnonzero(kk == width)
            _put(bits, stop[mine] + 1, u[mine], int(width))
    flat = np.packbits(bits)
    for h, b in zip(heads, begin, strict=True):
        flat[b : b + len(h)] = np.frombuffer(h, dtype=np.uint8)
    sums = crc16(flat, begin, frame)
    return [flat[b : b + n].tobytes() + int(c).to_bytes(2, "big") for b, n, c in zip(begin, frame, sums, strict=True)]


def payload_of(text: str | None) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of 64; null is empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def _grouped(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of blocks, longest first, in groups of about CELLS samples."""
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, CELLS // max(int(lengths[order[at]]), 1))
        yield order[at : at + n]
        at += n


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload (lengths: multiples of 4, 16 at least); a byte is a sample, shifted by 128."""
    blocks = [(i, at) for i, p in enumerate(payloads) for at in range(0, len(p), BLOCK)]
    lengths = np.array([min(BLOCK, len(payloads[i]) - at) for i, at in blocks], dtype=np.int64)
    frames: list[bytes] = [b""] * len(blocks)
    for group in _grouped(lengths):
        x = np.zeros((len(group), int(lengths[group[0]])), dtype=np.int16)
        for r, g in enumerate(group):
            i, at = blocks[g]
            raw = np.frombuffer(payloads[i], dtype=np.uint8, count=int(lengths[g]), offset=at)
            x[r, : len(raw)] = raw.astype(np.int16) - 128
        for g, data in zip(group, encode_blocks(x, lengths[group], np.array([blocks[g][1] // BLOCK for g in group])), strict=True):
            frames[g] = data
    out, g = [], 0
    for p in payloads:
        n = -(-len(p) // BLOCK)
        own = frames[g : g + n]
        digest = hashlib.md5(np.bitwise_xor(np.frombuffer(p, dtype=np.uint8), 0x80).tobytes(), usedforsecurity=False).digest()
        sizes = [len(f) for f in own]
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + digest
        seek, at = [], 0
        for b, size in enumerate(sizes):
            seek.append(struct.pack(">QQH", b * BLOCK, at, int(lengths[g + b])))
            at += size
        table = b"".join(seek)
        out.append(b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(table).to_bytes(3, "big") + table + b"".join(own))
        g += n
    return out


# ---------------------------------------------------------------- decoder


def open_stream(media: bytes) -> tuple[int, bytes, list[tuple[int, int, int]], int]:
    """(samples, MD5, seek points as (sample, byte offset, samples), start of the frames) of a stream."""
    if media[:4] != b"fLaC":
        raise FlacError("no FLAC marker")
    at, last, total, digest, points = 4, False, -1, b"", []
    while not last:
        if at + 4 > len(media):
            raise FlacError("metadata is cut off")
        last, kind, size = bool(media[at] & 0x80), media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        at += 4 + size
        if len(body) != size:
            raise FlacError("metadata is cut off")
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            if (packed >> 41) & 7 or (packed >> 36) & 31 != 7:
                raise FlacError("only 8-bit mono is supported")
            total, digest = packed & ((1 << 36) - 1), body[18:34]
        elif kind == 3:
            points = [p for p in struct.iter_unpack(">QQH", body) if p[0] != 0xFFFFFFFFFFFFFFFF]
    if total < 0 or not points or sum(p[2] for p in points) != total:
        raise FlacError("the seek table does not cover the stream")
    return total, digest, points, at


def _check_header(media: bytes, at: int, number: int, size: int) -> int:
    """Bytes of the frame header at ``at``, which must be that of block ``number`` with ``size`` samples."""
    expected = _frame_header(number, size)
    if media[at : at + len(expected)] != expected:
        raise FlacError(f"frame header {number} is damaged")
    return len(expected)


def _peek(bits: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(len(at), dtype=np.int64)
    for j in range(width):
        out = out << 1 | bits[at + j]
    return out


def _signed(values: np.ndarray, width: int) -> np.ndarray:
    return values - ((values >> (width - 1)) << width)


def decode_blocks(frames: list[bytes], heads: list[int], sizes: np.ndarray) -> np.ndarray:
    """Samples (longest, rows) of whole frames, longest first; verifies each frame's CRC-16."""
    raw = np.frombuffer(b"".join(frames), dtype=np.uint8)
    lengths = np.array([len(f) for f in frames], dtype=np.int64)
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    if crc16(raw, begin, lengths).any():  # over a frame with its checksum the remainder is zero
        raise FlacError("frame checksum does not match")
    bits = np.unpackbits(raw)
    rows, longest = len(frames), int(sizes[0])
    x = np.zeros((longest, rows), dtype=np.int32)
    at = (begin + np.array(heads)) * 8
    kind = _peek(bits, at, 8)
    if (kind & 0x81).any():
        raise FlacError("wasted bits are not supported")
    kind >>= 1
    constant = np.flatnonzero(kind == 0)
    if len(constant):
        x[:, constant] = _signed(_peek(bits, at[constant] + 8, 8), 8)
    verbatim = np.flatnonzero(kind == 1)
    if len(verbatim):
        t, r = np.nonzero(np.arange(longest)[:, None] < sizes[verbatim][None, :])
        x[t, verbatim[r]] = raw[at[verbatim][r] // 8 + 1 + t].astype(np.int8)
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    coded = np.flatnonzero(fixed | linear)
    if len(coded) + len(constant) + len(verbatim) != rows:
        raise FlacError("unknown subframe type")
    if len(coded):
        order = np.where(linear, kind - 31, kind - 8)[coded]
        own = sizes[coded]
        pos = at[coded] + 8
        warm = x[:, coded]
        for j in range(int(order.max(initial=0))):
            use = np.flatnonzero(order > j)
            warm[j, use] = _signed(_peek(bits, pos[use] + 8 * j, 8), 8)
        pos = pos + 8 * order
        is_linear = linear[coded]
        coefs, shift = np.zeros((int(order.max(initial=0)), len(coded)), dtype=np.int64), np.zeros(len(coded), dtype=np.int64)
        lp = np.flatnonzero(is_linear)
        if len(lp):
            precision = _peek(bits, pos[lp], 4) + 1
            shift[lp] = _signed(_peek(bits, pos[lp] + 4, 5), 5)
            if (shift[lp] < 0).any():
                raise FlacError("negative predictor shift")
            pos[lp] += 9
            for width in np.unique(precision):
                mine = lp[precision == width]
                for j in range(int(order[mine].max())):
                    use = mine[order[mine] > j]
                    coefs[j, use] = _signed(_peek(bits, pos[use], int(width)), int(width))
                    pos[use] += width
        residual = _rice(bits, pos, own, order, longest)
        x[:, coded] = _restore(residual, warm, order, is_linear, coefs, shift, own)
    return x


def _rice(bits: np.ndarray, pos: np.ndarray, sizes: np.ndarray, order: np.ndarray, longest: int) -> np.ndarray:
    """Residuals (longest, rows). The rows step through their codes together; sizes fall from first to last."""
    if _peek(bits, pos, 2).any():
        raise FlacError("only four-bit Rice parameters are supported")
    span = sizes >> _peek(bits, pos + 2, 4)
    pos = pos + 6
    ones = np.flatnonzero(bits).astype(np.int32)
    # next set bit at or after each place; places after the last one point past the end
    following = np.repeat(np.append(ones, np.int32(len(bits))), np.diff(ones, prepend=-1, append=len(bits)))
    pos = pos.astype(np.int32)
    starts = np.zeros((longest, len(pos)), dtype=np.int32)
    stops = np.zeros((longest, len(pos)), dtype=np.int32)
    params = np.zeros((longest, len(pos)), dtype=np.int8)
    k = np.zeros(len(pos), dtype=np.int32)
    after = k + 1
    border = np.zeros(len(pos), dtype=np.int64)
    active = np.searchsorted(-sizes, -np.arange(longest), side="left").tolist()  # rows with more than t samples
    warming = int(order.max(initial=0))
    nearest = 0
    for t in range(longest):
        live = active[t]
        if t >= nearest:
            fresh = np.flatnonzero(border[:live] == t)
            if len(fresh):
                k[fresh] = _peek(bits, pos[fresh], 4)
                if (k[fresh] == 15).any():
                    raise FlacError("escaped partitions are not supported")
                pos[fresh] += 4
                border[fresh] += span[fresh]
                after = k + 1
            nearest = int(border[:live].min()) if live else longest
        if t < warming:
            use = np.flatnonzero(order[:live] <= t)
            stop = following[pos[use]]
            starts[t, use], stops[t, use], params[t, use] = pos[use], stop, k[use]
            pos[use] = stop + after[use]
        else:
            p = pos[:live]
            starts[t, :live] = p
            params[t, :live] = k[:live]
            stop = following.take(p)
            stops[t, :live] = stop
            np.add(stop, after[:live], out=p)
    # the low bits of a code lie in the three bytes from its stop bit's successor on
    raw = np.packbits(bits).astype(np.int32)
    raw = np.concatenate((raw, np.zeros(3, dtype=np.int32)))
    window = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    u = stops - starts
    stops += 1
    low = window.take(stops >> 3)
    stops &= 7
    low >>= 24 - stops - params
    u <<= params
    u |= low & ((np.int32(1) << params.astype(np.int32)) - 1)
    return (u >> 1) ^ -(u & 1)


def _restore(residual: np.ndarray, warm: np.ndarray, order: np.ndarray, linear: np.ndarray, coefs: np.ndarray, shift: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Samples from residuals: running sums for fixed predictors, one step at a time for linear ones."""
    x = residual
    for o in np.unique(order[~linear]):
        rows = np.flatnonzero(~linear & (order == o))
        if not o:
            continue
        y = x[:, rows].astype(np.int64)
        start = warm[:o, rows].astype(np.int64)
        for level in range(int(o), 0, -1):  # difference of order level - 1 from that of order level
            d = np.diff(start, n=level - 1, axis=0)[0]
            y[level - 1] = d
            y[level - 1 :] = np.cumsum(y[level - 1 :], axis=0)
        y[:o] = start
        x[:, rows] = y
    for o in np.unique(order[linear]):
        rows = np.flatnonzero(linear & (order == o))
        y = np.ascontiguousarray(x[:, rows]).astype(np.int64)
        y[:o] = warm[:o, rows]
        c = np.ascontiguousarray(coefs[:o, rows][::-1])
        s = shift[rows]
        for t in range(int(o), int(sizes[rows].max())):
            pred = y[t - 1] * c[-1]
            for j in range(2, int(o) + 1):
                pred += y[t - j] * c[-j]
            pred >>= s
            y[t] += pred
        x[:, rows] = y
    return x


def decode(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream; raises FlacError if a header, a checksum or the MD5 does not match."""
    opened = [open_stream(m) for m in streams]
    blocks = [(i, b) for i, (_, _, points, _) in enumerate(opened) for b in range(len(points))]
    lengths = np.array([opened[i][2][b][2] for i, b in blocks], dtype=np.int64)
    out = [np.zeros(total, dtype=np.uint8) for total, _, _, _ in opened]
    for group in _grouped(lengths):
        frames, heads = [], []
        for g in group:
            i, b = blocks[g]
            frame, head = _frame(streams[i], opened[i], b)
            frames.append(frame)
            heads.append(head)
        x = (decode_blocks(frames, heads, lengths[group]) + 128).astype(np.uint8).T
        for r, g in enumerate(group):
            i, b = blocks[g]
            sample, _, n = opened[i][2][b]
            out[i][sample : sample + n] = x[r, :n]
    for payload, (_, digest, _, _) in zip(out, opened, strict=True):
        if hashlib.md5(np.bitwise_xor(payload, 0x80).tobytes(), usedforsecurity=False).digest() != digest:
            raise FlacError("MD5 of the stream does not match")
    return [p.tobytes() for p in out]


def _frame(media: bytes, opened: tuple, b: int) -> tuple[bytes, int]:
    _, _, points, base = opened
    sample, offset, n = points[b]
    end = base + points[b + 1][1] if b + 1 < len(points) else len(media)
    head = _check_header(media, base + offset, b, n)
    return media[base + offset : end], head


def read_samples(media: bytes, first: int, count: int) -> bytes:
    """``count`` bytes from sample ``first`` on, decoding only the blocks that hold them."""
    opened = open_stream(media)
    wanted = [b for b, (s, _, n) in enumerate(opened[2]) if s < first + count and first < s + n]
    if not wanted:
        return b""
    data = b""
    for b in wanted:
        frame, head = _frame(media, opened, b)
        data += (decode_blocks([frame], [head], np.array([opened[2][b][2]])) + 128).astype(np.uint8)[:, 0].tobytes()
    skip = first - opened[2][wanted[0]][0]
    return data[skip : skip + count]


# ---------------------------------------------------------------- operators


def features(payload: bytes) -> str:
    """Whole-number features of a payload: samples, mean and power in thousandths, zero crossings, lowest, highest."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
    n = len(x)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"n={n};mean={int(x.sum()) * 1000 // n};power={int((x * x).sum()) * 1000 // n};zc={crossings};min={int(x.min())};max={int(x.max())}"


def _slices(sizes: list[int]) -> Iterator[slice]:
    """Consecutive stretches of about SLICE bytes."""
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > SLICE:
            yield slice(start, i)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def _encode_batch():
    def batch(texts: list) -> dict:
        media: list[bytes] = []
        for part in _slices([len(t or "") for t in texts]):
            media += encode([payload_of(t) for t in texts[part]])
        return {"media": media}

    return batch


def _decode_batch():
    def batch(media: list) -> dict:
        out: dict[str, list] = {"payload_bytes": [], "payload_sha256": [], "tail_crc32": [], "feature": []}
        for part in _slices([len(m or b"") for m in media]):
            there = iter(decode([m for m in media[part] if m is not None]))
            for payload in (None if m is None else next(there) for m in media[part]):
                out["payload_bytes"].append(None if payload is None else len(payload))
                out["payload_sha256"].append(None if payload is None else hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(None if payload is None else zlib.crc32(payload[-UNIT:]))
                out["feature"].append(None if payload is None else features(payload))
        return out

    return batch


def with_media(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """``df`` and, as its last column, FLAC streams of the whole texts. Null texts are empty ones (64 zero bytes).

    The column is called ``out``; where ``df`` has that name, underscores come in front.
    """
    return added(df, out, text_udf(df.sparkSession, _encode_batch, "media binary")(F.col(text))["media"])


def with_features(df: DataFrame, media: str = "media", out: str = "decoded") -> DataFrame:
    """``df`` and, last, a struct of digests and features of the samples read back; damaged streams fail the job, null ones give nulls.

    The column is called ``out``; where ``df`` has that name, underscores come in front.
    """
    fields = "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"
    return added(df, out, text_udf(df.sparkSession, _decode_batch, fields)(F.col(media)))


def pcm_blocks(df: DataFrame, id_col: str, media: str = "media") -> DataFrame:
    """One row for each decoded block: id, block, sample_offset, byte_offset (of its frame), n_samples, pcm.

    Null media give no rows.
    """
    prepare(df.sparkSession)
    source = df.select(F.col(id_col).alias("id"), F.col(media).alias("media")).where("media is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, stream in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                payload = decode([stream])[0]
                _, _, points, base = open_stream(stream)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key.as_py()] * len(points), type=batch.schema.field(0).type),
                        pa.array(range(len(points)), type=pa.int64()),
                        pa.array([p[0] for p in points], type=pa.int64()),
                        pa.array([base + p[1] for p in points], type=pa.int64()),
                        pa.array([p[2] for p in points], type=pa.int64()),
                        pa.array([payload[p[0] : p[0] + p[2]] for p in points], type=pa.binary()),
                    ],
                    names=["id", "block", "sample_offset", "byte_offset", "n_samples", "pcm"],
                )

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, block long, sample_offset long, byte_offset long, n_samples long, pcm binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: sizes, digests and features of every document as stored FLAC media, read back."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    stored = with_media(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "media")
    read = with_features(stored)
    return read.select("doc_id", "n_bytes", "decoded.payload_bytes", "decoded.payload_sha256", "decoded.tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "decoded.feature")
