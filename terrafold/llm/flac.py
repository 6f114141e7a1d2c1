"""FLAC streams: an encoder and a decoder over numpy arrays.

The decoder reads any subset-conforming stream: constant, verbatim, fixed and linear-prediction subframes, Rice
residuals with both parameter widths and escapes, wasted bits, all channel layouts. It verifies the CRC of every
frame header and frame, the MD5 of the samples, and that frames lie where the seek table says. Linear predictors run over many
frames at once, a sample of each at a time. The encoder writes a fixed predictor of order 0 to 4 or, up to ``lpc_order``,
linear prediction, whichever has the smaller residual, and a seek table with the first sample and the byte offset of
every frame; ``read`` gets any range of samples by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np

BLOCK = 4096
#: Fixed predictors of the format, by order.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
_REACH = 4096


class Damaged(ValueError):
    """A stream that breaks the format or fails a checksum."""


@lru_cache(None)
def _crc_table(poly: int, bits: int) -> np.ndarray:
    """Row d: the checksum of each byte when d zero bytes follow it. A CRC is linear, so a message's is the XOR of these."""
    mask, top = (1 << bits) - 1, 1 << (bits - 1)
    table = np.zeros((_REACH, 256), np.uint16)
    step = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        step = ((step << 1) ^ np.where(step & top, poly, 0)) & mask
    table[0] = step
    for d in range(1, _REACH):
        last = table[d - 1].astype(np.uint32)
        table[d] = ((last << 8) & mask) ^ step[last >> (bits - 8)]
    return table


def crc(data: np.ndarray, poly: int, bits: int) -> int:
    table, state = _crc_table(poly, bits), 0
    for i in range(0, len(data), _REACH):
        part = data[i : i + _REACH]
        if state:  # the state so far acts like bytes before the part
            part = part.copy()
            if bits == 16:
                part[0] ^= state >> 8
                if len(part) > 1:
                    part[1] ^= state & 255
            else:
                part[0] ^= state
        extra = (state & 255) << 8 if state and bits == 16 and len(part) == 1 else 0
        state = int(np.bitwise_xor.reduce(table[np.arange(len(part) - 1, -1, -1), part])) ^ extra
    return state


def crc8(data: np.ndarray) -> int:
    return crc(data, 0x07, 8)


def crc16(data: np.ndarray) -> int:
    return crc(data, 0x8005, 16)


def _bits(value: int, n: int) -> np.ndarray:
    return np.array([value >> i & 1 for i in range(n - 1, -1, -1)], np.uint8)


def _rows(values: np.ndarray, n: int) -> np.ndarray:
    """The n low bits of each value, highest first, one value after the other."""
    return ((values[:, None] >> np.arange(n - 1, -1, -1)) & 1).astype(np.uint8).ravel()


def _utf8(n: int) -> bytes:
    """The extended UTF-8 coding of frame numbers (up to 36 bits)."""
    if n < 0x80:
        return bytes([n])
    more = 1
    while n >> (6 * more + 6 - more):
        more += 1
    lead = (0xFF << (7 - more)) & 0xFF
    return bytes([lead | n >> 6 * more, *(0x80 | n >> 6 * i & 0x3F for i in range(more - 1, -1, -1))])


def _rice_bits(residual: np.ndarray) -> tuple[int, np.ndarray]:
    """Parameter and bits of a Rice partition."""
    folded = np.where(residual >= 0, 2 * residual, -2 * residual - 1)
    mean = folded.mean() if len(folded) else 0
    k = min(14, max(0, int(mean).bit_length() - 1))
    high = folded >> k
    ends = np.cumsum(high + (1 + k))
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    stop = ends - (1 + k)
    out[stop] = 1
    for i in range(k):
        out[stop + 1 + i] = folded >> (k - 1 - i) & 1
    return k, out


@lru_cache(256)
def _bell(n: int) -> np.ndarray:
    return np.hanning(n + 2)[1:-1]


def _lpc(samples: np.ndarray, order: int, precision: int = 12) -> tuple[np.ndarray, int] | None:
    """Quantised coefficients and shift by Levinson's recursion over a windowed autocorrelation."""
    x = samples * _bell(len(samples))
    r = np.array([x[: len(x) - i] @ x[i:] for i in range(order + 1)])
    if r[0] <= 0:
        return None
    a, error = np.zeros(0), r[0]
    for i in range(order):
        k = (r[i + 1] - a @ r[i:0:-1][: len(a)]) / error
        a = np.append(a - k * a[::-1], k)
        error *= 1 - k * k
        if error <= 0:
            return None
    shift = min(14, max(0, precision - 1 - int(np.ceil(np.log2(np.abs(a).max() + 1e-12) + 1e-9))))
    coefficients = np.clip(np.rint(a * (1 << shift)), -(1 << precision - 1), (1 << precision - 1) - 1).astype(np.int64)
    return coefficients, shift


def _cost(total: int, n: int) -> float:
    """About the bits of n residuals whose magnitudes sum up to ``total``."""
    k = max(0, int(2 * total / max(1, n)).bit_length() - 1)
    return n * (k + 1) + 2 * total / (1 << k)


def _subframe(x: np.ndarray, bps: int, lpc_order: int) -> np.ndarray:
    if (x == x[0]).all():
        return np.concatenate([_bits(0, 8), _rows(x[:1], bps)])
    best, residual, smallest, warm = 0, x, int(np.abs(x).sum()), x
    for order in range(1, min(5, len(x))):
        warm = np.diff(warm)
        if (total := int(np.abs(warm).sum())) < smallest:
            best, residual, smallest = order, warm, total
    head = [_bits((8 + best) << 1, 8), _rows(x[:best], bps)]
    if 0 < lpc_order < len(x) and (found := _lpc(x.astype(float), lpc_order)):
        coefficients, shift = found
        said = coefficients[0] * x[lpc_order - 1 : -1]
        for i in range(1, lpc_order):
            said = said + coefficients[i] * x[lpc_order - 1 - i : -1 - i]
        other = x[lpc_order:] - (said >> shift)
        if _cost(int(np.abs(other).sum()), len(other)) + lpc_order * (bps + 12) + 9 < _cost(smallest, len(residual)) + best * bps:
            residual = other
            head = [_bits((32 + lpc_order - 1) << 1, 8), _rows(x[:lpc_order], bps), _bits(11, 4), _bits(shift, 5), _rows(coefficients, 12)]
    k, codes = _rice_bits(residual)
    if sum(map(len, head)) + len(codes) + 10 >= len(x) * bps + 8:
        return np.concatenate([_bits(2, 8), _rows(x, bps)])
    return np.concatenate([*head, _bits(0, 6), _bits(k, 4), codes])


def encode(samples: np.ndarray, bps: int = 8, rate: int = 8000, block: int = BLOCK, lpc_order: int = 0) -> bytes:
    """A stream of signed samples, shape (n,) or (n, channels), n at least 16."""
    samples = samples.reshape(len(samples), -1).astype(np.int64)
    n, channels = samples.shape
    code = {8: 1, 12: 2, 16: 4, 20: 5, 24: 6}.get(bps, 0)
    frames = []
    for number, at in enumerate(range(0, n, block)):
        part = samples[at : at + block]
        head = bytes([0xFF, 0xF8, 0x70, (channels - 1) << 4 | code << 1]) + _utf8(number) + (len(part) - 1).to_bytes(2, "big")
        head += bytes([crc8(np.frombuffer(head, np.uint8))])
        body = np.packbits(np.concatenate([_subframe(part[:, c], bps, lpc_order) for c in range(channels)]))
        frame = np.concatenate([np.frombuffer(head, np.uint8), body])
        frames.append(frame.tobytes() + crc16(frame).to_bytes(2, "big"))
    sizes = list(map(len, frames))
    md5 = hashlib.md5(samples.astype("<i1" if bps <= 8 else "<i2").tobytes() if bps <= 16 else _wide(samples, bps)).digest()
    info = min(block, n).to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (rate << 44 | (channels - 1) << 41 | (bps - 1) << 36 | n).to_bytes(8, "big") + md5
    seek, at = b"", 0
    for number, length in enumerate(sizes):
        seek += (number * block).to_bytes(8, "big") + at.to_bytes(8, "big") + min(block, n - number * block).to_bytes(2, "big")
        at += length
    return b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(seek).to_bytes(3, "big") + seek + b"".join(frames)


def _wide(samples: np.ndarray, bps: int) -> bytes:
    width = -(-bps // 8)
    return samples.astype("<i8").reshape(-1, 1).view(np.uint8)[:, :width].tobytes()


@dataclass
class Info:
    block: int
    largest: int
    rate: int
    channels: int
    bps: int
    n: int
    md5: bytes
    seek: list[tuple[int, int, int]]
    first: int


def info(data: bytes) -> Info:
    """The stream's description: where frames begin, and the seek points (sample, byte offset, samples)."""
    if data[:4] != b"fLaC":
        raise Damaged("no FLAC stream")
    at, last, found, seek = 4, False, None, []
    while not last:
        if at + 4 > len(data):
            raise Damaged("cut short")
        last, kind, n = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        part = data[at + 4 : at + 4 + n]
        if kind == 0:
            x = int.from_bytes(part[10:18], "big")
            found = (int.from_bytes(part[2:4], "big"), int.from_bytes(part[7:10], "big"), x >> 44, (x >> 41 & 7) + 1, (x >> 36 & 31) + 1, x & (1 << 36) - 1, part[18:34])
        elif kind == 3:
            seek = [tuple(int.from_bytes(part[i + a : i + b], "big") for a, b in ((0, 8), (8, 16), (16, 18))) for i in range(0, n, 18)]
        at += 4 + n
    if found is None:
        raise Damaged("no stream description")
    return Info(*found, seek, at)


@dataclass
class Predicted:
    """A subframe whose samples are still to be predicted."""

    warm: np.ndarray
    coefficients: np.ndarray
    shift: int
    residual: np.ndarray
    wasted: int
    samples: np.ndarray | None = None


def predict(parts: list[Predicted], together: int = 512) -> None:
    """Give all parts their samples: a step makes the next sample of up to ``together`` parts."""
    parts = sorted(parts, key=lambda p: -len(p.residual))
    for begin in range(0, len(parts), together):
        some = parts[begin : begin + together]
        order, longest, m = max(len(p.warm) for p in some), len(some[0].residual), len(some)
        out, weight = np.zeros((order + longest, m), np.int64), np.zeros((order, m), np.int64)
        for i, p in enumerate(some):
            k = len(p.warm)
            out[order - k : order, i], weight[order - k :, i] = p.warm, p.coefficients[::-1]
            out[order : order + len(p.residual), i] = p.residual
        shift = np.array([p.shift for p in some], np.int64)
        lengths = np.array([len(p.residual) for p in some])
        active = m - np.searchsorted(lengths[::-1], np.arange(1, longest + 1), "left")  # those with a residual left
        for t, n in enumerate(active.tolist()):
            said = np.einsum("ij,ij->j", out[t : t + order, :n], weight[:, :n])
            out[t + order, :n] += said >> shift[:n]
        for i, p in enumerate(some):
            p.samples = out[order - len(p.warm) : order + len(p.residual), i] << p.wasted


class _Reader:
    """Bits of one frame."""

    def __init__(self, data: np.ndarray):
        self.bits, self.at = np.unpackbits(data), 0

    def take(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise Damaged("cut short")
        value = 0
        for bit in self.bits[self.at : self.at + n].tolist():
            value = value << 1 | bit
        self.at += n
        return value

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def many(self, count: int, n: int) -> np.ndarray:
        """``count`` signed numbers of n bits."""
        if self.at + count * n > len(self.bits):
            raise Damaged("cut short")
        if not n:
            return np.zeros(count, np.int64)
        rows = self.bits[self.at : self.at + count * n].reshape(count, n).astype(np.int64)
        self.at += count * n
        value = rows @ (np.int64(1) << np.arange(n - 1, -1, -1))
        return value - (rows[:, 0] << n)

    def rice(self, count: int, k: int) -> np.ndarray:
        """``count`` residuals: each a run of zeros, a one, and k bits.

        The one that ends a run is known from the one before it: it is the first after that one's k bits. Following
        that relation from the first, with jumps of doubling length, finds all of them without a loop over samples.
        """
        if not count:
            return np.empty(0, np.int64)
        bits = self.bits[self.at :]
        ones = np.flatnonzero(bits)
        seen = np.cumsum(bits, dtype=np.int32)
        jump = seen[np.minimum(ones + k, len(bits) - 1)]  # index of the first one after the k bits
        jump = np.append(np.minimum(jump, len(ones)), len(ones))  # the last entry stands for the end
        path = np.zeros(1, np.int64)
        while len(path) < count:
            path = np.concatenate([path, jump[path[: count - len(path)]]])
            jump = jump[jump]
        if not len(ones) or path[-1] >= len(ones):
            raise Damaged("cut short")
        stop = ones[path]
        if stop[-1] + k >= len(bits):
            raise Damaged("cut short")
        high = np.diff(stop, prepend=-1 - k) - 1 - k
        low = np.zeros(count, np.int64)
        for i in range(k):
            low = low << 1 | bits[stop + 1 + i]
        folded = high << k | low
        self.at += int(stop[-1]) + 1 + k
        return folded >> 1 ^ -(folded & 1)

    def residual(self, n: int, order: int) -> np.ndarray:
        width, parts = (4, 5)[self.take(2) & 1], self.take(4)
        each, out = n >> parts, []
        if each << parts != n or each < order:
            raise Damaged("a partition that doesn't fit its block")
        for i in range(1 << parts):
            count, k = each - order * (i == 0), self.take(width)
            if k == (1 << width) - 1:
                out.append(self.many(count, self.take(5)))
            else:
                out.append(self.rice(count, k))
        return np.concatenate(out)

    def subframe(self, n: int, bps: int) -> np.ndarray | Predicted:
        if self.take(1):
            raise Damaged("no subframe")
        kind, wasted = self.take(6), 0
        if self.take(1):
            wasted = 1
            while not self.take(1):
                wasted += 1
        bps -= wasted
        if kind == 0:
            x = np.full(n, self.signed(bps), np.int64)
        elif kind == 1:
            x = self.many(n, bps)
        elif 8 <= kind <= 12:
            order = kind - 8
            warm = self.many(order, bps)
            x = self.residual(n, order)
            # The predictor of order p says that the p-th difference is the residual: sum it up p times.
            for level in range(order, 0, -1):
                lead = np.diff(warm, level - 1)[:1]
                x = np.cumsum(np.concatenate([lead, x]))
        elif kind >= 32:
            order = kind - 31
            warm, precision, shift = self.many(order, bps), self.take(4) + 1, self.signed(5)
            coefficients = self.many(order, precision)
            return Predicted(warm, coefficients, max(0, shift), self.residual(n, order), wasted)
        else:
            raise Damaged("a reserved subframe")
        return x << wasted


@dataclass
class Frame:
    """A frame whose checksums are right: its first sample, byte offset, layout of channels and subframes."""

    first: int
    at: int
    n: int
    layout: int
    parts: list

    def samples(self) -> np.ndarray:
        x = [p.samples if isinstance(p, Predicted) else p for p in self.parts]
        if self.layout == 8:
            x[1] = x[0] - x[1]
        elif self.layout == 9:
            x[0] = x[0] + x[1]
        elif self.layout == 10:
            middle = x[0] << 1 | x[1] & 1
            x = [middle + x[1] >> 1, middle - x[1] >> 1]
        return np.stack(x, 1)


def parsed(data: bytes, stream: Info | None = None, at: int | None = None) -> Iterator[Frame]:
    """The frames of a stream from byte ``at`` on, before prediction; every checksum is verified, and every seek point."""
    stream = stream or info(data)
    raw, start = np.frombuffer(data, np.uint8), stream.first if at is None else at
    points = {offset: first for first, offset, _ in stream.seek}
    while start < len(raw):
        head = raw[start : start + 16].tolist()
        if len(head) < 6 or head[0] != 0xFF or head[1] & 0xFE != 0xF8:
            raise Damaged("no frame")
        size_code, rate_code, layout, depth = head[2] >> 4, head[2] & 15, head[3] >> 4, head[3] >> 1 & 7
        more, lead = 0, head[4]
        while lead & 0x80 and lead >> (6 - more) & 1:
            more += 1
        number = lead & ((0x7F if not more else 0x3F) >> more)
        for b in head[5 : 5 + more]:
            number = number << 6 | b & 0x3F
        at = 5 + more
        if size_code == 0:
            raise Damaged("a reserved block size")
        n = 192 if size_code == 1 else 576 << (size_code - 2) if size_code < 6 else 256 << max(0, size_code - 8)
        if size_code in (6, 7):
            width = size_code - 5
            n, at = int.from_bytes(bytes(head[at : at + width]), "big") + 1, at + width
        at += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
        if at >= len(head) or crc8(raw[start : start + at]) != head[at]:
            raise Damaged("checksum of a frame header")
        bps = {0: stream.bps, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}.get(depth)
        if bps is None or layout > 10:
            raise Damaged("a reserved layout")
        limit = start + stream.largest if stream.largest else len(raw)
        reader = _Reader(raw[start + at + 1 : limit])
        if layout < 8:
            parts = [reader.subframe(n, bps) for _ in range(layout + 1)]
        else:  # one channel is a difference, which takes a bit more
            parts = [reader.subframe(n, bps + (layout == 9)), reader.subframe(n, bps + (layout != 9))]
        end = start + at + 1 + -(-reader.at // 8)
        if end + 2 > len(raw) or crc16(raw[start:end]) != int.from_bytes(raw[end : end + 2].tobytes(), "big"):
            raise Damaged("checksum of a frame")
        first, offset = number if head[1] & 1 else number * stream.block, start - stream.first
        if points.get(offset, first) != first:
            raise Damaged("a seek point that leads elsewhere")
        yield Frame(first, offset, n, layout, parts)
        start = end + 2


def _predicted(found: list[Frame]) -> list[Frame]:
    predict([p for frame in found for p in frame.parts if isinstance(p, Predicted)])
    return found


def frames(data: bytes, stream: Info | None = None, at: int | None = None, together: int = 64) -> Iterator[tuple[int, int, np.ndarray]]:
    """First sample, byte offset and samples (n, channels) of each frame, from byte ``at`` on; ``together`` are in memory."""
    source = parsed(data, stream, at)
    while found := list(islice(source, together)):
        for frame in _predicted(found):
            yield frame.first, frame.at, frame.samples()


def read(data: bytes, first: int, count: int) -> np.ndarray:
    """``count`` samples from ``first`` on: only the frames that hold them are decoded, found by the seek table."""
    stream = info(data)
    before = [(sample, offset) for sample, offset, _ in stream.seek if sample <= first]
    out = []
    for at, _, x in frames(data, stream, stream.first + max(before, default=(0, 0))[1], together=1):
        out.append(x[max(0, first - at) : max(0, first + count - at)])
        if at + len(x) >= first + count:
            break
    return np.concatenate(out) if out else np.empty((0, stream.channels), np.int64)


def decode_many(streams: list[bytes]) -> list[np.ndarray]:
    """All samples (n, channels) of each stream; the MD5 of the samples is verified where a stream has one."""
    about = [info(data) for data in streams]
    found = [list(parsed(data, stream)) for data, stream in zip(streams, about)]
    _predicted([frame for own in found for frame in own])
    out = []
    for own, stream in zip(found, about):
        samples = np.concatenate([frame.samples() for frame in own]) if own else np.empty((0, stream.channels), np.int64)
        if stream.n and len(samples) != stream.n:
            raise Damaged("number of samples")
        if any(stream.md5) and hashlib.md5(_wide(samples, stream.bps)).digest() != stream.md5:
            raise Damaged("checksum of the samples")
        out.append(samples)
    return out


def decode(data: bytes) -> np.ndarray:
    return decode_many([data])[0]
