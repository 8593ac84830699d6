"""FLAC media columns: lossless storage of 8-bit samples, decoded to seekable PCM blocks.

Streams are written mono, 8 bits, with frames of 576 samples. Every frame is
coded by the smallest of: a constant, a fixed linear predictor of order 0 to 2,
a quantised linear predictor (of order ``LINEAR_ORDER``, up to 12) with Rice
residuals, or plain samples. The decoder reads mono streams of 8 bits with frames
of any size, fixed or varying: constants, plain samples, fixed predictors of
order 0 to 4, linear predictors up to order 32, and Rice partitions of any order
with both parameter sizes and escapes. Many frames of many streams are worked on
together: the i-th residual of all frames at once, then the i-th sample, so that
each step is one numpy operation.

A frame ends where the next header verifies and the frame's own checksum does:
bytes that only look like a header are passed over. Header and frame checksums,
seek points and the MD5 of all samples are verified; a stream that fails raises
``ValueError`` with the reason. Every frame is a PCM block: its first sample,
sample count, byte offset in the stream and PCM bytes, so a reader can seek to a
sample.

Rows: a null text is an empty payload, which is padded like any other; equal
texts give equal streams. A null stream has no blocks. Columns of the input named
like a result are replaced, others kept; repeated rows are each coded.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FRAME = 576
PAD = 255
RATE = 8000
LINEAR_ORDER = 4
_GROUP = 2048
_FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


def _crc_table(bits: int, polynomial: int) -> np.ndarray:
    table, top = np.arange(256, dtype=np.uint32) << (bits - 8), 1 << (bits - 1)
    for _ in range(8):
        table = np.where(table & top, (table << 1) ^ polynomial, table << 1) & ((1 << bits) - 1)
    return table.astype(np.uint32)


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def _crc(frames: list[bytes], bits: int) -> np.ndarray:
    """Checksums of many byte strings; leading zeros don't change them, so all are padded to one length."""
    table, width = (_CRC8, _CRC16)[bits == 16], max(map(len, frames), default=0)
    rows = np.frombuffer(b"".join(f.rjust(width, b"\0") for f in frames), np.uint8).reshape(len(frames), width)
    crc = np.zeros(len(frames), np.uint32)
    for column in np.ascontiguousarray(rows.T):
        crc = (crc << 8 & 0xFF00 if bits == 16 else 0) ^ table[(crc >> (bits - 8)) ^ column]
    return crc


def _coded_number(n: int) -> bytes:
    """A frame's number, in the format's UTF-8-like code."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x20
    while True:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        if n < limit:
            return bytes([(0xFF << (7 - len(tail))) & 0xFF | n, *reversed(tail)])
        limit >>= 1


def _residuals(x: np.ndarray, order: int) -> np.ndarray:
    for _ in range(order):
        x = x[:, 1:] - x[:, :-1]
    return x


def _linear(x: np.ndarray, order: int, precision: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(quantised coefficients, shift) of each frame, by autocorrelation and Levinson's recursion."""
    f = x.astype(float) * np.hanning(x.shape[1] + 2)[1:-1]
    r = np.stack([(f[:, : x.shape[1] - i] * f[:, i:]).sum(axis=1) for i in range(order + 1)], axis=1)
    a, error = np.zeros((len(x), order)), np.maximum(r[:, 0], 1e-9)
    for i in range(order):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / error
        a[:, :i] = a[:, :i] - k[:, None] * a[:, i - 1 :: -1][:, :i] if i else a[:, :i]
        a[:, i] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    largest = np.maximum(np.abs(a).max(axis=1), 1e-9)
    shift = np.clip(precision - 2 - np.floor(np.log2(largest)).astype(int), 0, 15)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -(1 << (precision - 1)), (1 << (precision - 1)) - 1).astype(np.int64), shift


def _predicted(x: np.ndarray, coefficients: np.ndarray, shift: np.ndarray) -> np.ndarray:
    order = coefficients.shape[1]
    total = sum(coefficients[:, j, None] * x[:, order - 1 - j : x.shape[1] - 1 - j] for j in range(order))
    return total >> shift[:, None]


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _subframes(x: np.ndarray, linear_order: int) -> list[bytes]:
    """The subframes of many frames, each ended with a whole byte."""
    n, size = x.shape
    options: list[tuple] = []
    cost = np.full(n, 8 + 8 * size)
    choice, best_k = np.full(n, -1), np.zeros(n, np.int32)
    coded = []
    candidates: list[tuple] = [("fixed", o, None, None) for o in range(3)]
    if linear_order:
        candidates.append(("linear", linear_order, *_linear(x, linear_order)))
    for kind, order, coefficients, shift in candidates:
        residual = _residuals(x, order) if kind == "fixed" else (x[:, order:] - _predicted(x, coefficients, shift)).astype(np.int32)
        u = _zigzag(residual)
        mean = u.mean(axis=1)
        near = np.floor(np.log2(np.maximum(mean, 1))).astype(np.int32)
        for k in (np.clip(near + d, 0, 14) for d in (-1, 0, 1)):
            bits = 8 + 8 * order + (9 + 12 * order if kind == "linear" else 0) + 10 + (u >> k[:, None]).sum(axis=1) + u.shape[1] * (k + 1)
            less = bits < cost
            cost[less], choice[less], best_k[less] = bits[less], len(options), k[less]
        options.append((kind, order, coefficients, shift))
        coded.append(u)
    choice[(x == x[:, :1]).all(axis=1)] = -2
    out: list[bytes] = [b""] * n
    for i in np.flatnonzero(choice == -2).tolist():
        out[i] = bytes([0, int(x[i, 0]) & 0xFF])
    for i in np.flatnonzero(choice == -1).tolist():
        out[i] = bytes([0x02]) + x[i].astype(np.int8).tobytes()
    for o, (kind, order, coefficients, shift) in enumerate(options):
        rows = np.flatnonzero(choice == o)
        if not len(rows):
            continue
        u, k = coded[o][rows], best_k[rows]
        head = [np.full((len(rows), 1), (8 + order if kind == "fixed" else 31 + order) << 1)]
        widths = [8]
        for j in range(order):
            head.append(x[rows, j : j + 1] & 0xFF)
            widths.append(8)
        if kind == "linear":
            head += [np.full((len(rows), 1), 11), (shift[rows, None] & 31)]
            widths += [4, 5]
            head += [coefficients[rows, j : j + 1] & 0xFFF for j in range(order)]
            widths += [12] * order
        head += [np.zeros((len(rows), 1), np.int64), k[:, None]]  # residual method and partition order, parameter
        widths += [6, 4]
        start = sum(widths)
        length = (u >> k[:, None]) + 1 + k[:, None]
        ends = start + np.cumsum(length, axis=1)
        total = (ends[:, -1] + 7) // 8 * 8
        base = np.cumsum(total) - total
        bits = np.zeros(int(total.sum()), np.uint8)
        at = 0
        for value, width in zip(head, widths):
            for b in range(width):
                bits[base + at + b] = value[:, 0] >> (width - 1 - b) & 1
            at += width
        stop = (base[:, None] + ends - k[:, None] - 1).ravel()
        bits[stop] = 1
        for kk in np.unique(k).tolist():
            same = np.repeat(k == kk, u.shape[1])
            where, low = stop[same], u.ravel()[same]
            for b in range(kk):
                bits[where + 1 + b] = low >> (kk - 1 - b) & 1
        data = np.packbits(bits).tobytes()
        for i, a, b in zip(rows.tolist(), (base // 8).tolist(), ((base + total) // 8).tolist()):
            out[i] = data[a:b]
    return out


def encode_streams(payloads: list[bytes], linear_order: int = LINEAR_ORDER) -> list[bytes]:
    """FLAC streams of payloads (8-bit unsigned, a positive multiple of 576 bytes each)."""
    counts = [len(p) // FRAME for p in payloads]
    x = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, FRAME)
    frames: list[bytes] = []
    for low in range(0, len(x), _GROUP):
        frames += _subframes(x[low : low + _GROUP].astype(np.int32) - 128, linear_order)
    # fixed block size, 576 samples, 8 kHz; one channel, 8 bits
    heads = [b"\xff\xf8\x24\x02" + _coded_number(i) for n in counts for i in range(n)]
    heads = [h + bytes([c]) for h, c in zip(heads, _crc(heads, 8).tolist())]
    frames = [h + f for h, f in zip(heads, frames)]
    for low in range(0, len(frames), _GROUP):
        part = frames[low : low + _GROUP]
        frames[low : low + _GROUP] = [f + int(c).to_bytes(2, "big") for f, c in zip(part, _crc(part, 16).tolist())]
    out, at = [], 0
    for payload, n in zip(payloads, counts):
        mine = frames[at : at + n]
        at += n
        sizes = [len(f) for f in mine]
        signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        packed = RATE << 44 | 0 << 41 | 7 << 36 | len(payload)
        info = FRAME.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(signed).digest()
        offsets = np.cumsum([0, *sizes[:-1]])
        points = b"".join(int(i * FRAME).to_bytes(8, "big") + int(offsets[i]).to_bytes(8, "big") + FRAME.to_bytes(2, "big") for i in range(0, n, 64))
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + b"".join(mine))
    return out


class _Bits:
    """Reads the same field of many frames at once; ``at`` holds a bit position for each frame."""

    def __init__(self, data: bytes, at: np.ndarray):
        self.bits = np.unpackbits(np.frombuffer(data + bytes(8), np.uint8))
        self.at = at
        ones = np.flatnonzero(self.bits)
        if not len(ones):
            ones = np.array([len(self.bits) - 1])
        self.next_one = np.full(len(self.bits), ones[-1], np.int32)
        self.next_one[: ones[-1] + 1] = np.repeat(ones.astype(np.int32), np.diff(ones, prepend=-1))
        padded = np.frombuffer(data + bytes(16), np.uint8).astype(np.uint64)
        self.window = np.zeros(len(data) + 8, np.uint64)  # the eight bytes from each byte on
        for i in range(8):
            self.window |= padded[i : i + len(data) + 8] << np.uint64(8 * (7 - i))

    def peek(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        word = self.window[np.minimum(at >> 3, len(self.window) - 1)] << (at & 7).astype(np.uint64)
        width = np.asarray(width, np.uint64)
        return np.where(width > 0, (word >> np.minimum(np.uint64(64) - width, np.uint64(63))), np.uint64(0)).astype(np.int64)

    def take(self, who: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        value = self.peek(self.at[who], width)
        self.at[who] += width
        return value


def _signed(x: np.ndarray, width: np.ndarray | int) -> np.ndarray:
    return np.where(x >> (width - 1) & 1, x - (np.int64(1) << width), x)


def _decode_subframes(data: bytes, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(samples, bit positions behind) of the subframes of ``size`` 8-bit samples that begin at these bit positions."""
    bits, n = _Bits(data, at.copy()), len(at)
    everyone = np.arange(n)
    kind = bits.take(everyone, 8)
    if (kind & 0x81).any():
        raise ValueError("FLAC: reserved or wasted bits in a subframe header")
    kind >>= 1
    x = np.zeros((n, size), np.int64)
    constant, plain = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if not ((kind < 2) | fixed | linear).all():
        raise ValueError("FLAC: reserved subframe type")
    x[constant] = _signed(bits.take(constant, 8), 8)[:, None]
    for i in range(size if len(plain) else 0):
        x[plain, i] = _signed(bits.take(plain, 8), 8)
    order = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    coded = np.flatnonzero(fixed | linear)
    if not len(coded):
        return x, bits.at
    for i in range(int(order.max())):
        who = coded[order[coded] > i]
        x[who, i] = _signed(bits.take(who, 8), 8)
    widest = max(int(order.max()), 1)
    coefficients, shift = np.zeros((n, widest), np.int64), np.zeros(n, np.int64)
    for o, c in _FIXED.items():
        coefficients[np.ix_(fixed & (order == o), range(o))] = c
    who = np.flatnonzero(linear)
    if len(who):
        precision = bits.take(who, 4) + 1
        if (precision == 16).any():
            raise ValueError("FLAC: reserved predictor precision")
        shift[who] = bits.take(who, 5)
        for i in range(int(order[who].max())):
            some = order[who] > i
            coefficients[who[some], i] = _signed(bits.take(who[some], precision[some]), precision[some])
    method = bits.take(coded, 2)
    if (method > 1).any():
        raise ValueError("FLAC: reserved residual coding")
    wide = np.zeros(n, np.int64)
    wide[coded] = 4 + method
    parts = np.zeros(n, np.int64)
    parts[coded] = size >> bits.take(coded, 4)
    k, raw = np.zeros(n, np.int64), np.full(n, -1)
    residual = np.zeros((n, size), np.int64)
    least = int(parts[coded].min())
    for i in range(size):
        begins = coded[i % parts[coded] == 0] if i % least == 0 else coded[:0]
        if len(begins):
            k[begins] = bits.take(begins, wide[begins])
            escaped = begins[k[begins] == (1 << wide[begins]) - 1]
            raw[begins] = -1
            if len(escaped):
                raw[escaped] = bits.take(escaped, 5)
        who = coded[order[coded] <= i] if i < widest else coded
        plainly = raw[who] >= 0
        if plainly.any():
            some = who[plainly]
            value = bits.take(some, raw[some])
            residual[some, i] = np.where(raw[some] > 0, _signed(value, np.maximum(raw[some], 1)), 0)
            who = who[~plainly]
        here = bits.at[who]
        stop = bits.next_one[np.minimum(here, len(bits.bits) - 1)]
        low = bits.peek(stop + 1, k[who])
        bits.at[who] = stop + 1 + k[who]
        u = (stop - here) << k[who] | low
        residual[who, i] = (u >> 1) ^ -(u & 1)
    for o in np.unique(order[coded]).tolist():
        rows = coded[(order[coded] == o) & fixed[coded]]
        if len(rows):  # a fixed predictor undoes as many differences
            y = residual[rows]
            y[:, :o] = x[rows, :o]
            for level in range(o, 0, -1):
                head = y[:, :o].copy()
                for _ in range(level - 1):
                    head = np.diff(head, axis=1)
                start = head[:, :1]
                y = np.concatenate((y[:, : level - 1], start, y[:, level:]), axis=1)
                y[:, level - 1 :] = np.cumsum(y[:, level - 1 :], axis=1)
                y[:, : level - 1] = x[rows, : level - 1]
            x[rows] = y
        rows = coded[(order[coded] == o) & linear[coded]]
        if len(rows):
            c, y, moved = np.ascontiguousarray(coefficients[rows, :o].T), np.ascontiguousarray(residual[rows].T), shift[rows]
            y[:o] = x[rows, :o].T
            for i in range(o, size):
                total = c[0] * y[i - 1]
                for j in range(1, o):
                    total += c[j] * y[i - 1 - j]
                y[i] += total >> moved
            x[rows] = y.T
    return x, bits.at


def _read_info(stream: bytes) -> tuple[int, int, bytes, list[tuple[int, int]], int]:
    """(smallest frame, samples, MD5, seek points as (sample, offset), where frames begin) of one stream."""
    if stream[:4] != b"fLaC":
        raise ValueError("FLAC: no stream marker")
    at, info, points, last = 4, None, [], False
    while not last:
        if at + 4 > len(stream):
            raise ValueError("FLAC: the stream ends within its metadata")
        kind, length = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + length]
        if len(body) < length:
            raise ValueError("FLAC: the stream ends within its metadata")
        if kind & 0x7F == 0:
            info = body
        elif kind & 0x7F == 3:
            points = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big")) for i in range(0, length - 17, 18)]
        at += 4 + length
        last = bool(kind & 0x80)
    if info is None or len(info) < 34:
        raise ValueError("FLAC: no stream information")
    packed = int.from_bytes(info[10:18], "big")
    if packed >> 41 & 7 or (packed >> 36 & 31) != 7:
        raise ValueError("FLAC: only streams of one channel and 8 bits are read")
    return int.from_bytes(info[0:2], "big"), packed & (1 << 36) - 1, info[18:34], [p for p in points if p[0] != (1 << 64) - 1], at


#: Samples of a frame by their code, where the code tells them. Fixed values of the format.
_SIZES = {1: 192, **{i: 576 << (i - 2) for i in range(2, 6)}, **{i: 256 << (i - 8) for i in range(8, 16)}}


def _header(stream: bytes, at: int) -> tuple[int, int, int, bool] | None:
    """(samples, number, length of the header, whether the number counts samples) of the frame header at ``at``; None if there is none."""
    head = stream[at : at + 16]
    if len(head) < 6 or head[0] != 0xFF or head[1] & 0xFE != 0xF8 or head[3] & 0xF1 or head[3] >> 1 not in (0, 1):
        return None
    lead = 8 - (~head[4] & 0xFF).bit_length()  # ones that lead the number's first byte
    extra = max(0, lead - 1)
    if lead == 1 or lead == 8 or len(head) < 6 + extra or any(b >> 6 != 2 for b in head[5 : 5 + extra]):
        return None
    number = head[4] & (0x7F >> lead)
    for b in head[5 : 5 + extra]:
        number = number << 6 | b & 0x3F
    end = 5 + extra
    code = head[2] >> 4
    if code in (6, 7):
        size = int.from_bytes(head[end : end + code - 5], "big") + 1
        end += code - 5
    else:
        size = _SIZES.get(code, 0)
    end += {12: 1, 13: 2, 14: 2}.get(head[2] & 15, 0)
    if not size or head[2] & 15 == 15 or end >= len(head) or _crc8(head[: end + 1]):
        return None
    return size, number, end + 1, bool(head[1] & 1)


class _Frame:
    __slots__ = ("begin", "end", "size", "head")

    def __init__(self, begin: int, end: int, size: int, head: int):
        self.begin, self.end, self.size, self.head = begin, end, size, head


def _frames(stream: bytes, at: int, samples: int, checked: bool = False) -> list[_Frame]:
    """The frames of a stream by their headers; ``checked``: a frame's own checksum must be right where it is ended, too."""
    out: list[_Frame] = []
    done, number, same = 0, 0, b""
    while done < samples:
        found = _header(stream, at)
        if not found:
            raise ValueError("FLAC: a frame header is missing or fails its checksum")
        size, told, length, varying = found
        if told != (done if varying else number):
            raise ValueError("FLAC: a frame is missing")
        done, number = done + size, number + 1
        end, from_ = len(stream), at + length
        while done < samples:
            follows = _coded_number(done if varying else number)
            same = stream[at : at + 4] + follows  # most often the next header is like this one
            end = stream.find(same, from_) if stream[at + 2] >> 4 not in (6, 7) else -1
            if end < 0 or checked:
                end = stream.find(stream[at : at + 2], from_)
            if end < 0:
                raise ValueError("FLAC: a frame header is missing or fails its checksum")
            then = _header(stream, end)
            if then and then[1] == (done if varying else number) and not (checked and _crc([stream[at:end]], 16).any()):
                break
            from_ = end + 1
        out.append(_Frame(at, end, size, length))
        at = end
    return out


def _decoded(streams: list[bytes], frames: list[list[_Frame]]) -> list[list[bytes]] | int:
    """The PCM bytes of every frame of every stream; or the place of a stream whose frames don't verify."""
    flat = [(i, j) for i, some in enumerate(frames) for j in range(len(some))]
    pcm: list[list[bytes]] = [[b""] * len(some) for some in frames]
    flat.sort(key=lambda p: frames[p[0]][p[1]].size)  # stable: frames of one size stand together
    low = 0
    while low < len(flat):
        size = frames[flat[low][0]][flat[low][1]].size
        most = max(1, _GROUP * FRAME // size)
        part = [p for p in flat[low : low + most] if frames[p[0]][p[1]].size == size]
        low += len(part)
        mine = [frames[i][j] for i, j in part]
        some = [streams[i][f.begin : f.end] for (i, _), f in zip(part, mine)]
        wrong = np.flatnonzero(_crc(some, 16))  # a frame with its own checksum behind it leaves nothing
        if len(wrong):
            return part[wrong[0]][0]
        begin = np.cumsum([0, *map(len, some)])
        x, end = _decode_subframes(b"".join(some), (begin[:-1] + [f.head for f in mine]) * 8, size)
        wrong = np.flatnonzero((end + 7) // 8 != begin[1:] - 2)
        if len(wrong):
            return part[wrong[0]][0]
        data = (x + 128).astype(np.uint8).tobytes()
        for k, (i, j) in enumerate(part):
            pcm[i][j] = data[k * size : (k + 1) * size]
    return pcm


def decode_blocks(streams: list[bytes]) -> list[list[tuple[int, int, int, bytes]]]:
    """(first sample, samples, byte offset, PCM as 8-bit unsigned bytes) of every frame of each stream, all checksums verified.

    The frames of all streams are decoded side by side. Where a frame doesn't verify, its stream is looked through again
    for headers that stand behind a right checksum: bytes within a frame may look like a header.
    """
    infos = [_read_info(s) for s in streams]
    frames, checked = [_frames(s, at, samples) for s, (_, samples, _, _, at) in zip(streams, infos)], set()
    while isinstance(pcm := _decoded(streams, frames), int):
        if pcm in checked:
            raise ValueError("FLAC: a frame fails its checksum or has a wrong length")
        checked.add(pcm)
        frames[pcm] = _frames(streams[pcm], infos[pcm][4], infos[pcm][1], True)
    out = []
    for (_, samples, md5, points, at), some, blocks in zip(infos, frames, pcm):
        firsts = np.cumsum([0, *(f.size for f in some)])[:-1].tolist()
        offset = {first: f.begin - at for first, f in zip(firsts, some)}
        if any(offset.get(sample) != place for sample, place in points):
            raise ValueError("FLAC: a seek point is wrong")
        signed = np.frombuffer(b"".join(blocks), np.uint8) ^ 0x80
        if md5 != bytes(16) and hashlib.md5(signed.tobytes()).digest() != md5:
            raise ValueError("FLAC: the samples' MD5 differs")
        out.append([(first, f.size, f.begin, data) for first, f, data in zip(firsts, some, blocks)])
    return out


def decode_streams(streams: list[bytes]) -> list[bytes]:
    """All samples of each stream as 8-bit unsigned bytes."""
    return [b"".join([data for *_, data in blocks]) for blocks in decode_blocks(streams)]


def _crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = _CRC8_LIST[crc ^ b]
    return crc


_CRC8_LIST = _CRC8.tolist()


def payload_of(text: str | None) -> bytes:
    """A text's UTF-8 bytes, with bytes 255 up to a positive multiple of 576."""
    data = (text or "").encode("utf-8", "replace")
    return data.ljust(max(1, -(-len(data) // FRAME)) * FRAME, bytes([PAD]))


def _runs(sizes: list[int], most: int = 2 << 20) -> Iterator[slice]:
    begin = held = 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > most:
            yield slice(begin, i)
            begin, held = i, 0
        held += n
    if sizes:
        yield slice(begin, len(sizes))


def encode_texts(docs: DataFrame, text: str = "text", linear_order: int = LINEAR_ORDER) -> DataFrame:
    """``docs`` with ``n_bytes`` and ``media`` binary instead of ``text``; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf[text]]
            for part in _runs([len(t) for t in texts]):
                payloads = [payload_of(t) for t in texts[part]]
                yield pdf.drop(columns=text)[part].assign(n_bytes=[len(t.encode("utf-8", "replace")) for t in texts[part]], media=encode_streams(payloads, linear_order))

    docs = docs.drop(*{"n_bytes", "media"} - {text})
    return docs.mapInPandas(run, docs.drop(text).schema.add("n_bytes", "long").add("media", "binary"))


def pcm_blocks(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, frame, first_sample, n_samples, byte_offset, pcm): every frame of every stream, ready for seeking."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["media"].notna()]
            for part in _runs([len(m) for m in pdf["media"]]):
                for k, blocks in zip(pdf[key][part], decode_blocks(pdf["media"][part].tolist())):
                    first, n, offset, pcm = zip(*blocks) if blocks else ((),) * 4
                    yield pd.DataFrame({key: [k] * len(blocks), "frame": np.arange(len(blocks)), "first_sample": first, "n_samples": n, "byte_offset": offset, "pcm": pcm})

    return media.select(key, "media").mapInPandas(run, f"{key} {media.schema[key].dataType.simpleString()}, frame long, first_sample long, n_samples long, byte_offset long, pcm binary")


def features(blocks: list[tuple[int, int, int, bytes]]) -> str:
    """Of a stream's blocks: samples, peak, sum, energy and zero crossings in whole numbers, blocks and where the last begins."""
    x = np.frombuffer(b"".join([data for *_, data in blocks]), np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"n={len(x)};peak={int(np.abs(x).max(initial=0))};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings};blocks={len(blocks)};last={blocks[-1][0] if blocks else 0}@{blocks[-1][2] if blocks else 0}"


def _facts(stored: list[bytes]) -> dict[str, list]:
    decoded = decode_blocks(stored)
    payloads = [b"".join([data for *_, data in blocks]) for blocks in decoded]
    return {
        "payload_bytes": [len(p) for p in payloads],
        "payload_sha256": [hashlib.sha256(p).hexdigest() for p in payloads],
        "tail_crc32": [zlib.crc32(p[-32:]) for p in payloads],
        "media_bytes": [len(m) for m in stored],
        "media_sha256": [hashlib.sha256(m).hexdigest() for m in stored],
        "feature": [features(blocks) for blocks in decoded],
    }


FACTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of stored streams (null ones left out)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["media"].notna()]
            for part in _runs([len(m) for m in pdf["media"]]):
                yield pd.DataFrame({key: pdf[key][part], "n_bytes": pdf["n_bytes"][part]} | _facts(pdf["media"][part].tolist()))

    return media.select(key, "n_bytes", "media").mapInPandas(run, f"{key} {media.schema[key].dataType.simpleString()}, n_bytes long, {FACTS}")


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``read_back`` of ``encode_texts``, in one pass of one Python worker a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf[text]]
            for part in _runs([len(t) for t in texts]):
                stored = encode_streams([payload_of(t) for t in texts[part]])
                yield pd.DataFrame({key: pdf[key][part], "n_bytes": [len(t.encode("utf-8", "replace")) for t in texts[part]]} | _facts(stored))

    return docs.select(key, text).mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, n_bytes long, {FACTS}")
