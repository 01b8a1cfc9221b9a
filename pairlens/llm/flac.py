"""FLAC for 8-bit mono samples: many frames are coded and decoded side by side, a sample of each at a time.

The stream format is that of RFC 9639. The encoder writes fixed block sizes, constant, verbatim, fixed and linear
predictor subframes, four Rice partitions, and a seek table with a point for each frame. The decoder takes any Rice
partitions, escapes, fixed orders and linear predictors of 8-bit mono streams, and checks both checksums of each frame
and the digest of the samples.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

#: Samples of a block, linear predictor order, its precision and shift in bits, frames coded at a time.
BLOCK, ORDER, PRECISION, SHIFT, FRAMES = 1024, 4, 13, 10, 2048
PARTITIONS = 2  # as a power of two


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for v in range(256):
        v <<= bits - 8
        for _ in range(8):
            v = ((v << 1) ^ poly if v & top else v << 1) & mask
        out.append(v)
    return np.array(out, np.uint16)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


@lru_cache(100_000)
def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(_CRC8[c ^ b])
    return c


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each slice of ``data``, byte by byte over all slices at once."""
    size = ends - starts
    down = np.argsort(-size, kind="stable")
    at, live = starts[down], np.searchsorted(-size[down], -np.arange(int(size.max(initial=0))), "left")
    c = np.zeros(len(size), np.uint16)
    for j, m in enumerate(live.tolist()):
        h = c[:m]
        c[:m] = (h << np.uint16(8)) ^ _CRC16[(h >> np.uint16(8)) ^ data[at[:m] + j]]
    out = np.empty_like(c)
    out[down] = c
    return out


@lru_cache(100_000)
def _header(number: int, size: int) -> bytes:
    """A frame header: fixed blocks, 16-bit block size, rate from the stream, mono, 8 bits."""
    if number < 128:
        coded = bytes([number])
    else:
        n = next(k for k in range(2, 8) if number < 1 << (5 * k + 1))
        coded = bytes([((0xFF << (8 - n)) & 0xFF) | (number >> (6 * (n - 1)))] + [0x80 | ((number >> (6 * i)) & 0x3F) for i in range(n - 2, -1, -1)])
    head = b"\xff\xf8\x70\x02" + coded + (size - 1).to_bytes(2, "big")
    return head + bytes([crc8(head)])


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _predictors(x: np.ndarray, inside: np.ndarray):
    """For rows of samples: (kind, order, residual), cheapest by sum of magnitudes; kind 0 fixed, 1 linear."""
    n, width = x.shape
    best, kind, order, chosen = None, np.zeros(n, np.int64), np.zeros(n, np.int64), x.copy()
    d = x.copy()
    for o in range(3):
        if o:
            d = np.concatenate([d[:, :o], d[:, o:] - d[:, o - 1 : -1]], axis=1)
        cost = np.where(inside, np.abs(d), 0)[:, o:].sum(axis=1)
        if best is None:
            best = cost
        else:
            better = cost < best
            best, order, chosen = np.where(better, cost, best), np.where(better, o, order), np.where(better[:, None], d, chosen)
    f = np.where(inside, x, 0).astype(np.float32)
    lags = np.stack([(f[:, k:] * f[:, : width - k]).sum(axis=1) for k in range(ORDER + 1)], axis=1).astype(np.float64)
    lags[:, 0] = lags[:, 0] * (1 + 1e-6) + 1
    m = lags[:, np.abs(np.subtract.outer(np.arange(ORDER), np.arange(ORDER)))]
    c = np.linalg.solve(m, lags[:, 1:, None])[:, :, 0]
    limit = 1 << (PRECISION - 1)
    c = np.clip(np.rint(c * (1 << SHIFT)), -limit, limit - 1).astype(np.int32)
    guess = np.zeros((n, width - ORDER), np.int32)
    for j in range(ORDER):
        guess += c[:, j : j + 1] * x[:, ORDER - 1 - j : width - 1 - j]
    d = x.copy()
    d[:, ORDER:] -= guess >> SHIFT
    cost = np.where(inside, np.abs(d), 0)[:, ORDER:].sum(axis=1)
    better = cost + 8 * ORDER < best
    kind[better], order[better] = 1, ORDER
    return kind, order, np.where(better[:, None], d, chosen), c


def _encode(x: np.ndarray, sizes: np.ndarray, heads: list[bytes]) -> list[bytes]:
    """Frames for rows of samples (int32; the first ``sizes`` of each count)."""
    n, width = x.shape
    place = np.arange(width)
    inside = place < sizes[:, None]
    kind, order, residual, coefficients = _predictors(x, inside)
    same = ((x == x[:, :1]) | ~inside).all(axis=1)
    u = _zigzag(residual)
    coded = inside & (place >= order[:, None])
    u[~coded] = 0
    # Block sizes are multiples of the number of partitions; padding counts as the last one's, with no codes.
    quarter = sizes[:, None] >> PARTITIONS
    cuts = (np.arange(n)[:, None] * width + np.arange(1 << PARTITIONS) * quarter).ravel()
    counts = np.repeat(quarter, 1 << PARTITIONS, axis=1)
    counts[:, 0] -= order
    flat = u.ravel()
    costs = np.stack([counts * (k + 1) + np.add.reduceat(flat >> k, cuts).reshape(n, -1) for k in range(9)])
    rice = costs.argmin(axis=0)
    bits_of_head = np.where(kind == 1, 8 * order + 9 + ORDER * PRECISION, 8 * order) + 6
    total = bits_of_head + 4 * (1 << PARTITIONS) + costs.min(axis=0).sum(axis=1)
    mode = np.where(same, 0, np.where(total >= 8 * sizes, 1, 2))  # constant, verbatim, predicted
    length = 8 + np.where(mode == 0, 8, np.where(mode == 1, 8 * sizes, total))
    start = np.concatenate([[0], np.cumsum(-(-length // 8))])
    bits = np.zeros(int(start[-1]) * 8, np.uint8)
    base = start[:-1] * 8

    def put(at: np.ndarray, value: np.ndarray, many: int) -> None:
        for j in range(many):
            bits[at + j] = (value >> (many - 1 - j)) & 1

    types = np.where(mode == 0, 0, np.where(mode == 1, 1, np.where(kind == 1, 32 + ORDER - 1, 8 + order)))
    put(base, types << 1, 8)
    r = np.flatnonzero(mode == 0)
    put(base[r] + 8, x[r, 0], 8)
    r = np.flatnonzero(mode == 2)
    for j in range(ORDER):
        w = r[order[r] > j]
        put(base[w] + 8 + 8 * j, x[w, j], 8)
    w = r[kind[r] == 1]
    put(base[w] + 8 + 8 * ORDER, np.full(len(w), PRECISION - 1), 4)
    put(base[w] + 12 + 8 * ORDER, np.full(len(w), SHIFT), 5)
    for j in range(ORDER):
        put(base[w] + 17 + 8 * ORDER + PRECISION * j, coefficients[w, j], PRECISION)
    if len(r):
        put(base[r] + 8 + bits_of_head[r] - 4, np.full(len(r), PARTITIONS), 4)
        v = u[r][coded[r]].astype(np.int64)
        each = counts[r].ravel()
        k = np.repeat(rice[r].ravel(), each)
        size = (v >> k) + 1 + k
        first = np.cumsum(each) - each
        size[first] += 4  # a partition's parameter stands before its first code
        ends = np.cumsum(size)
        row = first[:: 1 << PARTITIONS]
        stop = ends - k - 1 + np.repeat(base[r] + 8 + bits_of_head[r] - (ends[row] - size[row]), counts[r].sum(axis=1))
        put(stop[first] + k[first] + 1 - size[first], k[first], 4)
    body = np.packbits(bits)
    if len(r):
        # The one bit that ends a code's zeros and its k low bits: 9 bits at most, so within two bytes.
        code = ((1 << k) | (v & ((1 << k) - 1))) << (15 - k - (stop & 7))
        at = stop >> 3
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        body = np.concatenate([body, np.zeros(1, np.uint8)])
        body[at[new]] |= np.bitwise_or.reduceat(code >> 8, new).astype(np.uint8)
        body[at[new] + 1] |= np.bitwise_or.reduceat(code & 255, new).astype(np.uint8)
    for i in np.flatnonzero(mode == 1).tolist():
        at = int(start[i]) + 1
        body[at : at + sizes[i]] = x[i, : sizes[i]] & 255
    body = body.tobytes()
    frames = [h + body[a:z] for h, a, z in zip(heads, start[:-1].tolist(), start[1:].tolist(), strict=True)]
    edges = np.concatenate([[0], np.cumsum([len(f) for f in frames])])
    sums = crc16(np.frombuffer(b"".join(frames), np.uint8), edges[:-1], edges[1:])
    return [f + int(c).to_bytes(2, "big") for f, c in zip(frames, sums.tolist(), strict=True)]


def encode(payloads: list[bytes], rate: int = 44_100) -> list[bytes]:
    """A FLAC stream for each payload (not empty), whose bytes less 128 are its samples."""
    rows = [(i, at) for i, p in enumerate(payloads) for at in range(0, len(p), BLOCK)]
    rows.sort(key=lambda r: min(BLOCK, len(payloads[r[0]]) - r[1]), reverse=True)  # frames of like sizes together
    frames: list[list[bytes]] = [[b""] * -(-len(p) // BLOCK) for p in payloads]
    for low in range(0, len(rows), FRAMES):
        part = rows[low : low + FRAMES]
        sizes = np.array([min(BLOCK, len(payloads[i]) - at) for i, at in part])
        width = int(sizes[0])
        flat = b"".join([payloads[i][at : at + width].ljust(width, b"\x80") for i, at in part])
        x = np.frombuffer(flat, np.uint8).reshape(-1, width).astype(np.int32) - 128
        heads = [_header(at // BLOCK, int(s)) for (_, at), s in zip(part, sizes, strict=True)]
        for (i, at), f in zip(part, _encode(x, sizes, heads), strict=True):
            frames[i][at // BLOCK] = f
    out = []
    for p, fs in zip(payloads, frames, strict=True):
        small, large = min(map(len, fs)), max(map(len, fs))
        signed = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        info = BLOCK.to_bytes(2, "big") * 2 + small.to_bytes(3, "big") + large.to_bytes(3, "big") + ((rate << 44) | (7 << 36) | len(p)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        points, at = [], 0
        for k, f in enumerate(fs):
            points.append((k * BLOCK).to_bytes(8, "big") + at.to_bytes(8, "big") + min(BLOCK, len(p) - k * BLOCK).to_bytes(2, "big"))
            at += len(f)
        # A metadata block's length has 24 bits: of very long streams every n-th frame has a point.
        every = -(-len(points) // 900_000)
        seek = b"".join(points[::every])
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(fs))
    return out


class Stream:
    """The metadata of a stored stream: samples, digest, where frames begin, seek points (sample, place, samples)."""

    def __init__(self, media: bytes):
        if media[:4] != b"fLaC":
            raise ValueError("no FLAC stream")
        at, last, self.points = 4, False, []
        while not last:
            last, kind, size = media[at] & 0x80, media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
            block = media[at + 4 : at + 4 + size]
            if kind == 0:
                packed = int.from_bytes(block[10:18], "big")
                self.block, self.samples, self.digest = int.from_bytes(block[2:4], "big"), packed & ((1 << 36) - 1), block[18:34]
                if (packed >> 36) & 0xFF != 7:
                    raise ValueError("8-bit mono streams only")
            elif kind == 3:
                self.points = [(int.from_bytes(block[i : i + 8], "big"), int.from_bytes(block[i + 8 : i + 16], "big"), int.from_bytes(block[i + 16 : i + 18], "big")) for i in range(0, size, 18)]
            at += 4 + size
        self.media, self.first = media, at

    def frames(self) -> list[int] | None:
        """Where each frame begins, if the seek table has them all."""
        n = -(-self.samples // self.block)
        full = len(self.points) == n and [p[0] for p in self.points] == list(range(0, n * self.block, self.block))
        return [self.first + p[1] for p in self.points] if full else None


class _Bits:
    """Bit fields at many places of one buffer."""

    def __init__(self, data: bytes):
        self.data = np.frombuffer(data + b"\0" * 16, np.uint8)
        n = len(data) + 8
        word = np.zeros(n, np.uint64)
        for k in range(8):
            word = (word << np.uint64(8)) | self.data[k : k + n]
        self.word = word

    def window(self, at: np.ndarray) -> np.ndarray:
        """The 57 or more bits from each place on, at the top of 64."""
        return self.word[at >> 3] << (at & 7).astype(np.uint64)

    def field(self, at: np.ndarray, size) -> np.ndarray:
        size = np.asarray(size)
        return np.where(size > 0, (self.window(at) >> np.minimum(64 - size, 63).astype(np.uint64)).astype(np.int64), 0)

    def signed(self, at: np.ndarray, size) -> np.ndarray:
        v = self.field(at, size)
        return v - ((v >> (np.maximum(size, 1) - 1) & 1) << size)

    def zeros(self, at: np.ndarray, window: np.ndarray) -> np.ndarray:
        """How many zero bits stand before the next one bit, from the exponent of the 52 bits at ``at`` as a number."""
        out = 1074 - ((window >> np.uint64(12)).astype(np.float64).view(np.int64) >> 52)
        far = np.flatnonzero(out > 52)
        if len(far):
            after = at[far] + 52
            if int(after.max()) > 8 * (len(self.data) - 8):
                raise ValueError("a code runs over the end")
            out[far] = 52 + self.zeros(after, self.window(after))
        return out


def _read_header(b: bytes, at: int) -> tuple[int, int, int]:
    """(frame number, block size, where the subframe begins); checks the sync code and CRC-8."""
    if b[at : at + 2] != b"\xff\xf8" or b[at + 3] != 0x02:
        raise ValueError("no frame of fixed-size 8-bit mono blocks here")
    code, p = b[at + 2], at + 4
    n, more = b[p], 0
    if n >= 0x80:
        more = 8 - (~n & 0xFF).bit_length() - 1
        n &= (1 << (6 - more)) - 1
        for k in range(more):
            n = n << 6 | b[p + 1 + k] & 0x3F
    p += 1 + more
    size, rate = code >> 4, code & 15
    if size == 7:
        samples, p = int.from_bytes(b[p : p + 2], "big") + 1, p + 2
    elif size == 6:
        samples, p = b[p] + 1, p + 1
    else:
        samples = 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(b[at:p]) != b[p]:
        raise ValueError("a frame header's checksum is wrong")
    return n, samples, p + 1


def decode_frames(data: bytes, starts: list[int]) -> tuple[list[np.ndarray], np.ndarray, list[int]]:
    """Samples, ends and frame numbers of the frames that begin at ``starts`` of ``data``."""
    heads = [_read_header(data, s) for s in starts]
    sizes = np.array([h[1] for h in heads])
    down = np.argsort(-sizes, kind="stable")
    bs, at = sizes[down], np.array([h[2] for h in heads], np.int64)[down] * 8
    bits = _Bits(data)
    kind = bits.field(at, 8) >> 1
    if (bits.field(at, 8) & 1).any():
        raise ValueError("wasted bits are not used in 8-bit streams here")
    at += 8
    n, width = len(bs), int(bs.max())
    x = np.zeros((n, width), np.int64)
    order = np.where(kind >= 32, kind - 31, np.where(kind >= 8, kind - 8, 0))
    for i in np.flatnonzero(kind <= 1).tolist():
        if kind[i] == 0:
            x[i, : bs[i]], at[i] = bits.signed(at[i : i + 1], 8)[0], at[i] + 8
        else:
            raw = np.frombuffer(data, np.uint8, int(bs[i]), int(at[i]) // 8)
            x[i, : bs[i]], at[i] = raw.view(np.int8), at[i] + 8 * bs[i]
    coded = np.flatnonzero(kind > 1)
    for j in range(int(order.max(initial=0))):
        w = coded[order[coded] > j]
        x[w, j] = bits.signed(at[w] + 8 * j, 8)
    at[coded] += 8 * order[coded]
    linear = np.flatnonzero(kind >= 32)
    shift, taps = np.zeros(n, np.int64), np.zeros((n, 32), np.int64)
    if len(linear):
        size = bits.field(at[linear], 4) + 1
        shift[linear] = bits.signed(at[linear] + 4, 5)
        for j in range(int(order[linear].max())):
            on = order[linear] > j
            taps[linear[on], j] = bits.signed(at[linear[on]] + 9 + size[on] * j, size[on])
        at[linear] += 9 + size * order[linear]
    if len(coded):
        _residuals(bits, x, at, bs, order, coded)
        for o in np.unique(order[coded][kind[coded] < 32]).tolist():
            w = coded[(order[coded] == o) & (kind[coded] < 32)]
            if o:
                y, heads_ = x[w], [x[w, :o]]
                for _ in range(o - 1):
                    heads_.append(np.diff(heads_[-1], axis=1))
                for k in range(o - 1, -1, -1):
                    y[:, k] = heads_[k][:, 0]
                    y[:, k:] = np.cumsum(y[:, k:], axis=1)
                    if k:
                        y[:, :k] = 0
                x[w] = y
        if len(linear):
            y, c, s, top = x[linear].T.copy(), taps[linear].T.copy(), shift[linear], int(order[linear].max())
            for i in range(width):
                live = order[linear] <= i
                guess = sum(c[j] * y[i - 1 - j] for j in range(min(top, i))) if i else 0
                y[i] += np.where(live, guess >> s, 0) if i else 0
            x[linear] = y.T
    end = -(-at // 8)
    back = np.empty_like(down)
    back[down] = np.arange(n)
    ends, firsts = end[back], np.array(starts)
    raw = bits.data
    if (crc16(raw, firsts, ends) != (raw[ends].astype(np.uint16) << np.uint16(8) | raw[ends + 1])).any():
        raise ValueError("a frame's checksum is wrong")
    return [x[b, : sizes[i]] for i, b in enumerate(back.tolist())], ends + 2, [h[0] for h in heads]


def _residuals(bits: _Bits, x: np.ndarray, at: np.ndarray, bs: np.ndarray, order: np.ndarray, coded: np.ndarray) -> None:
    """Read the Rice-coded residuals of rows ``coded`` into ``x``, a sample of each row at a time."""
    p, size, first = at[coded], bs[coded], order[coded]
    method = bits.field(p, 2)
    step = size >> bits.field(p + 2, 4)
    p = p + 6
    width = 4 + method
    k, raw = np.zeros(len(p), np.int64), np.full(len(p), -1, np.int64)
    out = np.zeros((int(size.max()), len(p)), np.int64)
    edge = first.copy()
    nearest = int(edge.min())
    live = np.searchsorted(-size, -np.arange(int(size.max())), "left").tolist()
    escaped = False
    for i in range(int(first.min()), int(size.max())):
        m = live[i]
        if i < 32 and (first[:m] > i).any():
            rows = np.flatnonzero(first[:m] <= i)
        else:
            rows = slice(0, m)
        if i >= nearest:
            on = np.flatnonzero((edge[:m] <= i) & (first[:m] <= i))
            if len(on):
                k[on] = bits.field(p[on], width[on])
                p[on] += width[on]
                esc = on[k[on] == (1 << width[on]) - 1]
                raw[on] = -1
                if len(esc):
                    raw[esc], escaped = bits.field(p[esc], 5), True
                    p[esc] += 5
                edge[on] = (i // step[on] + 1) * step[on]
            nearest = int(edge[:m].min()) if m else i
        q, kk = p[rows], k[rows]
        w = bits.window(q)
        z = bits.zeros(q, np.where(raw[rows] < 0, w, np.uint64(1 << 63)) if escaped else w)
        w = w << (z + 1).view(np.uint64) if len(z) and int(z.max()) < 40 else bits.window(q + z + 1)
        low = (w >> (63 - kk).view(np.uint64) >> np.uint64(1)).view(np.int64)
        u = (z << kk) | low
        value, used = (u >> 1) ^ -(u & 1), z + 1 + kk
        if escaped:
            r = raw[rows]
            value, used = np.where(r < 0, value, np.where(r > 0, bits.signed(q, np.maximum(r, 0)), 0)), np.where(r < 0, used, r)
        out[i, rows] = value
        p[rows] = q + used
    for i in range(int(first.min()), min(32, len(out))):
        out[i, first > i] = 0
    w = int(size.max())
    body = out.T
    keep = np.arange(w) >= first[:, None]
    x[coded[:, None], np.arange(w)] = np.where(keep, body, x[coded[:, None], np.arange(w)])
    at[coded] = p


def decode(media: list[bytes]) -> list[list[bytes]]:
    """The PCM blocks (unsigned bytes) of each stream, in order; each frame's checksums and the digest are checked."""
    streams = [Stream(m) for m in media]
    out: list[list[bytes]] = [[] for _ in media]
    todo = [(i, s) for i, st in enumerate(streams) for s in st.frames() or ()]
    for low in range(0, len(todo), FRAMES):
        part = todo[low : low + FRAMES]
        # The bytes from a stream's first frame in this part to its last one's end.
        runs: dict[int, list[int]] = {}
        for i, s in part:
            runs.setdefault(i, []).append(s)
        data, places, after = [], [], 0
        for i, ss in runs.items():
            starts = streams[i].frames()
            stop = starts[k] if (k := starts.index(ss[-1]) + 1 if len(starts) < 64 else int(np.searchsorted(starts, ss[-1])) + 1) < len(starts) else len(media[i])
            data.append(media[i][ss[0] : stop])
            places += [(i, s - ss[0] + after, (ss[n + 1] if n + 1 < len(ss) else stop) - ss[0] + after) for n, s in enumerate(ss)]
            after += stop - ss[0]
        samples, ends, _ = decode_frames(b"".join(data), [p[1] for p in places])
        if [p[2] for p in places] != ends.tolist():
            raise ValueError("a frame does not end where the next begins")
        for (i, _, _), x in zip(places, samples, strict=True):
            out[i].append((x + 128).astype(np.uint8).tobytes())
    for i, st in enumerate(streams):
        if st.frames() is None:  # without a full seek table, frame by frame
            at = st.first
            while sum(map(len, out[i])) < st.samples:
                samples, ends, _ = decode_frames(st.media[at:], [0])
                out[i].append((samples[0] + 128).astype(np.uint8).tobytes())
                at += int(ends[0])
        pcm = b"".join(out[i])
        if len(pcm) != st.samples or (any(st.digest) and hashlib.md5((np.frombuffer(pcm, np.uint8) ^ 0x80).tobytes()).digest() != st.digest):
            raise ValueError("the samples are not those that were stored")
    return out


def decode_at(media: bytes, sample: int) -> tuple[int, bytes]:
    """The block that holds ``sample`` and the sample it begins with, by the seek table, without decoding the others."""
    st = Stream(media)
    before = [p for p in st.points if p[0] <= sample] or [(0, 0, st.block)]
    first, place, _ = before[-1]
    at = st.first + place
    while True:
        samples, ends, _ = decode_frames(media[at:], [0])
        if first + len(samples[0]) > sample or at + int(ends[0]) >= len(media):
            return first, (samples[0] + 128).astype(np.uint8).tobytes()
        first, at = first + len(samples[0]), at + int(ends[0])
