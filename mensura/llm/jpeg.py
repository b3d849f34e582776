"""A progressive JPEG codec in numpy that works on many images at once.

A payload's bytes, less 128, are the quantised DCT coefficients of an image with 4:2:0 chroma and quantisers of 1, so the
file keeps them exactly. Scans are written with short restart intervals; the decoder runs all intervals of a scan in
lockstep, one Huffman symbol (or one refined coefficient) of each at a time, and accumulates the scans into coefficient
arrays.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np

#: Fixed values of the JPEG standard: coefficients in the order they are stored.
ZIGZAG = np.array(
    [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
     35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
)
#: (components, first and last coefficient, bits already sent's position, position of the bits sent)
SCANS = (
    ((0, 1, 2), 0, 0, 0, 1),
    ((0,), 1, 47, 0, 0),
    ((1,), 1, 63, 0, 0),
    ((2,), 1, 63, 0, 0),
    ((0,), 48, 63, 0, 1),
    ((0, 1, 2), 0, 0, 1, 0),
    ((0,), 48, 63, 1, 0),
)
INTERVAL = 4
CHUNK = 1 << 15  # blocks encoded, or lanes decoded, at once
MAX_ROWS = 4095  # of 16 lines, in an image


# ---- Huffman tables


@dataclass(frozen=True)
class Huffman:
    counts: tuple[int, ...]  # of codes of 1 to 16 bits
    symbols: tuple[int, ...]

    def codes(self) -> list[tuple[int, int, int]]:
        """(symbol, code, length)"""
        out, code, at = [], 0, 0
        for length, n in enumerate(self.counts, 1):
            for s in self.symbols[at : at + n]:
                out.append((s, code, length))
                code += 1
            at += n
            code <<= 1
        return out

    def segment(self, kind: int, slot: int) -> bytes:
        body = bytes([kind << 4 | slot, *self.counts, *self.symbols])
        return b"\xff\xc4" + (len(body) + 2).to_bytes(2, "big") + body


@cache
def coder(table: Huffman) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, c, n in table.codes():
        code[s], length[s] = c, n
    return code, length


@cache
def lookup(table: Huffman) -> np.ndarray:
    """By the next 16 bits: symbol | length << 8; length 0 for no code."""
    out = np.zeros(1 << 16, np.int32)
    for s, c, n in table.codes():
        out[c << 16 - n : (c + 1) << 16 - n] = s | n << 8
    return out


def _counts(**by_length: int) -> tuple[int, ...]:
    return tuple(by_length.get(f"n{i}", 0) for i in range(1, 17))


DC_TABLE = Huffman(_counts(n4=12), tuple(range(12)))
_SHORT = (0x00, *range(0x01, 0x09))
_LONG = (0xF0, *(run << 4 | size for run in range(1, 16) for size in range(1, 9)))
AC_TABLE = Huffman(_counts(n4=len(_SHORT), n10=len(_LONG)), _SHORT + _LONG)


# ---- encoding


def geometry(n_bytes: int) -> tuple[int, int]:
    """MCU columns and rows for a payload: six blocks of 64 coefficients each."""
    mcus = -(-n_bytes // 384)
    cols = max(min(mcus, 16), -(-mcus // MAX_ROWS))
    return cols, -(-mcus // cols)


@lru_cache(4096)
def _mcu_index(cols: int, rows: int) -> list[np.ndarray]:
    """For each component in raster order, the block's place in MCU order (six to an MCU)."""
    at = np.arange(rows * cols, dtype=np.int64).reshape(rows, cols) * 6
    luma = (at[:, :, None, None] + np.arange(4).reshape(2, 2)).transpose(0, 2, 1, 3).reshape(-1)
    return [luma, at.reshape(-1) + 4, at.reshape(-1) + 5]


def _pack(value: np.ndarray, length: np.ndarray, seg: np.ndarray, n_seg: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of consecutive entries as bytes; each segment begins a byte and is filled up with ones. Also its byte ends."""
    bits = np.bincount(seg, length, n_seg).astype(np.int64)
    n_bytes = bits + 7 >> 3
    ends = np.cumsum(n_bytes)
    shift = (ends - n_bytes) * 8 - (np.cumsum(bits) - bits)
    off = np.cumsum(length) - length + shift[seg]
    word, left = off >> 5, 64 - (off & 31) - length
    wide = value.astype(np.uint64) << left.astype(np.uint64)
    size = int(ends[-1] + 11 >> 2) + 1
    words = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), size) + np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
    out = words.astype(np.uint32).astype(">u4").view(np.uint8)[: ends[-1]].copy()
    fill = -bits & 7
    some = fill > 0
    out[ends[some] - 1] |= ((1 << fill[some]) - 1).astype(np.uint8)
    return out, ends


def _stuff(data: np.ndarray, ends: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zero bytes after 255 and restart markers between segments. number: of each segment in its scan; 0 gets no marker."""
    ff = data == 255
    before = np.cumsum(ff)
    starts = np.concatenate([[0], ends[:-1]])
    marks = 2 * np.cumsum(number > 0)
    seg = np.repeat(np.arange(len(ends)), ends - starts)
    at = np.arange(len(data)) + before - ff + marks[seg]
    new_ends = ends + before[ends - 1] + marks
    out = np.zeros(new_ends[-1], np.uint8)
    out[at] = data
    new_starts = np.concatenate([[0], new_ends[:-1]])
    m = number > 0
    out[new_starts[m]] = 255
    out[new_starts[m] + 1] = 0xD0 + (number[m] - 1) % 8
    return out, new_ends


_SIZES = np.array([i.bit_length() for i in range(512)])


def _size(v: np.ndarray) -> np.ndarray:
    """Bits of integers from 0 to 511."""
    return _SIZES[v]


def _ac_first(band: np.ndarray, al: int, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code, length = coder(AC_TABLE)
    n, width = band.shape
    t = np.abs(band) >> al
    blk, k = np.nonzero(t)
    per = np.bincount(blk, minlength=n)
    last = np.cumsum(per)
    prev = np.empty_like(k)
    prev[1:] = k[:-1]
    prev[(last - per)[per > 0]] = -1
    run = k - prev - 1
    tail = np.full(n, -1)
    tail[per > 0] = k[last[per > 0] - 1]
    eob = tail < width - 1
    zrl = run >> 4
    zsum = np.cumsum(zrl)
    eobs = np.cumsum(eob)
    at = np.arange(len(k)) + (eobs - eob)[blk] + zsum
    zr_blk = np.concatenate([[0], zsum])[last]
    total = len(k) + int(eobs[-1]) + (int(zsum[-1]) if len(zsum) else 0)
    value, bits, segs = np.full(total, code[0xF0]), np.full(total, length[0xF0]), np.empty(total, np.int64)
    mag = t[blk, k].astype(np.int64)
    s = _size(mag)
    rs = (run & 15) << 4 | s
    value[at] = code[rs] << s | np.where(band[blk, k] > 0, mag, (1 << s) - 1 - mag)
    bits[at] = length[rs] + s
    end_at = (last + eobs - 1 + zr_blk)[eob]
    value[end_at], bits[end_at] = code[0], length[0]
    segs = np.repeat(seg, per + eob + np.bincount(blk, zrl, n).astype(np.int64))
    return value, bits, segs


def _ac_refine(band: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One more bit for bands of at most 16 coefficients, in which no run is too long for one symbol."""
    code, length = coder(AC_TABLE)
    n, width = band.shape
    mag = np.abs(band).astype(np.int64)
    old, new = mag > 1, mag == 1
    value, bits = np.zeros((n, 2 * width + 2), np.int64), np.zeros((n, 2 * width + 2), np.int64)
    value[:, 1 : 2 * width : 2][old] = mag[old] & 1  # after the symbol that precedes it
    bits[:, 1 : 2 * width : 2][old] = 1
    blk, k = np.nonzero(new)
    prev = np.full(len(k), -1)
    same = blk[1:] == blk[:-1]
    prev[1:][same] = k[:-1][same]
    zeros = np.cumsum(mag == 0, 1)
    run = zeros[blk, k] - np.where(prev >= 0, zeros[blk, prev], 0)
    rs = run << 4 | 1
    value[blk, 2 * prev + 2] = code[rs] << 1 | (band[blk, k] > 0)
    bits[blk, 2 * prev + 2] = length[rs] + 1
    tail = np.full(n, -1)
    tail[blk] = k  # the last one stays
    b = np.flatnonzero(tail < width - 1)
    value[b, 2 * tail[b] + 2], bits[b, 2 * tail[b] + 2] = code[0], length[0]
    there = bits > 0
    return value[there], bits[there], np.repeat(seg, there.sum(1))


def _dc_first(dc: np.ndarray, comp: np.ndarray, begins: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """dc: shifted values in scan order; begins: the interval each belongs to."""
    diff = np.empty(len(dc), np.int64)
    for c in range(3):
        i = np.flatnonzero(comp == c)
        d = dc[i].astype(np.int64)
        prev = np.concatenate([[0], d[:-1]])
        prev[np.concatenate([[True], begins[i][1:] != begins[i][:-1]])] = 0
        diff[i] = d - prev
    code, length = coder(DC_TABLE)
    mag = np.abs(diff)
    s = _size(mag)
    return code[s] << s | np.where(diff >= 0, mag, (1 << s) - 1 - mag), length[s] + s, seg


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG file for each payload; the comment segment holds the payload's length."""
    if not payloads:
        return []
    shapes = [geometry(len(p)) for p in payloads]
    n_mcu = np.array([c * r for c, r in shapes])
    base = np.concatenate([[0], np.cumsum(n_mcu * 6)])
    coef = np.zeros((base[-1], 64), np.int16)
    flat = coef.reshape(-1)
    for p, b in zip(payloads, base, strict=False):
        flat[b * 64 : b * 64 + len(p)] = np.frombuffer(p, np.uint8)
        flat[b * 64 : b * 64 + len(p)] -= 128
    order = [[], [], []]
    for (c, r), b in zip(shapes, base, strict=False):
        for i, at in enumerate(_mcu_index(c, r)):
            order[i].append(at + b)
    parts: list[list[bytes]] = [[] for _ in payloads]
    for comps, ss, se, ah, al in SCANS:
        inter = len(comps) > 1
        blocks = np.arange(base[-1]) if inter else np.concatenate(order[comps[0]])
        per_image = n_mcu * 6 if inter else n_mcu * (4 if comps[0] == 0 else 1)
        step = INTERVAL * (6 if inter else 1)
        n_seg = -(-per_image // step)
        first = np.cumsum(n_seg) - n_seg
        image = np.repeat(np.arange(len(payloads)), per_image)
        within = np.arange(len(blocks)) - np.repeat(np.cumsum(per_image) - per_image, per_image)
        seg = first[image] + within // step
        number = np.arange(n_seg.sum()) - np.repeat(first, n_seg)
        cuts = [0]
        while cuts[-1] < len(blocks):  # chunks end where a segment does
            cuts.append(int(np.searchsorted(seg, seg[min(cuts[-1] + CHUNK, len(blocks)) - 1], "right")))
        streams, ends, at = [], [], 0
        for a, b in zip(cuts, cuts[1:], strict=False):
            s0 = seg[a]
            own, x = seg[a:b] - s0, coef[blocks[a:b], ss : se + 1]
            if ss == 0 and ah == 0:
                comp = np.array([0, 0, 0, 0, 1, 2])[within[a:b] % 6]
                entries = _dc_first(x[:, 0] >> al, comp, own, own)
            elif ss == 0:
                entries = (x[:, 0] >> al & 1).astype(np.int64), np.ones(b - a, np.int64), own
            elif ah == 0:
                entries = _ac_first(x, al, own)
            else:
                entries = _ac_refine(x, own)
            data, e = _stuff(*_pack(*entries, int(own[-1]) + 1), number[s0 : seg[b - 1] + 1])
            streams.append(data)
            ends.append(e + at)
            at += len(data)
        stream, ends = np.concatenate(streams).tobytes(), np.concatenate(ends)
        stop = ends[first + n_seg - 1]
        head = bytes([len(comps)]) + b"".join(bytes([c + 1, 0]) for c in comps) + bytes([ss, se, ah << 4 | al])
        head = b"\xff\xda" + (len(head) + 2).to_bytes(2, "big") + head
        dri = b"\xff\xdd\x00\x04" + INTERVAL.to_bytes(2, "big")
        for i, (a, b) in enumerate(zip([0, *stop[:-1]], stop, strict=True)):
            parts[i].append((dri if (comps, ss, ah) == ((0, 1, 2), 0, 0) else b"") + head + stream[a:b])
    quant = b"\xff\xdb\x00\x43\x00" + b"\x01" * 64
    huff = DC_TABLE.segment(0, 0) + AC_TABLE.segment(1, 0)
    out = []
    for p, (c, r), scans in zip(payloads, shapes, parts, strict=True):
        note = str(len(p)).encode()
        frame = b"\x08" + (16 * r).to_bytes(2, "big") + (16 * c).to_bytes(2, "big") + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00"
        out.append(
            b"\xff\xd8\xff\xfe" + (len(note) + 2).to_bytes(2, "big") + note + quant + b"\xff\xc2" + (len(frame) + 2).to_bytes(2, "big") + frame + huff + b"".join(scans) + b"\xff\xd9"
        )
    return out


# ---- decoding


@dataclass
class Component:
    h: int
    v: int
    quant: int
    cols: int = 0  # blocks that hold samples
    rows: int = 0
    stride: int = 0  # blocks stored, whole MCUs
    base: int = 0  # first block in the batch's coefficient array
    stored: int = 0


@dataclass
class Image:
    width: int = 0
    height: int = 0
    comps: dict[int, Component] = field(default_factory=dict)
    comment: bytes = b""
    mcu_cols: int = 0
    mcu_rows: int = 0


@dataclass
class Decoded:
    """A batch's coefficient arrays (zigzag order, blocks by component in raster order) and its images."""

    coef: np.ndarray
    images: list[Image]
    quants: list[dict[int, np.ndarray]]


def _u16(b: bytes, at: int) -> int:
    return b[at] << 8 | b[at + 1]


@lru_cache(4096)
def _order(mcu_cols: int, mcu_rows: int, comps: tuple[tuple[int, ...], ...]) -> np.ndarray:
    """A scan's blocks in its order, counted from the image's first. comps: h, v, cols, rows, stride, first block."""
    if len(comps) == 1:
        ((_, _, cols, rows, stride, first),) = comps
        return (first + np.arange(rows)[:, None] * stride + np.arange(cols)).reshape(-1)
    y, x = np.divmod(np.arange(mcu_rows * mcu_cols), mcu_cols)
    cells = [first + (y * v + dy) * stride + x * h + dx for h, v, _, _, stride, first in comps for dy in range(v) for dx in range(h)]
    return np.stack(cells, 1).reshape(-1)


@lru_cache(256)
def _tables(body: bytes) -> dict[int, Huffman]:
    out, i = {}, 0
    while i < len(body):
        counts = tuple(body[i + 1 : i + 17])
        n = sum(counts)
        out[body[i]] = Huffman(counts, tuple(body[i + 17 : i + 17 + n]))
        i += 17 + n
    return out


def decode(files: list[bytes]) -> Decoded:
    """All scans of progressive Huffman-coded files, accumulated."""
    data = b"".join(files)
    raw = np.frombuffer(data + b"\0" * 8, np.uint8)
    ff = np.flatnonzero(raw[: len(data)] == 255)
    marks = ff[raw[ff + 1] != 0]
    restart = (raw[marks + 1] & 0xF8) == 0xD0
    hard, soft = marks[~restart], marks[restart]
    images, quants, jobs, n_blocks, start = [], [], {}, 0, 0
    for f in files:
        im, quant, huff, interval, at = Image(), {}, {}, 0, start + 2
        order = -1
        while data[at + 1] != 0xD9:
            kind, length = data[at + 1], _u16(data, at + 2)
            body, at = data[at + 4 : at + 2 + length], at + 2 + length
            if kind == 0xFE:
                im.comment = body
            elif kind == 0xDB:
                i = 0
                while i < len(body):
                    wide = body[i] >> 4
                    quant[body[i] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, i + 1).astype(np.int64)
                    i += 1 + 64 * (1 + wide)
            elif kind == 0xC4:
                huff |= _tables(body)
            elif kind == 0xDD:
                interval = _u16(body, 0)
            elif kind == 0xC2:
                im.height, im.width = _u16(body, 1), _u16(body, 3)
                for j in range(body[5]):
                    c, hv, q = body[6 + 3 * j : 9 + 3 * j]
                    im.comps[c] = Component(hv >> 4, hv & 15, q)
                hmax, vmax = max(c.h for c in im.comps.values()), max(c.v for c in im.comps.values())
                im.mcu_cols, im.mcu_rows = -(-im.width // (8 * hmax)), -(-im.height // (8 * vmax))
                for c in im.comps.values():
                    c.cols, c.rows = -(-(-(-im.width * c.h // hmax)) // 8), -(-(-(-im.height * c.v // vmax)) // 8)
                    c.stride, c.stored = im.mcu_cols * c.h, im.mcu_cols * c.h * im.mcu_rows * c.v
                    c.base = n_blocks
                    n_blocks += c.stored
            elif kind in range(0xC0, 0xD0) and kind != 0xC8:
                raise ValueError("not a progressive Huffman-coded JPEG file")
            elif kind == 0xDA:
                order += 1
                ids = [body[1 + 2 * j] for j in range(body[0])]
                slots = [body[2 + 2 * j] for j in range(body[0])]
                ss, se, a = body[-3:]
                stop = int(hard[np.searchsorted(hard, at)])
                i, j = np.searchsorted(soft, [at, stop])
                cuts = soft[i:j]
                own = [im.comps[c] for c in ids]
                first = next(iter(im.comps.values())).base
                blocks = _order(im.mcu_cols, im.mcu_rows, tuple((c.h, c.v, c.cols, c.rows, c.stride, c.base - first) for c in own)) + first
                cells = [im.comps[c].h * im.comps[c].v for c in ids] if len(ids) > 1 else [1]
                step = interval * sum(cells) or len(blocks)
                tables = tuple(huff.get(s >> 4 if ss == 0 else 16 | s & 15) for s in slots)
                jobs.setdefault((order, ss, se, a >> 4, a & 15, tuple(cells), tables), []).append((blocks, step, np.concatenate([[at], cuts + 2]), np.concatenate([cuts, [stop]])))
                at = stop
        images.append(im)
        quants.append(quant)
        start += len(f)
    coef = np.zeros((n_blocks, 64), np.int16)
    for key, scans in jobs.items():
        _run_scan(raw, coef, key, scans)
    return Decoded(coef, images, quants)


def _run_scan(raw: np.ndarray, coef: np.ndarray, key: tuple, scans: list[tuple]) -> None:
    _, ss, se, ah, al, cells, tables = key
    blocks = np.concatenate([s[0] for s in scans])
    base, lo, hi = 0, [], []
    for b, step, begins, _ in scans:
        x = np.arange(0, len(b), step)
        if len(x) != len(begins):
            raise ValueError("restart markers are missing")
        lo.append(base + x)
        hi.append(base + np.minimum(x + step, len(b)))
        base += len(b)
    lo, hi = np.concatenate(lo), np.concatenate(hi)
    begins, ends = np.concatenate([s[2] for s in scans]), np.concatenate([s[3] for s in scans])
    for a in range(0, len(lo), CHUNK):
        part = slice(a, a + CHUNK)
        # the lanes' bytes without stuffing, each followed by zeros
        size = ends[part] - begins[part]
        first = np.cumsum(size + 4) - (size + 4)
        buf = np.zeros(int(size.sum()) + 4 * len(size) + 8, np.uint8)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        src = raw[at + np.repeat(begins[part], size)]
        lane = np.repeat(np.arange(len(size)), size)
        keep = np.ones(len(src), bool)
        keep[1:] = ~((src[1:] == 0) & (src[:-1] == 255) & (at[1:] > 0))
        gone = np.cumsum(~keep)
        before = np.concatenate([[0], gone])[np.cumsum(size) - size]
        buf[(first[lane] + at - (gone - before[lane]))[keep]] = src[keep]
        wide = buf.astype(np.uint32)
        window = ((wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]).astype(np.int64)
        pos = first * 8
        if ss == 0 and ah == 0:
            _dc_first_lanes(window, coef, blocks, pos, lo[part], hi[part], al, cells, tables)
        elif ss == 0:
            n = hi[part] - lo[part]
            i = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            p = np.repeat(pos, n) + i
            coef[blocks[np.repeat(lo[part], n) + i], 0] |= ((window[p >> 3] >> (31 - (p & 7)) & 1) << al).astype(np.int16)
        elif ah == 0:
            _ac_first_lanes(window, coef.reshape(-1), blocks, pos, lo[part].copy(), hi[part], ss, se, al, tables[0])
        else:
            _ac_refine_lanes(window, coef.reshape(-1), blocks, pos, lo[part].copy(), hi[part], ss, se, al, tables[0])


def _peek(window: np.ndarray, pos: np.ndarray, n) -> np.ndarray:
    """The next n bits, 16 at most."""
    return (window[pos >> 3] >> (32 - n - (pos & 7))) & ((1 << n) - 1)


def _extend(bits: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << s >> 1), bits - (1 << s) + 1, bits)


def _dc_first_lanes(window, coef, blocks, pos, lo, hi, al, cells, tables) -> None:
    comp_of = np.repeat(np.arange(len(cells)), cells)
    pred = np.zeros((len(cells), len(pos)), np.int64)
    for i in range(int((hi - lo).max())):
        c = int(comp_of[i % len(comp_of)])
        on = np.flatnonzero(lo + i < hi)
        hit = lookup(tables[c])[_peek(window, pos[on], 16)]
        s = hit & 255
        p = pos[on] + (hit >> 8)
        pred[c, on] += _extend(_peek(window, p, s), s)
        pos[on] = p + s
        coef[blocks[lo[on] + i], 0] = pred[c, on] << al


def _ac_first_lanes(window, flat, blocks, pos, blk, hi, ss, se, al, table) -> None:
    table = lookup(table)
    k = np.full(len(pos), ss)
    while len(pos):
        hit = table[_peek(window, pos, 16)]
        pos = pos + (hit >> 8)
        r, s = hit >> 4 & 15, hit & 15
        put = s > 0
        n = np.where(put, s, np.where(r < 15, r, 0))
        bits = _peek(window, pos, n)
        pos += n
        k = k + np.where(put | (r == 15), r, 0)
        i = np.flatnonzero(put)
        flat[blocks[blk[i]] * 64 + k[i]] = _extend(bits[i], s[i]) << al
        k += put | (r == 15)
        end = ~put & (r < 15)
        over = end | (k > se)
        blk = blk + np.where(end, (1 << r) + bits, over)
        k[over] = ss
        on = blk < hi
        if not on.all():
            pos, blk, hi, k = pos[on], blk[on], hi[on], k[on]


def _ac_refine_lanes(window, flat, blocks, pos, blk, hi, ss, se, al, table) -> None:
    table = lookup(table)
    n = len(pos)
    k, eob, r, val = np.full(n, ss), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    need = np.ones(n, bool)
    while len(pos):
        i = np.flatnonzero(need)
        if len(i):
            p = pos[i]
            hit = table[_peek(window, p, 16)]
            p += hit >> 8
            run, s = (hit >> 4 & 15).astype(np.int64), hit & 15
            stop = (s == 0) & (run < 15)
            m = np.where(s > 0, 1, np.where(stop, run, 0))
            bits = _peek(window, p, m)
            pos[i] = p + m
            eob[i] = np.where(stop, (1 << run) + bits, 0)
            r[i] = run
            val[i] = np.where(s > 0, np.where(bits > 0, 1, -1), 0) << al
        at = blocks[blk] * 64 + k
        c = flat[at]
        old = c != 0
        bit = old & ((window[pos >> 3] >> (31 - (pos & 7)) & 1) > 0)
        pos += old
        grow = bit & ((np.abs(c) >> al & 1) == 0)
        flat[at[grow]] += np.sign(c[grow]) << np.int16(al)
        fresh = ~old & (eob == 0)
        need = fresh & (r == 0)
        place = need & (val != 0)
        flat[at[place]] = val[place]
        r -= fresh & (r > 0)
        k += 1
        over = k > se
        if over.any():
            blk = blk + over
            k[over] = ss
            eob -= over & (eob > 0)
            need = np.where(over, eob == 0, need)
            on = blk < hi
            if not on.all():
                pos, blk, hi, k, eob, r, val, need = (x[on] for x in (pos, blk, hi, k, eob, r, val, need))


def payload(d: Decoded, i: int) -> bytes:
    """The bytes that encode() stored in the i-th image."""
    im = d.images[i]
    if not im.comment.isdigit() or [(c.h, c.v) for c in im.comps.values()] != [(2, 2), (1, 1), (1, 1)]:
        raise ValueError("this file holds no payload")
    at = np.concatenate([c.base + np.arange(c.stored) for c in im.comps.values()])
    out = np.empty((len(at), 64), np.uint8)
    out[np.concatenate(_mcu_index(im.mcu_cols, im.mcu_rows))] = (d.coef[at] + 128).astype(np.uint8)
    return out.reshape(-1)[: int(im.comment)].tobytes()


@cache
def _idct() -> np.ndarray:
    """64 x 64, from zigzag coefficients to samples, in units of 2**-13; sums of integers this small are exact in any order."""
    u, x = np.arange(8)[:, None], np.arange(8)[None]
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    return np.rint(np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[ZIGZAG] * 8192)


def rgb(d: Decoded, i: int) -> np.ndarray:
    """The i-th image as a tensor of height x width x 3 bytes."""
    im, planes = d.images[i], []
    hmax, vmax = max(c.h for c in im.comps.values()), max(c.v for c in im.comps.values())
    for c in im.comps.values():
        rows = c.stored // c.stride
        plane = np.empty((rows * 8, c.stride * 8), np.int32)
        wide = max(1, CHUNK // c.stride)
        for a in range(0, rows, wide):  # a few rows of blocks at a time
            b = min(rows, a + wide)
            x = d.coef[c.base + a * c.stride : c.base + b * c.stride].astype(np.float64) * d.quants[i][c.quant]
            s = (np.floor((x @ _idct() + 4096) / 8192) + 128).clip(0, 255).astype(np.int32)
            plane[a * 8 : b * 8] = s.reshape(b - a, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape((b - a) * 8, -1)
        if (c.v, c.h) != (vmax, hmax):
            plane = plane.repeat(vmax // c.v, 0).repeat(hmax // c.h, 1)
        planes.append(plane[: im.height, : im.width])
    if len(planes) == 1:
        return np.repeat(planes[0][..., None], 3, 2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    out = np.empty((im.height, im.width, 3), np.uint8)
    # fixed values: the JFIF colour conversion times 2**16
    for j, s in enumerate((91881 * cr, -22554 * cb - 46802 * cr, 116130 * cb)):
        out[..., j] = (y + ((s + 32768) >> 16)).clip(0, 255)
    return out
