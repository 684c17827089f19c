"""Progressive JPEG: coefficient arrays to scans and back, and coefficient arrays to RGB.

Coefficients are int16 arrays of one row per block in zigzag order, a component's blocks row by row. Decoding accumulates
the scans, spectral selection and successive approximation alike, into such arrays. DC scans look up the symbol at every
bit and follow the chain of code lengths. AC scans in which every coefficient of the band is non-zero and alike coded have
a fixed layout, which is tested and read as a whole; others go bit by bit.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np


@functools.cache
def zigzag() -> np.ndarray:
    """Place in a row-major block of each coefficient in zigzag order."""
    return np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))


@functools.cache
def inverse_transform() -> np.ndarray:
    """64 x 64 matrix from zigzag coefficients to samples of a block."""
    u, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    c = np.cos((2 * x + 1) * u * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    return np.kron(c, c)[zigzag()].astype(np.float32)


@dataclass
class Component:
    h: int
    v: int
    wide: int  # blocks in a row and rows of blocks, padded to whole units
    high: int
    own_wide: int  # without the padding: what scans of this component alone cover
    own_high: int
    coefficients: np.ndarray
    quantisation: np.ndarray = field(default_factory=lambda: np.ones(64, np.int32))


@dataclass
class Frame:
    width: int
    height: int
    components: list[Component]
    comment: bytes = b""

    @staticmethod
    def blank(width: int, height: int, sampling=((2, 2), (1, 1), (1, 1))) -> Frame:
        top_h, top_v = max(h for h, _ in sampling), max(v for _, v in sampling)
        units_x, units_y = -(-width // (8 * top_h)), -(-height // (8 * top_v))
        made = []
        for h, v in sampling:
            w, t = units_x * h, units_y * v
            made.append(Component(h, v, w, t, -(-(-(-width * h // top_h)) // 8), -(-(-(-height * v // top_v)) // 8), np.zeros((w * t, 64), np.int16)))
        return Frame(width, height, made)

    def rgb_strips(self) -> Iterator[np.ndarray]:
        """The image as uint8 arrays (rows, width, 3), a row of units at a time; chroma is upsampled by repetition."""
        top_h, top_v = max(c.h for c in self.components), max(c.v for c in self.components)
        units = self.components[0].high // self.components[0].v
        step = max(1, 4096 // max(1, self.components[0].wide))
        for y in range(0, units, step):
            planes = []
            for c in self.components:
                rows = slice(y * c.v * c.wide, min(units, y + step) * c.v * c.wide)
                samples = (c.coefficients[rows].astype(np.float32) * c.quantisation.astype(np.float32)) @ inverse_transform() + 128
                plane = samples.reshape(-1, c.wide, 8, 8).swapaxes(1, 2).reshape(-1, c.wide * 8)
                planes.append(np.clip(np.rint(plane), 0, 255).repeat(top_v // c.v, 0).repeat(top_h // c.h, 1))
            planes = [p[: self.height - y * top_v * 8, : self.width] for p in planes]
            if len(planes) == 1:
                yield np.repeat(planes[0][:, :, None], 3, 2).astype(np.uint8)
                continue
            luma, blue, red = planes[0], planes[1] - 128, planes[2] - 128
            rgb = np.stack([luma + 1.402 * red, luma - 0.344136 * blue - 0.714136 * red, luma + 1.772 * blue], 2)
            yield np.clip(np.rint(rgb), 0, 255).astype(np.uint8)

    def rgb(self) -> np.ndarray:
        return np.concatenate(list(self.rgb_strips()))


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def huffman(kind: int, slot: int, lengths: dict[int, int]) -> bytes:
    """A DHT segment from code lengths by symbol; codes follow in order of length, then of symbol."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = bytes(sum(n == k for n in lengths.values()) for k in range(1, 17))
    return segment(0xC4, bytes([kind << 4 | slot]) + counts + bytes(order))


def codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length)."""
    out, code, last = {}, 0, 0
    for s in sorted(lengths, key=lambda s: (lengths[s], s)):
        code <<= lengths[s] - last
        out[s] = (code, last := lengths[s])
        code += 1
    return out


def stuffed(data: np.ndarray) -> bytes:
    """Entropy-coded bytes with a zero after each 0xFF."""
    full = np.flatnonzero(data == 0xFF)
    return np.insert(data, full + 1, 0).tobytes() if len(full) else data.tobytes()


def scan_header(components: list[int], tables: int, first: int, last: int, high: int, low: int) -> bytes:
    return segment(0xDA, bytes([len(components)]) + b"".join(bytes([c + 1, tables]) for c in components) + bytes([first, last, high << 4 | low]))


#: Code lengths for AC scans of any content: 8 bits for each of the 255 possible symbols but a few of 9.
GENERAL = {s: 8 if s < 254 else 9 for s in range(256) if (s >> 4) <= 15 and s != 255}


class Bits:
    def __init__(self):
        self.out: list[str] = []

    def put(self, value: int, length: int) -> None:
        if length:
            self.out.append(format(value & ((1 << length) - 1), f"0{length}b"))

    def done(self) -> np.ndarray:
        bits = "".join(self.out)
        bits += "1" * (-len(bits) % 8)
        return np.frombuffer(int(bits, 2).to_bytes(len(bits) // 8, "big"), np.uint8) if bits else np.empty(0, np.uint8)


def _own_blocks(c: Component) -> np.ndarray:
    return (np.arange(c.own_high)[:, None] * c.wide + np.arange(c.own_wide)).ravel()


@functools.lru_cache(maxsize=256)
def _places(shape: tuple) -> tuple[np.ndarray, list[np.ndarray], int]:
    """_scan_blocks for components of (own width, own height, wide, high, h, v)."""
    if len(shape) == 1:
        own_wide, own_high, wide, *_ = shape[0]
        blocks = (np.arange(own_high)[:, None] * wide + np.arange(own_wide)).ravel()
        return blocks, [np.arange(len(blocks))], 1
    _, _, wide, high, h, v = shape[0]
    y, x = (a.ravel() for a in np.meshgrid(np.arange(high // v), np.arange(wide // h), indexing="ij"))
    steps = [(i, (y * v + j) * wide + x * h + k) for i, (_, _, wide, _, h, v) in enumerate(shape) for j in range(v) for k in range(h)]
    owner = np.tile([i for i, _ in steps], len(y))
    return np.stack([at for _, at in steps], 1).ravel(), [np.flatnonzero(owner == i) for i in range(len(shape))], len(steps)


def _scan_blocks(frame: Frame, chosen: list[int]) -> tuple[np.ndarray, list[np.ndarray], int]:
    """Block of each step of a scan, the steps of each component, and steps in a unit: units of all components in turn, or
    one's own blocks."""
    shape = tuple((c.own_wide, c.own_high, c.wide, c.high, c.h, c.v) for c in (frame.components[i] for i in chosen))
    return (_places if shape[0][2] * shape[0][3] <= 1 << 14 else _places.__wrapped__)(shape)


def _dc_values(frame: Frame, order: tuple) -> np.ndarray:
    out = np.empty(len(order[0]), np.int64)
    for c, steps in zip(frame.components, order[1], strict=True):
        out[steps] = c.coefficients[order[0][steps], 0]
    return out


def _dc_first(steps: list[np.ndarray], values: np.ndarray, table: dict[int, tuple[int, int]]) -> np.ndarray:
    """The differences of each component's values, coded one after the other."""
    d = np.empty_like(values)
    for own in steps:
        d[own] = np.diff(values[own], prepend=0)
    n = np.frexp(np.abs(d).astype(float))[1]  # bits of the size
    code, length = np.zeros(12, np.int64), np.zeros(12, np.int64)
    for symbol, (c, k) in table.items():
        code[symbol], length[symbol] = c, k
    whole, bits = code[n] << n | (np.where(d > 0, d, d - 1) & ((1 << n) - 1)), length[n] + n
    left = np.repeat(np.cumsum(bits), bits) - np.arange(int(bits.sum())) - 1  # bits of its step that follow each bit
    out = (np.repeat(whole, bits) >> left & 1).astype(np.uint8)
    return np.packbits(np.append(out, np.ones(-len(out) % 8, np.uint8)))


def _ac_first(blocks: np.ndarray, low: int, table: dict) -> np.ndarray:
    bits = Bits()
    size = np.sign(blocks) * (np.abs(blocks) >> low)
    for row in size.tolist():
        run = 0
        for k, v in enumerate(row):
            if v == 0:
                run += 1
                continue
            while run > 15:
                bits.put(*table[0xF0])
                run -= 16
            n = abs(v).bit_length()
            bits.put(*table[run << 4 | n])
            bits.put(v if v > 0 else v - 1, n)
            run = 0
        if run:
            bits.put(*table[0])
    return bits.done()


def _ac_refine(blocks: np.ndarray, low: int, table: dict) -> np.ndarray:
    bits = Bits()
    for row in blocks.tolist():
        size = [abs(v) >> low for v in row]
        end = max((k for k, s in enumerate(size) if s == 1), default=-1)
        run, waiting = 0, []
        for k, s in enumerate(size):
            if s == 0:
                run += 1
                continue
            while run > 15 and k <= end:
                bits.put(*table[0xF0])
                for b in waiting:
                    bits.put(b, 1)
                run, waiting = run - 16, []
            if s > 1:
                waiting.append(s & 1)
                continue
            bits.put(*table[run << 4 | 1])
            bits.put(row[k] > 0, 1)
            for b in waiting:
                bits.put(b, 1)
            run, waiting = 0, []
        if run or waiting:
            bits.put(*table[0])
            for b in waiting:
                bits.put(b, 1)
    return bits.done()


def encode(frame: Frame, dense: bool = False) -> bytes:
    """A progressive file in three parts: DC and its last bit, AC bands 1-5 and 6-63 without the last bit, the last bits.

    dense is for coefficients of 128 to 255 in size at every AC place: one symbol then serves for each kind of scan, so
    whole scans are put together at once.
    """
    out = [b"\xff\xd8"]
    if frame.comment:
        out.append(segment(0xFE, frame.comment))
    out.append(segment(0xDB, b"\0" + bytes(frame.components[0].quantisation.astype(np.uint8).tolist())))
    out.append(segment(0xC2, struct.pack(">BHHB", 8, frame.height, frame.width, len(frame.components)) + b"".join(bytes([i + 1, c.h << 4 | c.v, 0]) for i, c in enumerate(frame.components))))
    dc_lengths = {s: 4 for s in range(12)}
    dc = codes(dc_lengths)
    every = list(range(len(frame.components)))
    order = _scan_blocks(frame, every)
    values = _dc_values(frame, order)
    out += [huffman(0, 0, dc_lengths), scan_header(every, 0, 0, 0, 0, 1), stuffed(_dc_first(order[1], values >> 1, dc))]
    out += [scan_header(every, 0, 0, 0, 1, 0), stuffed(np.packbits(np.append((values & 1).astype(np.uint8), np.ones(-len(values) % 8, np.uint8))))]
    if dense:
        out.append(huffman(1, 0, {0x07: 1}))
    else:
        out.append(huffman(1, 0, GENERAL))
    for a, b in ((1, 5), (6, 63)):
        for i, c in enumerate(frame.components):
            band = c.coefficients[_own_blocks(c), a : b + 1]
            out.append(scan_header([i], 0, a, b, 0, 1))
            if dense:  # a zero bit for the symbol, then the size's seven bits, complemented below zero
                half = np.abs(band) >> 1
                out.append(stuffed(np.where(band > 0, half, 127 - half).astype(np.uint8).ravel()))
            else:
                out.append(stuffed(_ac_first(band, 1, codes(GENERAL))))
    if dense:
        out.append(huffman(1, 0, {0x00: 1}))
    for i, c in enumerate(frame.components):
        band = c.coefficients[_own_blocks(c), 1:64]
        out.append(scan_header([i], 0, 1, 63, 1, 0))
        if dense:  # a zero bit for the end of the block, then a correction bit for each coefficient
            out.append(stuffed(np.packbits(np.concatenate([np.zeros((len(band), 1), np.uint8), (np.abs(band) & 1).astype(np.uint8)], 1), axis=1).ravel()))
        else:
            out.append(stuffed(_ac_refine(band, 0, codes(GENERAL))))
    return b"".join([*out, b"\xff\xd9"])


class Reader:
    """Bits of an entropy-coded segment, and Huffman symbols."""

    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.left = data, 0, 0, 0

    def bits(self, n: int) -> int:
        while self.left < n:
            self.value = self.value << 8 | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at, self.left = self.at + 1, self.left + 8
        self.left -= n
        out = self.value >> self.left
        self.value &= (1 << self.left) - 1
        return out

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.bits(1)
            if (found := table.get((code, n))) is not None:
                return found
        raise ValueError("no such Huffman code")

    def number(self, n: int) -> int:
        v = self.bits(n)
        return v if n and v >> (n - 1) else v - (1 << n) + 1


@functools.lru_cache(maxsize=64)
def _lookup(table: tuple) -> tuple[int, np.ndarray, np.ndarray]:
    """Longest code, and by that many bits the symbol and its code's length (0: none)."""
    longest = max(n for (_, n), _ in table)
    symbol, length = np.zeros(1 << longest, np.int64), np.zeros(1 << longest, np.int64)
    for (code, n), s in table:
        at = slice(code << (longest - n), (code + 1) << (longest - n))
        symbol[at], length[at] = s, n
    return longest, symbol, length


def _dc_differences(data: np.ndarray, table: dict, count: int) -> np.ndarray:
    """`count` coded differences: the symbol that begins at each bit, then the chain of steps from the first bit on."""
    longest, symbol, length = _lookup(tuple(sorted(table.items())))
    bits = np.concatenate([np.unpackbits(data), np.ones(longest + 16, np.uint8)]).astype(np.int64)
    n = len(bits) - longest - 16
    window = np.zeros(n + 1, np.int64)
    for i in range(longest):
        window = window << 1 | bits[i : i + n + 1]
    step = (np.arange(n + 1) + length[window] + symbol[window]).tolist()
    at, chain = 0, []
    for _ in range(count):
        if at >= n:
            raise ValueError("scan ends early")
        chain.append(at)
        at = step[at]
    at = np.array(chain, np.int64)
    size, value = symbol[window[at]], np.zeros(count, np.int64)
    if (length[window[at]] == 0).any() or size.max(initial=0) > 15:
        raise ValueError("no such Huffman code")
    first = at + length[window[at]]
    for i in range(int(size.max(initial=0))):
        value = np.where(i < size, value << 1 | bits[np.minimum(first + i, len(bits) - 1)], value)
    return np.where((size == 0) | (value >> np.maximum(size - 1, 0) > 0), value, value - (1 << size) + 1)


def _decode_dc(segments: list[bytes], frame: Frame, chosen: list, restart: int, high: int, low: int) -> None:
    blocks, steps, per_unit = _scan_blocks(frame, [i for i, _, _ in chosen])
    size = restart * per_unit or len(blocks)
    for s, coded in zip(range(0, len(blocks), size), segments, strict=True):
        data, n = np.frombuffer(coded, np.uint8), min(size, len(blocks) - s)
        owned = [(frame.components[i].coefficients, t, own[(own >= s) & (own < s + n)] - s if restart else own) for (i, t, _), own in zip(chosen, steps, strict=True)]
        if high:
            got = np.unpackbits(data, count=n).astype(np.int16) << low
            for c, _, own in owned:
                c[blocks[s + own], 0] |= got[own]
        elif all(t == chosen[0][1] for _, t, _ in chosen):
            d = _dc_differences(data, chosen[0][1], n)
            for c, _, own in owned:
                c[blocks[s + own], 0] = np.cumsum(d[own]) << low
        else:
            reader, last, turn = Reader(coded), [0] * len(owned), np.empty(n, np.int64)
            for k, (_, _, own) in enumerate(owned):
                turn[own] = k
            for at, k in enumerate(turn.tolist()):
                last[k] += reader.number(reader.symbol(owned[k][1]))
                owned[k][0][blocks[s + at], 0] = last[k] << low


def _decode_ac(reader: Reader, c: Component, blocks: np.ndarray, table: dict, first: int, last: int, high: int, low: int) -> None:
    skip, one = 0, 1 << low
    for at in blocks.tolist():
        block, k = c.coefficients[at].tolist(), first

        def correct(k, block=block):
            if reader.bits(1):
                block[k] += one if block[k] > 0 else -one

        if skip == 0:
            while k <= last:
                run, n = divmod(reader.symbol(table), 16)
                if n == 0 and run < 15:
                    skip = (1 << run) + reader.bits(run)
                    break
                if not high:
                    k += run
                    if n:
                        block[k] = reader.number(n) << low
                    k += 1
                    continue
                new = (one if reader.bits(1) else -one) if n else 0
                while k <= last:
                    if block[k]:
                        correct(k)
                    elif run:
                        run -= 1
                    else:
                        if new:
                            block[k] = new
                        k += 1
                        break
                    k += 1
        if skip:
            if high:
                for j in range(k, last + 1):
                    if block[j]:
                        correct(j)
            skip -= 1
        c.coefficients[at] = block


def _dense(data: np.ndarray, c: Component, table: dict, first: int, last: int, high: int, low: int) -> bool:
    """Read a scan of fixed layout as a whole; False if its layout is another (the bits tell, one after the other)."""
    if len(table) != 1 or (symbol := next(iter(table.items())))[0] != (0, 1):
        return False
    own, width = _own_blocks(c), last - first + 1
    symbol = symbol[1]
    if not high and 0 < symbol < 16:
        n = len(own) * width * (symbol + 1)
        if len(data) != -(-n // 8):
            return False
        if symbol == 7:
            value = data.reshape(len(own), width).astype(np.int16)
            if (value > 127).any():
                return False
        else:
            bits = np.unpackbits(data, count=n).reshape(-1, symbol + 1)
            if bits[:, 0].any():
                return False
            value = (bits[:, 1:] @ (1 << np.arange(symbol)[::-1])).astype(np.int16).reshape(len(own), width)
        value = np.where(value >> (symbol - 1), value, value - (1 << symbol) + 1)
        c.coefficients[own, first : last + 1] = value << low
        return True
    if high and symbol == 0 and (c.coefficients[own, first : last + 1] != 0).all():
        n = len(own) * (width + 1)
        if len(data) != -(-n // 8):
            return False
        bits = np.unpackbits(data, count=n).reshape(len(own), width + 1)
        if bits[:, 0].any():
            return False
        band = c.coefficients[own, first : last + 1]
        c.coefficients[own, first : last + 1] = band + np.sign(band) * (bits[:, 1:].astype(np.int16) << low)
        return True
    return False


def decode(data: bytes) -> Frame:
    """The accumulated coefficients of a progressive file (8-bit, Huffman-coded)."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, frame, comment, restart = 2, None, b"", 0
    quantisation: dict[int, np.ndarray] = {}
    tables: dict[tuple[int, int], dict] = {}
    slots: list[int] = []
    while True:
        marker = data[at + 1]
        if data[at] != 0xFF:
            raise ValueError(f"no marker at {at}")
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            comment = body
        elif marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                quantisation[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int32)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                counts = body[1:17]
                symbols, code, table = iter(body[17 : 17 + sum(counts)]), 0, {}
                for n, count in enumerate(counts, 1):
                    code <<= 1
                    for _ in range(count):
                        table[code, n] = next(symbols)
                        code += 1
                tables[body[0] >> 4, body[0] & 15] = table
                body = body[17 + sum(counts) :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xC2:
            _, height, width, n = struct.unpack(">BHHB", body[:6])
            frame = Frame.blank(width, height, [(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(n)])
            slots = [body[8 + 3 * i] for i in range(n)]
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("not a progressive Huffman-coded file")
        elif marker == 0xDA:
            n = body[0]
            chosen = [(body[1 + 2 * i] - 1, tables.get((0, body[2 + 2 * i] >> 4), {}), tables.get((1, body[2 + 2 * i] & 15), {})) for i in range(n)]
            first, last, approximation = body[1 + 2 * n : 4 + 2 * n]
            high, low = approximation >> 4, approximation & 15
            end = at
            while True:
                end = data.index(b"\xff", end)
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                    continue
                break
            segments, at = [x.replace(b"\xff\x00", b"\xff") for x in re.split(rb"\xff[\xd0-\xd7]", data[at:end])], end
            if first == 0:
                _decode_dc(segments, frame, chosen, restart, high, low)
                continue
            c, table = frame.components[chosen[0][0]], chosen[0][2]
            if len(segments) > 1 or not _dense(np.frombuffer(segments[0], np.uint8), c, table, first, last, high, low):
                own = _own_blocks(c)
                step = restart or len(own)
                for s, coded in zip(range(0, len(own), step), segments, strict=True):
                    _decode_ac(Reader(coded), c, own[s : s + step], table, first, last, high, low)
    for c, slot in zip(frame.components, slots, strict=True):
        c.quantisation = quantisation[slot]
    frame.comment = comment
    return frame
