"""Media columns (3): baseline JPEG written and read in numpy, many blocks at a time.

Reading follows the format: markers are parsed, byte stuffing is undone, and the Huffman-coded scan
is decoded for all restart segments of all images in lockstep: each step decodes one symbol of every
segment. Grey and interleaved colour images with any sampling factors are read. The
luminance DC terms alone give an eighth-size thumbnail, which is stored as a hash with the dimensions.

Writing stores bytes without loss in the format's own unit, the quantised coefficient: 64 bytes are
the 64 coefficients of one block in zigzag order, all quantisers are 1, and a byte is moved past zero
so that no coefficient vanishes. Each block is its own restart segment, so any part can be decoded
independently. A text takes about ten times its bytes while it is read back, and texts are read in runs of bounded size, a long one
alone.

Edge cases: null and empty texts are a payload of 64 zero bytes; equal texts give equal rows; an
empty table gives an empty result; clashing columns of the input are replaced by the added ones.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_text, spans_by_size

#: Blocks that are coded together.
SLICE = 8192
#: Texts are taken in runs of about this many characters.
RUN_CHARS = 500_000

# Code lengths of this writer's Huffman tables. AC symbols are run * 16 + size; text
# bytes fall on sizes 1 to 4 and 7. The all-ones code stays free, as the format demands.
DC_LENGTHS = {size: 4 for size in range(12)}
AC_LENGTHS = {0x04: 2, 0x03: 2, 0x02: 3, 0x01: 3, 0x07: 3, 0x05: 5, 0x06: 5, 0x08: 5, 0x00: 6, 0xF0: 7}
#: The byte value at which coefficients change sign.
PIVOT = 110


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Code and length of each symbol; codes of one length count up, and a longer one continues them."""
    codes, code, last = {}, 0, 0
    for symbol, length in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= length - last
        codes[symbol] = (code, length)
        code, last = code + 1, length
    return codes


def dht(kind: int, lengths: dict[int, int]) -> bytes:
    order = sorted(lengths.items(), key=lambda x: x[1])
    counts = bytes(sum(n == k for _, n in order) for k in range(1, 17))
    return bytes([kind]) + counts + bytes(s for s, _ in order)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def geometry(blocks: int) -> tuple[int, int]:
    """Width and height in blocks; the format allows 8191 either way."""
    wide = min(blocks, max(128, -(-blocks // 8191)))
    return wide, -(-blocks // wide)


def _code_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each byte value as DC and as AC term: code with its extra bits, and their length."""
    dc, ac = canonical(DC_LENGTHS), canonical(AC_LENGTHS)
    out = [np.zeros(256, np.uint64) for _ in range(4)]
    for byte in range(256):
        value = byte - PIVOT if byte > PIVOT else byte - PIVOT - 1
        size = abs(value).bit_length()
        extra = value if value > 0 else value + (1 << size) - 1
        for at, (code, length) in ((0, dc[size]), (2, ac[size])):
            out[at][byte], out[at + 1][byte] = code << size | extra, length + size
    return tuple(out)


_TABLES = _code_tables()
_BLANK = (canonical(DC_LENGTHS)[0], canonical(AC_LENGTHS)[0x00])


def encode_blocks(data: np.ndarray, blank: np.ndarray, marks: np.ndarray) -> bytes:
    """Entropy-coded segments of blocks of 64 bytes; ``marks`` is the marker after each, or 0."""
    n = len(data)
    dc_code, dc_len, ac_code, ac_len = _TABLES
    code, length = ac_code[data], ac_len[data]
    code[:, 0], length[:, 0] = dc_code[data[:, 0]], dc_len[data[:, 0]]
    if blank.any():
        code[blank], length[blank] = 0, 0
        for at, (c, k) in enumerate(_BLANK):
            code[blank, at], length[blank, at] = c, k
    ends = np.cumsum(length, axis=1)
    bits = ends[:, -1]
    size = (bits + np.uint64(7)) // np.uint64(8)
    first = np.cumsum(size) - size
    at = (first[:, None] * np.uint64(8) + ends - length).ravel()
    code, length = code.ravel(), length.ravel()
    word = (at >> np.uint64(5)).astype(np.int64)
    shifted = code << (np.uint64(64) - (at & np.uint64(31)) - np.maximum(length, np.uint64(1)))
    words = int(size.sum()) // 4 + 3
    packed = np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), words) + np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    raw = packed.astype(np.uint32).astype(">u4").view(np.uint8)[: int(size.sum())]
    last = (first + size - np.uint64(1)).astype(np.int64)
    raw[last] |= ((1 << ((8 - bits % np.uint64(8)) % np.uint64(8)).astype(np.int64)) - 1).astype(np.uint8)
    room = 1 + (raw == 0xFF).astype(np.int64)
    room[last] += 2 * (marks > 0)
    place = np.cumsum(room) - room
    out = np.zeros(int(room.sum()), np.uint8)
    out[place] = raw
    stop = (np.cumsum(room)[last] - 2)[marks > 0]
    out[stop], out[stop + 1] = 0xFF, marks[marks > 0]
    return out.tobytes()


def write_jpeg(payload: bytes) -> bytes:
    """A grey baseline image holding the payload, whose length is a positive multiple of 64."""
    data = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    wide, high = geometry(len(data))
    total = wide * high
    head = [
        b"\xff\xd8", segment(0xEC, b"payload\x00" + struct.pack(">Q", len(payload))), segment(0xDB, b"\x00" + b"\x01" * 64),
        segment(0xC0, struct.pack(">BHHBBBB", 8, high * 8, wide * 8, 1, 1, 0x11, 0)), segment(0xC4, dht(0x00, DC_LENGTHS) + dht(0x10, AC_LENGTHS)),
        segment(0xDD, struct.pack(">H", 1)), segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ]
    for lo in range(0, total, SLICE):
        hi = min(total, lo + SLICE)
        part = data[lo:hi]
        blank = np.arange(lo, hi) >= len(data)
        if blank.any():
            part = np.concatenate([part, np.full((hi - lo - len(part), 64), 255, np.uint8)])
        marks = 0xD0 + np.arange(lo, hi) % 8
        marks[np.arange(lo, hi) == total - 1] = 0
        head.append(encode_blocks(part, blank, marks))
    return b"".join([*head, b"\xff\xd9"])


@dataclass
class Frame:
    """What the markers say, and where the scan lies."""

    width: int
    height: int
    parts: tuple  # (horizontal, vertical, quantiser, DC table, AC table) by component
    interval: int
    quantisers: dict
    tables: tuple  # (class and number, counts and symbols), sorted
    notes: dict
    start: int

    @property
    def layout(self) -> tuple:
        return self.parts, self.tables, self.interval

    def grid(self) -> tuple[int, int, int, int]:
        """MCUs across and down, and the luminance's blocks across and down."""
        if len(self.parts) == 1:
            across, down = -(-self.width // 8), -(-self.height // 8)
            return across, down, across, down
        most_h, most_v = max(p[0] for p in self.parts), max(p[1] for p in self.parts)
        across, down = -(-self.width // (8 * most_h)), -(-self.height // (8 * most_v))
        return across, down, across * self.parts[0][0], down * self.parts[0][1]


def parse(image: bytes) -> Frame:
    """Walk the markers up to the scan; ValueError if this isn't a baseline image with one scan."""
    if image[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at, interval, quantisers, tables, notes, size, parts = 2, 0, {}, {}, {}, None, []
    while True:
        if at + 4 > len(image) or image[at] != 0xFF:
            raise ValueError("no marker where one is due")
        marker = image[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        length = struct.unpack_from(">H", image, at + 2)[0]
        body = image[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                step = 128 if wide else 64
                quantisers[body[k] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, k + 1)
                k += 1 + step
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                tables[body[k]] = body[k + 1 : k + 17 + n]
                k += 17 + n
        elif marker in (0xC0, 0xC1):
            bits, high, wide, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("samples aren't 8 bits")
            size = wide, high
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not baseline")
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker in (0xEC, 0xFE):
            notes[marker] = body
        elif marker == 0xDA:
            if not size or body[0] != len(parts):
                raise ValueError("the scan doesn't hold all components")
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            found = tuple((h, v, q, chosen[c] >> 4, chosen[c] & 15) for c, h, v, q in parts)
            return Frame(*size, found, interval, quantisers, tuple(sorted(tables.items())), notes, at)


def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits that may come next: symbol * 32 + code length, 0 if no code fits."""
    out = np.zeros(65536, np.int32)
    code, k = 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            out[code << (16 - length) : (code + 1) << (16 - length)] = table[k] * 32 + length
            code, k = code + 1, k + 1
        code <<= 1
    return out


_luts: dict[bytes, np.ndarray] = {}


def _lut(table: bytes) -> np.ndarray:
    if table not in _luts:
        if len(_luts) > 64:
            _luts.clear()
        _luts[table] = _lookup(table)
    return _luts[table]


def decode_segments(data: np.ndarray, start: np.ndarray, stop: np.ndarray, mcus: np.ndarray, layout: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients in zigzag order of all blocks, segment after segment, and each segment's first block.

    ``data`` is free of stuffing and ends in at least 8 spare bytes.
    """
    parts, tables, _ = layout
    tables = dict(tables)
    units = [0] if len(parts) == 1 else [c for c, p in enumerate(parts) for _ in range(p[0] * p[1])]
    blocks = mcus * len(units)
    first = np.cumsum(blocks) - blocks
    out = np.zeros((int(blocks.sum()), 64), np.int16)
    bit = start.astype(np.int64) * 8
    limit = stop.astype(np.int64) * 8
    wide = data.astype(np.uint32)
    window = (wide[:-4] << 24) | (wide[1:-3] << 16) | (wide[2:-2] << 8) | wide[3:-1]
    before = np.zeros((len(parts), len(start)), np.int64)

    def take(rows: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next symbol of each row and the value of its extra bits."""
        at = bit[rows]
        word = window[at >> 3] << (at & 7).astype(np.uint32)
        found = lut[word >> np.uint32(16)]
        if not found.all():
            raise ValueError("no such code")
        length, symbol = found & 31, found >> 5
        size = symbol & 15
        at = at + length
        raw = ((window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(16)).astype(np.int64) >> (16 - size)
        at += size
        if (at > limit[rows]).any():
            raise ValueError("a segment ends too soon")
        bit[rows] = at
        return symbol, np.where(size == 0, 0, np.where(raw >> np.maximum(size - 1, 0) == 1, raw, raw - (1 << size) + 1))

    for step in range(int(blocks.max(initial=0))):
        part = units[step % len(units)]
        dc, ac = _lut(tables[parts[part][3]]), _lut(tables[0x10 | parts[part][4]])
        rows = np.flatnonzero(blocks > step)
        _, value = take(rows, dc)
        before[part, rows] += value
        out[first[rows] + step, 0] = before[part, rows]
        k = np.ones(len(rows), np.int64)
        while len(rows):
            symbol, value = take(rows, ac)
            run, size = symbol >> 4, symbol & 15
            k += run
            if (k > 63)[size > 0].any():
                raise ValueError("a block is too long")
            some = size > 0
            out[first[rows[some]] + step, k[some]] = value[some]
            k += 1
            go = (k < 64) & (some | (run == 15))
            rows, k = rows[go], k[go]
    return out, first


def read_jpegs(images: list[bytes]) -> list[tuple[Frame, np.ndarray]]:
    """Each image's frame and its blocks' coefficients, MCU after MCU."""
    frames = [parse(i) for i in images]
    done: list[np.ndarray | None] = [None] * len(images)
    groups: dict[tuple, list[int]] = {}
    for k, frame in enumerate(frames):
        groups.setdefault(frame.layout, []).append(k)
    for layout, members in groups.items():
        scans = [np.frombuffer(images[k], np.uint8)[frames[k].start :] for k in members]
        data = np.concatenate([*scans, np.zeros(8, np.uint8)])
        ends = np.cumsum([len(s) for s in scans])
        begins = ends - [len(s) for s in scans]
        after = np.append(data[1:], 0)
        lead = data == 0xFF
        mark = np.flatnonzero(lead & (after >= 0xD0) & (after <= 0xD9))
        keep = np.ones(len(data), bool)
        keep[np.flatnonzero(lead & (after == 0)) + 1] = False
        keep[mark] = keep[mark + 1] = False
        keep[-8:] = True
        dropped = np.flatnonzero(~keep)
        place = lambda at, gone=dropped: at - np.searchsorted(gone, at)  # noqa: E731  where a byte goes, without stuffing and markers
        owner = np.searchsorted(ends, mark, "right")
        final = after[mark] == 0xD9
        seg_stop = place(mark)
        seg_start = np.empty_like(seg_stop)
        seg_start[1:] = seg_stop[:-1]
        fresh = np.ones(len(mark), bool)
        fresh[1:] = owner[1:] != owner[:-1]
        seg_start[fresh] = place(begins[owner[fresh]])
        if np.bincount(owner[final], minlength=len(members)).tolist() != [1] * len(members):
            raise ValueError("a scan doesn't end once")
        mcus = np.zeros(len(mark), np.int64)
        order = np.arange(len(mark)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        total = np.array([frames[k].grid()[0] * frames[k].grid()[1] for k in members])[owner]
        step = np.where(layout[2] > 0, layout[2], total)
        mcus = np.clip(total - order * step, 0, step)
        clean = data[keep]
        cuts = list(range(0, len(mark), SLICE)) + [len(mark)]
        found, per = [], 1 if len(layout[0]) == 1 else sum(p[0] * p[1] for p in layout[0])
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            a, b = int(seg_start[lo]), int(seg_stop[hi - 1])
            found.append(decode_segments(np.concatenate([clean[a:b], np.zeros(8, np.uint8)]), seg_start[lo:hi] - a, seg_stop[lo:hi] - a, mcus[lo:hi], layout)[0])
        blocks = np.concatenate(found) if found else np.zeros((0, 64), np.int16)
        sizes = [frames[k].grid()[0] * frames[k].grid()[1] * per for k in members]
        at = 0
        for k, n in zip(members, sizes, strict=True):
            done[k] = blocks[at : at + n]
            at += n
        if at != len(blocks):
            raise ValueError("segments are missing")
    return list(zip(frames, done, strict=True))


def thumbnail(frame: Frame, blocks: np.ndarray) -> np.ndarray:
    """The luminance at an eighth of the size, from the DC terms alone."""
    across, down, wide, high = frame.grid()
    if len(frame.parts) == 1:
        dc = blocks[:, 0].reshape(high, wide)
    else:
        h, v = frame.parts[0][:2]
        per = sum(p[0] * p[1] for p in frame.parts)
        dc = blocks[:, 0].reshape(down, across, per)[:, :, : h * v].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(high, wide)
    dc = dc[: -(-frame.height // 8), : -(-frame.width // 8)].astype(np.float32)
    scaled = dc * float(frame.quantisers[frame.parts[0][2]][0]) / 8 + 128
    return np.clip(np.rint(scaled), 0, 255).astype(np.uint8)


def thumbnail_hash(thumb: np.ndarray, side: int = 8) -> str:
    """Which of side x side areas are brighter than the whole on average, as hexadecimal digits; short sides repeat points."""
    rows = np.arange(side) * thumb.shape[0] // side
    columns = np.arange(side) * thumb.shape[1] // side
    sums = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), rows, 0), columns, 1)
    counts = np.outer(*[np.maximum(np.diff(at, append=n), 1) for at, n in zip((rows, columns), thumb.shape, strict=True)])
    return np.packbits((sums * thumb.size > int(thumb.sum(dtype=np.int64)) * counts).ravel()).tobytes().hex()


def read_payload(frame: Frame, blocks: np.ndarray) -> bytes:
    size = struct.unpack(">Q", frame.notes[0xEC][8:16])[0]
    values = blocks[: size // 64].ravel()
    if not values.all():
        raise ValueError("a stored byte is missing")
    return (values + np.where(values > 0, PIVOT, PIVOT + 1).astype(np.int16)).astype(np.uint8).tobytes()


def pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def media_columns(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, with_media: bool = False) -> DataFrame:
    """Store each whole text as an image, read it back and describe it; ``with_media`` adds the image."""

    def kernel():
        def apply(texts: list[str]) -> list[pa.Array]:
            rows: list[tuple] = []
            for lo, hi in spans_by_size(texts, RUN_CHARS):
                raws = [t.encode("utf-8", "surrogatepass") for t in texts[lo:hi]]
                images = [write_jpeg(pad(r)) for r in raws]
                for raw, image, (frame, blocks) in zip(raws, images, read_jpegs(images), strict=True):
                    payload = read_payload(frame, blocks)
                    feature = f"{frame.width}x{frame.height}:{thumbnail_hash(thumbnail(frame, blocks))}"
                    rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), feature, image if with_media else None))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            return [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)][: 7 + with_media]

        return apply

    names = [("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]
    fields = [T.StructField(n, k) for n, k in names] + ([T.StructField("media", T.BinaryType())] if with_media else [])
    return map_text(docs, kernel, fields, text_col, keep)
