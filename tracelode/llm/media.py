"""Media columns in baseline JPEG: lossless storage of bytes as coefficients, and a decoder in numpy.

Samples of a JPEG do not survive its transform, but its quantised coefficients
do: they are stored exactly, by Huffman coding. So the format's unit here is a
coefficient. A payload byte b is the coefficient 256 + b, 64 of them fill a
block in zigzag order, and every block is a restart interval of its own. All
coefficients are then in magnitude category 9, for which the file's Huffman
tables (they belong to the file) have a code of one bit: 10 bits for a byte.

The decoder reads any baseline file (8 bits, one scan, any tables, sampling and
restart interval): it parses the markers, then decodes all restart intervals of
a batch in step, one coefficient of each at a time, by table lookup in numpy.
The DC coefficients alone give a luminance thumbnail, a pixel for each block.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

BLOCK = 64
#: A side has 65,535 samples at most, which is 8,191 whole blocks.
SIDE = 8191
#: Lanes decoded in step; bounds the memory of a batch whatever its texts' length.
LANES = 1 << 14
#: Payload bytes encoded or decoded together.
BATCH_BYTES = 1 << 21


class MediaError(ValueError):
    """The bytes are not a baseline JPEG that this decoder reads."""


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: Huffman tables of stored payloads: one code of one bit for category 9, one of two bits for end-of-block.
_TABLES = (
    _segment(0xC4, bytes([0x00, 1, *[0] * 15, 0x09])) + _segment(0xC4, bytes([0x10, 1, 1, *[0] * 14, 0x09, 0x00]))
)
_QUANT = _segment(0xDB, bytes([0, *[1] * 64]))


def pad(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))


def encode_payload(raw: bytes) -> bytes:
    """The JPEG that stores the padded bytes, and how many were there before."""
    blocks = np.frombuffer(pad(raw), np.uint8).reshape(-1, BLOCK)
    n = len(blocks)
    high = -(-n // SIDE)
    wide = -(-n // high)
    if high > SIDE:
        raise MediaError("the payload needs more than 8,191 x 8,191 blocks")
    if wide * high > n:
        blocks = np.concatenate([blocks, np.zeros((wide * high - n, BLOCK), np.uint8)])
    v = (blocks.astype(np.uint64) | np.uint64(256)).reshape(-1, 4)
    bits = v[:, 0] << np.uint64(30) | v[:, 1] << np.uint64(20) | v[:, 2] << np.uint64(10) | v[:, 3]
    scan = np.empty((len(blocks), 82), np.uint8)
    scan[:, :80] = bits.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].reshape(-1, 80)
    scan[:, 80] = 0xFF
    scan[:, 81] = 0xD0 + (np.arange(len(blocks)) & 7)
    scan[-1, 81] = 0xD9
    body = scan.reshape(-1)
    stuffed = np.flatnonzero((scan[:, :80] == 0xFF).any(axis=1))
    if len(stuffed):
        at = np.flatnonzero(body == 0xFF)
        body = np.insert(body, at[at % 82 < 80] + 1, 0)
    head = (
        b"\xff\xd8"
        + _segment(0xFE, struct.pack(">8sQ", b"payload\0", len(raw)))
        + _QUANT
        + _segment(0xC0, struct.pack(">BHHBBBB", 8, high * 8, wide * 8, 1, 1, 0x11, 0))
        + _TABLES
        + _segment(0xDD, struct.pack(">H", 1))
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )
    return head + body.tobytes()


@dataclass
class Parsed:
    """What the markers of a file say, and where its scan is."""

    width: int = 0
    height: int = 0
    restart: int = 0
    payload: int | None = None
    quant: dict[int, bytes] = field(default_factory=dict)
    huffman: dict[int, bytes] = field(default_factory=dict)
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, across, down, quant table
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # index of part, DC table, AC table
    start: int = 0

    def mcu(self) -> list[tuple[int, int, int]]:
        """The blocks of a minimum coded unit: part, DC table, AC table."""
        if len(self.scan) == 1:
            return list(self.scan)
        return [s for s in self.scan for _ in range(self.parts[s[0]][1] * self.parts[s[0]][2])]

    def grid(self) -> tuple[int, int]:
        """Units across and down."""
        p = self.parts[self.scan[0][0]]
        most = [max(x[k] for x in self.parts) for k in (1, 2)]
        if len(self.scan) == 1:
            return -(-(-(-self.width * p[1] // most[0])) // 8), -(-(-(-self.height * p[2] // most[1])) // 8)
        return -(-self.width // (8 * most[0])), -(-self.height // (8 * most[1]))


def parse(data: bytes) -> Parsed:
    """Read the markers up to the scan."""
    if data[:2] != b"\xff\xd8":
        raise MediaError("no start of image")
    out, at = Parsed(), 2
    try:
        while True:
            if data[at] != 0xFF:
                raise MediaError("a marker is missing")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            size = struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xC0:
                if body[0] != 8:
                    raise MediaError("not 8 bits a sample")
                out.height, out.width, n = struct.unpack_from(">HHB", body, 1)
                out.parts = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * n, 3)]
            elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise MediaError("not a baseline frame")
            elif marker == 0xC4:
                k = 0
                while k < len(body):
                    n = sum(body[k + 1 : k + 17])
                    out.huffman[body[k]] = body[k + 1 : k + 17 + n]
                    k += 17 + n
            elif marker == 0xDB:
                k = 0
                while k < len(body):
                    wide = 64 * (1 + (body[k] >> 4))
                    out.quant[body[k] & 15] = body[k + 1 : k + 1 + wide]
                    k += 1 + wide
            elif marker == 0xDD:
                out.restart = struct.unpack_from(">H", body)[0]
            elif marker == 0xFE and body[:8] == b"payload\0":
                out.payload = struct.unpack_from(">Q", body, 8)[0]
            elif marker == 0xDA:
                ids = [p[0] for p in out.parts]
                out.scan = [(ids.index(body[k]), body[k + 1] >> 4, 0x10 | body[k + 1] & 15) for k in range(1, 1 + 2 * body[0], 2)]
                if len(out.scan) != len(out.parts) or not out.parts or not out.width or not out.height:
                    raise MediaError("not one scan with all parts")
                if any(s[k] not in out.huffman for s in out.scan for k in (1, 2)) or any(p[3] not in out.quant or not p[1] * p[2] for p in out.parts):
                    raise MediaError("a table is missing")
                out.start = at
                return out
    except (IndexError, struct.error, ValueError) as e:
        raise e if isinstance(e, MediaError) else MediaError("the header is cut short") from e


def _lookup(table: bytes) -> np.ndarray:
    """For 16 bits ahead: code length << 8 | symbol; 0 where no code fits."""
    out, code, k = np.zeros(1 << 16, np.int32), 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            if k >= len(table) or (code + 1) << (16 - length) > 1 << 16:
                raise MediaError("a Huffman table is wrong")
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | table[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


class _Bits:
    """Bits at many places at once."""

    def __init__(self, data: np.ndarray):
        b = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
        self.last = len(data)
        self.window = (b[:-3] << np.uint32(24) | b[1:-2] << np.uint32(16) | b[2:-1] << np.uint32(8) | b[3:]).astype(np.int64)

    def peek(self, at: np.ndarray) -> np.ndarray:
        """16 bits."""
        return self.window[np.minimum(at >> 3, self.last)] >> (16 - (at & 7)) & 0xFFFF


def _value(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The number of a magnitude category and its extra bits."""
    raw = bits >> (16 - size)
    return np.where(raw << 1 < (1 << size), raw - (1 << size) + 1, raw)


def decode_lanes(data: np.ndarray, start: np.ndarray, units: np.ndarray, mcu: list[tuple[int, int, int]], huffman: dict[int, bytes]) -> np.ndarray:
    """Coefficients as [64, blocks] in zigzag order: lane after lane, and in a lane its units' blocks in order.

    data: scan bytes without stuffing and markers; start: the byte at which each
    lane begins; units: how many units a lane has.
    """
    tables = {k: _lookup(huffman[k]) for s in mcu for k in s[1:]}
    bits, at = _Bits(data), start.astype(np.int64) * 8
    per_lane = units * len(mcu)
    first = np.cumsum(per_lane) - per_lane
    out = np.zeros((BLOCK, int(per_lane.sum())), np.int16)
    before = np.zeros((max(s[0] for s in mcu) + 1, len(start)), np.int64)
    for unit in range(int(units.max(initial=0))):
        lanes = np.flatnonzero(units > unit)
        for k, (part, dc, ac) in enumerate(mcu):
            rows, pos = first[lanes] + unit * len(mcu) + k, at[lanes]
            code = tables[dc][bits.peek(pos)]
            if not code.all():
                raise MediaError("no code fits")
            pos += code >> 8
            size = code & 15
            before[part, lanes] += _value(bits.peek(pos), size)
            pos += size
            out[0, rows] = before[part, lanes]
            at[lanes] = pos
            alive, own, n = lanes, rows, np.ones(len(lanes), np.int64)
            while len(alive):
                code = tables[ac][bits.peek(pos)]
                if not code.all():
                    raise MediaError("no code fits")
                pos += code >> 8
                symbol = code & 0xFF
                size, n = symbol & 15, n + (symbol >> 4)
                ended = symbol == 0
                if ended.any():
                    at[alive[ended]] = pos[ended]
                    stay = ~ended
                    alive, own, pos, n, size = alive[stay], own[stay], pos[stay], n[stay], size[stay]
                    if not len(alive):
                        break
                if (n > 63).any():
                    raise MediaError("a block has too many coefficients")
                out[n, own] = _value(bits.peek(pos), size)
                pos += size
                n += 1
                if n.max() > 63:
                    full = n > 63
                    at[alive[full]] = pos[full]
                    alive, own, pos, n = alive[~full], own[~full], pos[~full], n[~full]
    return out


def _scan(data: bytes, p: Parsed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The scan without stuffing and markers, where its restart intervals begin, and the units of each."""
    body = np.frombuffer(data, np.uint8, offset=p.start)
    marks = np.flatnonzero(body[:-1] == 0xFF)
    follows = body[marks + 1]
    ends = marks[(follows != 0) & (follows & 0xF8 != 0xD0) & (follows != 0xFF)]
    end = int(ends[0]) if len(ends) else len(body)
    marks, follows = marks[marks < end], follows[marks < end]
    keep = np.ones(end, bool)
    restarts = marks[follows & 0xF8 == 0xD0]
    keep[restarts] = keep[np.minimum(restarts + 1, end - 1)] = False
    keep[np.minimum(marks[follows == 0] + 1, end - 1)] = False
    place = np.cumsum(keep) - keep
    start = np.r_[0, place[np.minimum(restarts + 1, end - 1)]].astype(np.int64) if end else np.zeros(1, np.int64)
    across, down = p.grid()
    total = across * down
    each = p.restart or total
    n = -(-total // each)
    if len(start) < n:
        raise MediaError("the scan is cut short")
    units = np.full(n, each)
    units[-1] = total - each * (n - 1)
    return body[:end][keep], start[:n], units


@dataclass
class Decoded:
    """A decoded file: its coefficients of the first part as [blocks, 64] and its thumbnail."""

    parsed: Parsed
    coefficients: np.ndarray
    thumbnail: np.ndarray


def decode_many(files: list[bytes]) -> list[Decoded | MediaError]:
    """Decode files together; those with the same tables and units are decoded in step."""
    out: list = [None] * len(files)
    groups: dict = {}
    for k, data in enumerate(files):
        try:
            p = parse(data)
            body, start, units = _scan(data, p)
        except MediaError as e:
            out[k] = e
            continue
        groups.setdefault((tuple(p.mcu()), tuple(sorted(p.huffman.items()))), []).append((k, p, body, start, units))
    for (mcu, huffman), members in groups.items():
        try:
            blocks = _decode_group(members, list(mcu), dict(huffman))
        except MediaError:  # one bad file must not spoil the others
            blocks = []
            for m in members:
                try:
                    blocks += _decode_group([m], list(mcu), dict(huffman))
                except MediaError as e:
                    blocks.append(e)
        for (k, p, *_), got in zip(members, blocks, strict=True):
            out[k] = got if isinstance(got, MediaError) else Decoded(p, *_first_part(p, got))
    return out


def _decode_group(members: list, mcu: list, huffman: dict[int, bytes]) -> list[np.ndarray]:
    sizes = np.array([len(m[2]) for m in members])
    data = np.concatenate([m[2] for m in members])
    start = np.concatenate([m[3] + o for m, o in zip(members, np.cumsum(sizes) - sizes, strict=True)])
    units = np.concatenate([m[4] for m in members])
    done = [decode_lanes(data, start[a : a + LANES], units[a : a + LANES], mcu, huffman) for a in range(0, len(start), LANES)]
    blocks = np.ascontiguousarray(np.concatenate(done, axis=1).T)
    cuts = np.cumsum([int(m[4].sum()) * len(mcu) for m in members])[:-1]
    return np.split(blocks, cuts)


def _first_part(p: Parsed, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first part's blocks, and its DC coefficients as a picture of 8-bit luminance."""
    mcu, (across, down) = p.mcu(), p.grid()
    mine = [k for k, s in enumerate(mcu) if s[0] == 0]
    own = blocks.reshape(across * down, len(mcu), BLOCK)[:, mine]
    _, h, v, q = p.parts[0]
    h, v = (1, 1) if len(p.scan) == 1 else (h, v)
    step = p.quant[q][0] if len(p.quant[q]) == 64 else struct.unpack(">H", p.quant[q][:2])[0]
    dc = own[:, :, 0].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    most_h, most_v = max(x[1] for x in p.parts), max(x[2] for x in p.parts)
    wide, high = -(-p.width * p.parts[0][1] // (8 * most_h)), -(-p.height * p.parts[0][2] // (8 * most_v))
    light = np.clip(np.rint(dc.astype(np.int64) * step / 8) + 128, 0, 255).astype(np.uint8)
    return own.reshape(-1, BLOCK), light[:high, :wide]


def payload_of(d: Decoded) -> bytes:
    """The stored bytes with their padding."""
    if d.parsed.payload is None:
        raise MediaError("no payload is stored in this file")
    n = max(BLOCK, -(-d.parsed.payload // BLOCK) * BLOCK)
    flat = d.coefficients.reshape(-1)[:n] - 256
    if len(flat) < n or (flat < 0).any() or (flat > 255).any():
        raise MediaError("the coefficients are not a payload")
    return flat.astype(np.uint8).tobytes()


def thumbnail_hash(light: np.ndarray) -> str:
    """64 bits: is a cell of an 8 x 9 grid of mean luminance darker than the next one in its row?"""
    rows = (np.arange(9) * light.shape[0] / 8).astype(int)
    cols = (np.arange(10) * light.shape[1] / 9).astype(int)
    total = np.zeros((light.shape[0] + 1, light.shape[1] + 1), np.int64)
    total[1:, 1:] = light.astype(np.int64).cumsum(0).cumsum(1)
    top, bottom = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1)
    left, right = cols[:-1], np.maximum(cols[1:], cols[:-1] + 1)
    cell = total[np.ix_(bottom, right)] - total[np.ix_(top, right)] - total[np.ix_(bottom, left)] + total[np.ix_(top, left)]
    area = np.outer(bottom - top, right - left)
    mean = cell * 4096 // area
    return np.packbits(mean[:, :-1] < mean[:, 1:]).tobytes().hex()


def _chunks(items: list[bytes]) -> Iterator[list[bytes]]:
    chunk, size = [], 0
    for x in items:
        chunk.append(x)
        size += len(x)
        if size >= BATCH_BYTES:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column("text")]
        for chunk in _chunks(texts):
            media = pa.array([encode_payload(x) for x in chunk], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(chunk)), media], names=["doc_id", "media"])
            at += len(chunk)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id and media: each text's UTF-8 bytes in a JPEG. A null text is stored as an empty one; other columns are ignored."""
    return docs.select("doc_id", "text").mapInArrow(_store, "doc_id long, media binary")


FEATURES = (
    "doc_id long, width int, height int, thumbnail_hash string, error string, n_bytes long, payload_bytes long, "
    "payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
)


def _feature_row(data: bytes | None, got: Decoded | MediaError | None) -> tuple:
    if data is None:
        return (None, None, None, "null", *[None] * 7)
    own = (len(data), hashlib.sha256(data).hexdigest())
    if not isinstance(got, Decoded):
        return (None, None, None, str(got), None, None, None, None, *own, None)
    p, mark = got.parsed, thumbnail_hash(got.thumbnail)
    feature = f"{p.width}x{p.height}:{mark}:{zlib.crc32(got.thumbnail.tobytes()):08x}"
    try:
        raw = payload_of(got)
    except MediaError as e:
        return (p.width, p.height, mark, None if p.payload is None else str(e), None, None, None, None, *own, feature)
    return (p.width, p.height, mark, None, p.payload, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-BLOCK:]), *own, feature)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = re.findall(r"(\w+) \w+", FEATURES)
    for batch in batches:
        ids, at = batch.column("doc_id"), 0
        media = batch.column("media").to_pylist()
        for chunk in _chunks([m or b"" for m in media]):
            whole = media[at : at + len(chunk)]
            rows = [_feature_row(m, d) for m, d in zip(whole, decode_many(chunk), strict=True)]
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([ids.slice(at, len(chunk)), *arrays], names=names)
            at += len(chunk)


def media_features(media: DataFrame) -> DataFrame:
    """Dimensions, thumbnail hash, and what is stored, of every row of (doc_id, media).

    Bytes that are null or no baseline JPEG keep their row: ``error`` says why
    and the other features are null. Equal bytes have equal features.
    """
    return media.select("doc_id", "media").mapInArrow(_read, FEATURES)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text stored as a JPEG, read back, and its features."""
    return media_features(store_texts(table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )
