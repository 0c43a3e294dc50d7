import random
import struct

import numpy as np
import pytest
from conftest import SMALL

from tracelode.llm import media as M


def test_round_trip():
    r = random.Random(1)
    raws = [b"", b"a", b"x" * 63, b"y" * 64, b"z" * 65, bytes(range(256)) * 3, b"\xff" * 500, r.randbytes(64 * (M.SIDE + 3)), "é" .encode() * 999]
    for raw, got in zip(raws, M.decode_many([M.encode_payload(x) for x in raws]), strict=True):
        assert M.payload_of(got) == M.pad(raw) and got.parsed.payload == len(raw)
    assert len(M.pad(b"")) == 64 and len(M.pad(b"x" * 64)) == 64


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, code):
        self.text += code

    def number(self, v):
        size = abs(v).bit_length()
        return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    def bytes(self):
        text = self.text + "1" * (-len(self.text) % 8)
        return b"".join(bytes([int(text[k : k + 8], 2)]) + (b"\0" if text[k : k + 8] == "1" * 8 else b"") for k in range(0, len(text), 8))


def plain_jpeg(parts, units, blocks, restart):
    """A baseline file with 8-bit fixed-length codes; blocks: coefficient lists in file order with their part."""
    symbols = list(range(255))  # symbol s has code s
    table = lambda n: M._segment(0xC4, bytes([n, *[0] * 7, 255, *[0] * 8, *symbols]))
    across, down = units
    h, v = max(p[0] for p in parts), max(p[1] for p in parts)
    head = b"\xff\xd8" + M._segment(0xDB, bytes([0, *[8] * 64]))
    head += M._segment(0xC0, struct.pack(">BHHB", 8, down * v * 8, across * h * 8, len(parts)) + b"".join(bytes([k + 1, a << 4 | b, 0]) for k, (a, b) in enumerate(parts)))
    head += table(0) + table(16) + (M._segment(0xDD, struct.pack(">H", restart)) if restart else b"")
    head += M._segment(0xDA, bytes([len(parts), *[x for k in range(len(parts)) for x in (k + 1, 0)], 0, 63, 0]))
    out, per = b"", len(blocks) // (across * down)
    for start in range(0, across * down, restart or across * down):
        bits, before = Bits(), [0] * len(parts)
        for part, c in blocks[start * per : (start + (restart or across * down)) * per]:
            size, extra = bits.number(c[0] - before[part])
            before[part] = c[0]
            bits.put(format(size, "08b") + extra)
            run, last = 0, max((k for k in range(1, 64) if c[k]), default=0)
            for k in range(1, last + 1):
                if not c[k]:
                    run += 1
                    continue
                while run > 15:
                    bits.put(format(0xF0, "08b"))
                    run -= 16
                size, extra = bits.number(c[k])
                bits.put(format(run << 4 | size, "08b") + extra)
                run = 0
            if last < 63:
                bits.put(format(0, "08b"))
        out += bits.bytes() + (b"\xff" + bytes([0xD0 + start // restart % 8]) if restart and start + restart < across * down else b"")
    return head + out + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 1, 3])
@pytest.mark.parametrize("parts", [[(1, 1)], [(2, 1), (1, 1), (1, 1)], [(2, 2), (1, 1), (1, 1)]])
def test_other_files(parts, restart):
    r = random.Random(5)
    units = (3, 2)
    mcu = [0] if len(parts) == 1 else [k for k, (a, b) in enumerate(parts) for _ in range(a * b)]
    blocks = [(part, [r.randrange(-100, 100)] + [r.choice([0, 0, 0, 0, 0, r.randrange(-60, 60)]) for _ in range(63)]) for _ in range(6) for part in mcu]
    got = M.decode_many([plain_jpeg(parts, units, blocks, restart)])[0]
    assert isinstance(got, M.Decoded), got
    assert got.coefficients.tolist() == [c for part, c in blocks if part == 0]
    h, v = (1, 1) if len(parts) == 1 else parts[0]
    assert got.thumbnail.shape == (2 * v, 3 * h)
    assert got.thumbnail[0, 0] == np.clip(blocks[0][1][0] + 128, 0, 255)
    with pytest.raises(M.MediaError):
        M.payload_of(got)


def test_bad_files_keep_their_rows(spark):
    good = M.encode_payload(b"hello")
    progressive = good.replace(b"\xff\xc0", b"\xff\xc2", 1)
    rows = [(1, bytearray(good)), (2, bytearray(b"no")), (3, None), (4, bytearray(good[:60])), (5, bytearray(progressive)), (None, bytearray(good)), (6, bytearray(good[:-40]))]
    got = {r.doc_id: r for r in M.media_features(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert len(got) == 7 and got[1].error is None and got[1].n_bytes == 5 and got[None].payload_sha256 == got[1].payload_sha256
    assert all(got[k].error for k in (2, 3, 4, 5))


def test_query4(spark):
    import hashlib
    import zlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = M.op4_media_columns(spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        raw = M.pad((docs[r.doc_id] or "").encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(docs[r.doc_id].encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))


def test_nulls_and_clashes(spark):
    df = spark.createDataFrame([(1, None, "m"), (None, "", "m"), (1, None, "m")], "doc_id long, text string, media string")
    got = M.media_features(M.store_texts(df)).collect()
    assert {r.n_bytes for r in got} == {0} and len({r.media_sha256 for r in got}) == 1 and len(got) == 3
    assert M.media_features(M.store_texts(df.where("false"))).count() == 0
