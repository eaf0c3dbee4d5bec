"""Media columns: motion-JPEG clips in AVI files, written, indexed, decoded and cut into shots.

A payload is stored as quantised DCT coefficients, the unit of a JPEG block: 64 bytes are one 8x8 block of a grey
baseline frame. Every coefficient has size category 8, so that its eight amplitude bits are the payload byte, and the
Huffman tables have one code of one bit. Restart markers after every block keep DC differences from adding up. Any
baseline JPEG decoder can read such frames; ours takes a vectorised way for these tables and a bit-by-bit one for others.

Clips: frames of FRAME_BYTES payload bytes, FPS frames a second. A shot ends where the histogram difference of two
frames exceeds both MIN_CUT and the mean plus CUT_SIGMA deviations of the WINDOW differences before it.

Cases: a null or empty text is one block of zeros; rows with equal texts give equal values; a damaged or foreign file
raises ValueError in the reader functions and gives no clip rows in `clips`; null media give no rows; further columns
of the input are ignored; an empty table gives an empty one; very long texts are one file each, coded GROUP frames at a time.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_batches, written

WIDTH = HEIGHT = 32
BLOCKS = WIDTH * HEIGHT // 64
FRAME_BYTES = BLOCKS * 64
FPS = 10
BINS = 16
#: So many frames are coded or decoded at a time, which bounds memory on long payloads.
GROUP = 256
WINDOW, CUT_SIGMA, MIN_CUT = 8, 2.0, 0.25

# The zigzag order of baseline JPEG (ITU T.81, figure A.6), made from its rule.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))


def _idct() -> np.ndarray:
    """64x64: a block's zigzag coefficients times this are its samples, less the level shift."""
    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(0.5), 1)[None, :] / 2
    full = np.einsum("yv,xu->vuyx", basis, basis).reshape(64, 64)
    return full[ZIGZAG].astype(np.float32)


IDCT = _idct()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_ONE_CODE = bytes([1] + [0] * 15) + b"\x08"
_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, b"\x00" + b"\x01" * 64)
    + _segment(0xC0, struct.pack(">BHHB", 8, HEIGHT, WIDTH, 1) + b"\x01\x11\x00")
    + _segment(0xC4, b"\x00" + _ONE_CODE + b"\x10" + _ONE_CODE)
    + _segment(0xDD, struct.pack(">H", 1))
    + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def pad(data: bytes) -> bytes:
    """Zeros appended up to a positive multiple of 64."""
    return data + b"\0" * (64 if not data else -len(data) % 64)


def _scans(payload: bytes) -> list[bytes]:
    """Entropy-coded segments of the frames that hold the payload."""
    frames = -(-len(payload) // FRAME_BYTES)
    full = np.zeros(frames * FRAME_BYTES, np.uint8)
    full[: len(payload)] = np.frombuffer(payload, np.uint8)
    bits = np.zeros((full.size, 9), np.uint8)  # a zero bit is the code, then the amplitude
    bits[:, 1:] = np.unpackbits(full).reshape(-1, 8)
    coded = np.packbits(bits)
    size = 1 + (coded == 0xFF)
    size[71::72] += 2  # a marker after each block
    at = np.cumsum(size) - size
    out = np.zeros(int(at[-1] + size[-1]), np.uint8)
    out[at] = coded
    ends = at[71::72] + 1 + (coded[71::72] == 0xFF)
    out[ends] = 0xFF
    out[ends + 1] = 0xD0 + np.arange(ends.size) % BLOCKS % 8
    last = ends[BLOCKS - 1 :: BLOCKS]
    starts = np.concatenate([[0], last[:-1] + 2])
    return [out[a:b].tobytes() for a, b in zip(starts, last)]


def write_avi(payload: bytes) -> bytes:
    """A payload of a positive multiple of 64 bytes as an AVI file."""
    step = GROUP * FRAME_BYTES
    frames = [_HEAD + scan + b"\xff\xd9" for at in range(0, len(payload), step) for scan in _scans(payload[at : at + step])]
    biggest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, biggest * FPS, 0, 0x10, len(frames), 0, 1, biggest, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, FPS, 0, len(frames), biggest, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", WIDTH * HEIGHT, 0, 0, 0, 0)
    movi, index, at = [], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        movi.append(c)
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        at += len(c)
    body = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    body += _chunk(b"plen", struct.pack("<Q", len(payload))) + _list(b"movi", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", b"AVI " + body)


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > end:
            raise ValueError("a RIFF chunk ends behind its file")
        yield kind, at + 8, at + 8 + size
        at += 8 + size + size % 2


def parse_avi(data: bytes) -> tuple[list[bytes], float, int | None]:
    """The frames named by the index (or, without one, all of the movie list), seconds a frame, payload length."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    frames, second, length, movi, index = [], 1 / FPS, None, None, None
    for kind, a, b in _chunks(data, 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])):
        if kind == b"LIST" and data[a : a + 4] == b"hdrl":
            for k, x, y in _chunks(data, a + 4, b):
                if k == b"avih" and y - x >= 4:
                    second = struct.unpack_from("<I", data, x)[0] / 1e6
        elif kind == b"LIST" and data[a : a + 4] == b"movi":
            movi = (a, b)
        elif kind == b"idx1":
            index = (a, b)
        elif kind == b"plen" and b - a == 8:
            length = struct.unpack_from("<Q", data, a)[0]
    if movi is None:
        raise ValueError("no movie list")
    if index:
        for x in range(index[0], index[1] - 15, 16):
            kind, _, offset, size = struct.unpack_from("<4sIII", data, x)
            if kind[2:] in (b"dc", b"db"):
                at = movi[0] + offset if data[movi[0] + offset : movi[0] + offset + 4] == kind else offset  # some writers count from the file's start
                if at + 8 + size > len(data):
                    raise ValueError("the index points behind the file")
                frames.append(data[at + 8 : at + 8 + size])
    else:
        frames = [data[x:y] for k, x, y in _chunks(data, movi[0] + 4, movi[1]) if k[2:] in (b"dc", b"db")]
    return frames, second, length


def _huffman(body: bytes) -> dict[tuple[int, int], dict[tuple[int, int], int]]:
    """Tables of a DHT segment: (class, id) to {(length, code): symbol}."""
    tables, at = {}, 0
    while at + 17 <= len(body):
        which, counts = body[at], body[at + 1 : at + 17]
        at, code, table = at + 17, 0, {}
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                table[length, code] = body[at]
                at, code = at + 1, code + 1
            code <<= 1
        tables[which >> 4, which & 15] = table
    return tables


_FIXED = {(1, 0): 8}


def _fixed_blocks(scan: bytes) -> np.ndarray:
    """Payload bytes of a scan with one-bit codes and a restart after each block."""
    raw = np.frombuffer(scan, np.uint8)
    keep = np.ones(raw.size, bool)
    marks = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[marks + 1]
    keep[marks[after != 0]] = False
    keep[marks + 1] = False
    coded = raw[keep]
    if coded.size % 72:
        raise ValueError("a damaged scan")
    return np.packbits(np.unpackbits(coded).reshape(-1, 9)[:, 1:])


def _slow_blocks(scan: bytes, comps: list, tables: dict, restart: int, mcus: int) -> np.ndarray:
    """Coefficients of the first component's blocks, bit by bit: for any baseline tables and samplings."""
    parts, at = [], 0
    for i in range(len(scan) - 1):
        if scan[i] == 0xFF and 0xD0 <= scan[i + 1] <= 0xD7:
            parts.append(scan[at:i])
            at = i + 2
    parts.append(scan[at:])
    out, done = [], 0
    for part in parts:
        bits = np.unpackbits(np.frombuffer(part.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist()
        pos, dc = 0, [0] * len(comps)

        def symbol(table):
            nonlocal pos
            code = 0
            for length in range(1, 17):
                if pos >= len(bits):
                    raise ValueError("a scan ends early")
                code, pos = code << 1 | bits[pos], pos + 1
                if (length, code) in table:
                    return table[length, code]
            raise ValueError("no such Huffman code")

        def amplitude(size):
            nonlocal pos
            v = 0
            for b in bits[pos : pos + size]:
                v = v << 1 | b
            pos += size
            return v if not size or v >> (size - 1) else v - (1 << size) + 1

        for _ in range(min(restart or mcus, mcus - done)):
            for c, (blocks, dc_table, ac_table) in enumerate(comps):
                for _ in range(blocks):
                    block = [0] * 64
                    dc[c] += amplitude(symbol(tables[0, dc_table]))
                    block[0], k = dc[c], 1
                    while k < 64:
                        s = symbol(tables[1, ac_table])
                        if s == 0:
                            break
                        k += s >> 4
                        if s & 15 and k < 64:
                            block[k] = amplitude(s & 15)
                        k += 1
                    if c == 0:
                        out.append(block)
            done += 1
    return np.array(out, np.int32).reshape(-1, 64)


@functools.lru_cache(64)
def _head_of(jpeg: bytes) -> tuple:
    """What the segments before the scan say: size, components, quantisation and Huffman tables, restart interval, scan header, its end."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    tables, quant, comps, restart, at, size, body = {}, {}, [], 0, 2, (0, 0), b""
    while at + 4 <= len(jpeg):
        marker, length = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xDB:
            while body:
                n = 128 if body[0] >> 4 else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if n == 128 else np.uint8).astype(np.float32)
                body = body[1 + n :]
        elif marker == 0xC0:
            size = struct.unpack_from(">HH", body, 1)
            comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames")
        elif marker == 0xC4:
            tables |= _huffman(body)
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            break
    if not comps or not body:
        raise ValueError("no frame or scan header")
    which = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
    return size, comps, quant, tables, restart, which, at


def _scan_coefs(scan: bytes, head: tuple) -> np.ndarray:
    """Quantised zigzag coefficients of the first component, blocks x 64."""
    size, comps, _, tables, restart, which, _ = head
    one = len(comps) == 1
    if one and restart == 1 and all(t == _FIXED for t in tables.values()):
        got = _fixed_blocks(scan).reshape(-1, 64).astype(np.int16)
        return np.where(got >= 128, got, got - 255)
    h, v = (1, 1) if one else (max(c[1] for c in comps), max(c[2] for c in comps))
    mcus = -(-size[1] // (8 * h)) * -(-size[0] // (8 * v))
    return _slow_blocks(scan, [(1 if one else c[1] * c[2], *which[c[0]]) for c in comps], tables, restart, mcus)


def decode_frames(frames: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients and samples (uint8) of the first component of each frame, both frames x blocks x 64.

    Frames that all begin with our own header are decoded in one go.
    """
    if all(f.startswith(_HEAD) for f in frames):
        head = _head_of(_HEAD)
        coefs = _scan_coefs(b"".join(f[len(_HEAD) : -2] for f in frames), head)
    else:
        heads = [_head_of(f) for f in frames]
        head = heads[0]
        if any(h[0] != head[0] for h in heads):
            raise ValueError("frames of several sizes")
        coefs = np.concatenate([_scan_coefs(f[h[-1] : f.rindex(b"\xff\xd9")], h) * h[2][h[1][0][3]].astype(np.int32) for f, h in zip(frames, heads)])
    scaled = coefs.astype(np.float32) @ IDCT
    scaled += 128.5
    samples = np.clip(scaled, 0, 255).astype(np.uint8)
    return coefs.reshape(len(frames), -1, 64), samples.reshape(len(frames), -1, 64)


def read_payload(coefs: np.ndarray) -> bytes:
    """The payload bytes that write_avi put into these coefficients."""
    return (np.where(coefs < 0, coefs + 255, coefs)).astype(np.uint8).tobytes()


def shots(histograms: np.ndarray) -> list[tuple[int, int]]:
    """First and last frame of each shot, by adaptive differences of normalised histograms."""
    if not len(histograms):
        return []
    share = histograms / np.maximum(histograms.sum(1, keepdims=True), 1)
    diff = np.abs(np.diff(share, axis=0)).sum(1) / 2
    cuts, start = [], 0
    for i, d in enumerate(diff):
        before = diff[max(start, i - WINDOW) : i]
        if d >= MIN_CUT and (not before.size or d > before.mean() + CUT_SIGMA * before.std()):
            cuts.append((start, i))
            start = i + 1
    return [*cuts, (start, len(histograms) - 1)]


def read_avi(data: bytes) -> dict:
    """All that is read back from a stored file: payload (None for a foreign one), frames, seconds a frame, shots, histograms."""
    frames, second, length = parse_avi(data)
    if not frames:
        return {"payload": b"" if length == 0 else None, "frames": 0, "second": second, "shots": [], "histograms": np.zeros((0, BINS), np.int64)}
    payload, histograms = [], []
    for at in range(0, len(frames), GROUP):
        coefs, samples = decode_frames(frames[at : at + GROUP])
        n = len(samples)
        bins = (samples.reshape(n, -1) >> 4) + np.arange(0, n * BINS, BINS)[:, None]
        histograms.append(np.bincount(bins.ravel(), minlength=n * BINS).reshape(n, BINS))
        if length is not None:
            payload.append(read_payload(coefs))
    got = None if length is None else b"".join(payload)[:length]
    if length is not None and len(got) != length:
        raise ValueError("frames are missing")
    histograms = np.concatenate(histograms)
    return {"payload": got, "frames": len(frames), "second": second, "shots": shots(histograms), "histograms": histograms}


def to_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each whole text stored as an AVI file in a binary column of a table, written and opened again."""
    kind = df.schema[key].dataType.simpleString()
    names = [key, "n_bytes", "media"]

    def run(batches):
        schema = None
        for b in batches:
            schema = pa.schema([(key, b.column(0).type), ("n_bytes", pa.int64()), ("media", pa.binary())])
            rows = ((k, len(d), write_avi(pad(d))) for k, d in zip(b.column(0).to_pylist(), ((x.as_py() or "").encode("utf-8", "surrogatepass") for x in b.column(1))))
            yield from in_batches(rows, schema, lambda r: len(r[2]) + 64)

    return written(df.select(df[key], df[text]).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in zip(names, (kind, "bigint", "binary")))), "media")


def features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests and the shot string of each stored file, from its bytes as read back."""
    kind = media.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"

    def row(k, n, data):
        got = read_avi(data)
        p = got["payload"]
        cut = ",".join(f"{a}-{b}" for a, b in got["shots"])
        spread = hashlib.sha256(got["histograms"].astype("<i8").tobytes()).hexdigest()[:16]
        return (k, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(data), hashlib.sha256(data).hexdigest(), f"frames={got['frames']};shots={cut};histograms={spread}")

    def run(batches):
        for b in batches:
            schema = pa.schema([(key, b.column(0).type), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
            rows = (row(k.as_py(), n.as_py(), m.as_py()) for k, n, m in zip(*b.columns))
            yield from in_batches(rows, schema)

    return media.select(key, "n_bytes", "media").mapInArrow(run, out)


def clips(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """Timed clip rows of any AVI files: (key, clip, first_frame, last_frame, start_s, end_s)."""
    kind = media.schema[key].dataType.simpleString()

    def rows(batch):
        for k, m in zip(*batch.columns):
            try:
                got = read_avi(m.as_py()) if m.is_valid else None
            except (ValueError, KeyError, struct.error):
                got = None
            for i, (a, z) in enumerate(got["shots"] if got else ()):
                yield k.as_py(), i, a, z, a * got["second"], (z + 1) * got["second"]

    def run(batches):
        for b in batches:
            schema = pa.schema([(key, b.column(0).type), ("clip", pa.int32()), ("first_frame", pa.int32()), ("last_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())])
            yield from in_batches(rows(b), schema)

    return media.select(key, column).mapInArrow(run, f"`{key}` {kind}, clip int, first_frame int, last_frame int, start_s double, end_s double")
