"""Media columns: baseline JPEG in a binary column.

``read_media`` parses the markers of each image, Huffman-decodes its scans and
rebuilds the luminance thumbnail from the DC terms alone (one sample for each
8 x 8 block); it stores dimensions, the thumbnail and hashes of it. Decoding
runs in step over all restart intervals of a batch of images: each interval is
a lane with its own bit position, and one numpy operation advances all lanes.

``store_samples`` writes bytes losslessly as such images: a byte is the sample
of a flat 8 x 8 block, i.e. a DC term of quantizer 8, so the DC-only thumbnail
of the image is the stored payload. The number of payload bytes stands in a
comment segment. Payloads over 64 MiB become several frames in one value.

Defined results: a null text is stored as one block row of padding; a null or
damaged image (or one that is not baseline) has null dimensions and its reason
in ``error``; no row is dropped. Equal bytes give equal values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, utf8

#: Payloads are padded to a multiple of this many bytes, 24 x 24 samples.
UNIT = 576
#: Blocks in a restart interval, most samples in a frame.
RESTART, FRAME = 72, 1 << 26
#: Fixed values of the JPEG standard (Annex K): code lengths' counts and symbols of the luminance DC table.
DC_COUNTS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_SYMBOLS = bytes(range(12))
#: The only AC symbol written is the end of block, in one bit.
AC_COUNTS, AC_SYMBOLS = bytes([1] + [0] * 15), bytes([0])


def canonical(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for every 16-bit prefix; length 0 marks an unused code."""
    symbol, length = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    code, k = 0, 0
    for bits in range(1, 17):
        for _ in range(counts[bits - 1]):
            lo, hi = code << (16 - bits), (code + 1) << (16 - bits)
            if hi > 1 << 16 or k >= len(symbols):
                raise ValueError("bad Huffman table")
            symbol[lo:hi], length[lo:hi] = symbols[k], bits
            code, k = code + 1, k + 1
        code <<= 1
    return symbol, length


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """Code and length of a block with DC difference d (at index d + 255) and no AC term."""
    symbol, length = canonical(DC_COUNTS, DC_SYMBOLS)
    code, size = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        at = int(np.flatnonzero((symbol == category) & (length > 0))[0])
        bits = int(length[at])
        extra = d if d >= 0 else d + (1 << category) - 1
        code[d + 255] = (((at >> (16 - bits)) << category) | extra) << 1
        size[d + 255] = bits + category + 1
    return code, size


CODE, SIZE = _codes()


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _shape(samples: int) -> tuple[int, int]:
    """Thumbnail width and height for a frame: 24 wide while the height fits, wider beyond."""
    wide = 24 * max(1, -(-samples // (24 * 8160)))
    return wide, -(-samples // wide)


def _header(wide: int, high: int, samples: int) -> bytes:
    return b"".join([
        b"\xff\xd8",
        _segment(0xFE, b"samples=%d" % samples),
        _segment(0xDB, bytes([0, 8]) + bytes([1] * 63)),
        _segment(0xC0, bytes([8]) + (high * 8).to_bytes(2, "big") + (wide * 8).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])),
        _segment(0xC4, bytes([0x00]) + DC_COUNTS + DC_SYMBOLS),
        _segment(0xC4, bytes([0x10]) + AC_COUNTS + AC_SYMBOLS),
        _segment(0xDD, RESTART.to_bytes(2, "big")),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


def encode(payloads: list[np.ndarray]) -> list[bytes]:
    """JPEG bytes for each payload (uint8 samples); all of a batch are coded together."""
    frames, owner = [], []
    for i, p in enumerate(payloads):
        for at in range(0, max(1, len(p)), FRAME):
            frames.append(p[at : at + FRAME])
            owner.append(i)
    shapes = [_shape(len(f)) for f in frames]
    blocks = np.array([w * h for w, h in shapes], np.int64)
    start = np.concatenate([[0], np.cumsum(blocks)])
    samples = np.full(start[-1], 255, np.int16)
    for f, a in zip(frames, start):
        samples[a : a + len(f)] = f
    # Intervals: lengths in blocks, first block of each, and which one ends a frame.
    per = -(-blocks // RESTART)
    frame_of = np.repeat(np.arange(len(frames)), per)
    nth = np.arange(len(frame_of)) - np.repeat(np.cumsum(per) - per, per)
    first = start[frame_of] + nth * RESTART
    ends = np.append(first[1:], start[-1])
    diff = np.empty(len(samples), np.int64)
    diff[1:] = samples[1:] - samples[:-1]
    diff[first] = samples[first] - 128
    code, size = CODE[diff + 255], SIZE[diff + 255]
    total = np.concatenate([[0], np.cumsum(size)])
    bits = total[ends] - total[first]
    room = -(-bits // 8)
    base = np.concatenate([[0], np.cumsum(room)])
    pos = total[:-1] + np.repeat(base[:-1] * 8 - total[first], ends - first)
    value = code << (24 - (pos & 7) - size)
    at = pos >> 3
    n = int(base[-1])
    out = np.bincount(at, value >> 16, n + 3) + np.bincount(at + 1, (value >> 8) & 255, n + 3) + np.bincount(at + 2, value & 255, n + 3)
    out = out[:n].astype(np.uint8)
    out[base[1:] - 1] |= ((1 << (room * 8 - bits)) - 1).astype(np.uint8)
    full = out == 255
    stuffed = np.concatenate([[0], np.cumsum(full)])
    shift = np.repeat(np.arange(len(room)) * 2, room)
    data = np.zeros(n + int(stuffed[-1]) + 2 * len(room), np.uint8)
    data[np.arange(n) + stuffed[:-1] + shift] = out
    close = base[1:] + stuffed[base[1:]] + np.arange(len(room)) * 2
    data[close] = 255
    last = nth == per[frame_of] - 1
    data[close + 1] = np.where(last, 0xD9, 0xD0 + nth % 8)
    cut = np.concatenate([[0], close[last] + 2])
    media: list[list[bytes]] = [[] for _ in payloads]
    for k, (f, (w, h)) in enumerate(zip(frames, shapes)):
        media[owner[k]] += [_header(w, h, len(f)), data[cut[k] : cut[k + 1]].tobytes()]
    return [b"".join(m) for m in media]


class Frame:
    """What the markers of one image say, and where its entropy-coded intervals lie."""

    def __init__(self) -> None:
        self.width = self.height = self.samples = None
        self.parts: list[tuple[int, int, int, int]] = []  # id, h, v, quantizer
        self.quant: dict[int, int] = {}  # DC quantizer by table
        self.scans: list[tuple] = []  # (components, dc and ac tables, intervals)


def parse(data: bytes) -> tuple[list[Frame], str | None]:
    """The frames of a value. The second part is a reason if it can't be read as baseline JPEG."""
    raw = np.frombuffer(data, np.uint8)
    marks = np.flatnonzero((raw[:-1] == 255) & (raw[1:] != 0) & (raw[1:] != 255)) if len(raw) > 1 else np.zeros(0, int)
    frames: list[Frame] = []
    at, n = 0, len(data)
    frame: Frame | None = None
    tables: dict[int, tuple[bytes, bytes]] = {}
    restart = 0
    while at + 1 < n:
        if data[at] != 0xFF:
            return frames, "no marker where one must stand"
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        at += 2
        if marker == 0xD8:
            frame, tables, restart = Frame(), {}, 0
            frames.append(frame)
            continue
        if marker == 0xD9:
            continue
        if frame is None or at + 2 > n:
            return frames, "no start of image"
        size = int.from_bytes(data[at : at + 2], "big")
        body = data[at + 2 : at + size]
        if size < 2 or at + size > n:
            return frames, "a segment is cut off"
        at += size
        if marker == 0xFE and body.startswith(b"samples=") and body[8:].isdigit():
            frame.samples = int(body[8:])
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                frame.quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while len(body) > 17:
                count = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + count])
                body = body[17 + count :]
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xC0:
            if body[0] != 8:
                return frames, "not 8 bits a sample"
            frame.height, frame.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            frame.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            if not frame.width or not frame.height or not frame.parts or any(not h or not v for _, h, v, _ in frame.parts):
                return frames, "no dimensions"
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            return frames, "not baseline"
        elif marker == 0xDA:
            ids = {p[0]: k for k, p in enumerate(frame.parts)}
            chosen = [(ids.get(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(body[0])]
            if not chosen or any(k is None or (t >> 4) not in tables or 16 + (t & 15) not in tables for k, t in chosen):
                return frames, "a scan without its tables"
            spans = []
            k = int(np.searchsorted(marks, at))
            while True:
                end = int(marks[k]) if k < len(marks) else n
                spans.append((at, end))
                at = end
                if k < len(marks) and 0xD0 <= data[end + 1] <= 0xD7:
                    at, k = end + 2, k + 1
                    continue
                break
            frame.scans.append(([k for k, _ in chosen], [(tables[t >> 4], tables[16 + (t & 15)]) for _, t in chosen], restart, spans))
    if not frames:
        return frames, "no start of image"
    if any(f.width is None or not f.scans for f in frames):
        return frames, "no scan"
    return frames, None


def _run_lanes(raw: np.ndarray, first: np.ndarray, last: np.ndarray, blocks: np.ndarray, pattern: list[tuple[int, tuple, tuple]]) -> tuple[np.ndarray, np.ndarray]:
    """DC differences of each lane's blocks (lane after lane), and which lanes ended whole.

    ``pattern``: for each block of an MCU its component in the scan, DC table and AC table.
    Each step reads one symbol of every lane that is not done.
    """
    # Stuffed zeros go; every lane keeps eight spare bytes of ones behind it.
    lanes = len(first)
    length = last - first
    start = np.concatenate([[0], np.cumsum(length)])
    index = np.arange(start[-1]) + np.repeat(first - start[:-1], length)
    body = raw[index]
    keep = np.ones(len(body), bool)
    keep[1:] = ~((body[1:] == 0) & (body[:-1] == 255))
    heads = start[:-1][length > 0]
    keep[heads] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    size = kept[start[1:]] - kept[start[:-1]]
    room = np.concatenate([[0], np.cumsum(size + 8)])
    buffer = np.full(int(room[-1]) + 8, 255, np.uint32)
    buffer[np.arange(int(kept[-1])) + np.repeat(room[:-1] - kept[start[:-1]], size)] = body[keep]
    window = (buffer[:-3] << np.uint32(24)) | (buffer[1:-2] << np.uint32(16)) | (buffer[2:-1] << np.uint32(8)) | buffer[3:]
    pos, limit = room[:-1] * 8, (room[:-1] + size) * 8

    kinds = {t: k for k, t in enumerate(dict.fromkeys(t for _, dc, ac in pattern for t in (dc, ac)))}
    made = [canonical(*t) for t in kinds]
    symbols, lengths = np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])
    dc_table = np.array([kinds[dc] for _, dc, _ in pattern], np.int64) << 16
    ac_table = np.array([kinds[ac] for _, _, ac in pattern], np.int64) << 16

    out_at = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros(int(out_at[-1]), np.int64)
    whole = np.ones(lanes, bool)
    lane = np.flatnonzero(blocks > 0)
    p, k, b = pos[lane], np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
    where, stop, many = out_at[:-1][lane], limit[lane], blocks[lane]
    while len(lane):
        kind = b % len(pattern) if len(pattern) > 1 else np.zeros(len(lane), np.int64)
        table = np.where(k == 0, dc_table[kind], ac_table[kind])
        peek = ((window[p >> 3] << (p & 7).astype(np.uint32)) >> np.uint32(16)).astype(np.int64) + table
        s, used = symbols[peek].astype(np.int64), lengths[peek].astype(np.int64)
        p += used
        dc = k == 0
        category = np.where(dc, s, s & 15)
        bits = ((window[np.minimum(p >> 3, len(window) - 1)] << (p & 7).astype(np.uint32)) >> np.uint32(16)).astype(np.int64) >> (16 - np.minimum(category, 16))
        p += category
        value = np.where(bits >> np.maximum(category - 1, 0) != 0, bits, bits - (1 << category) + 1)
        out[(where + b)[dc]] = np.where(category > 0, value, 0)[dc]
        run = s >> 4
        k = np.where(dc, 1, np.where(s == 0, 64, k + run + 1))
        broken = (used == 0) | (p > stop) | (k > 64) | (dc & (s > 11))
        done = k >= 64
        b += done
        k[done] = 0
        go = (b < many) & ~broken
        if not go.all():
            whole[lane[broken]] = False
            lane, p, k, b, where, stop, many = lane[go], p[go], k[go], b[go], where[go], stop[go], many[go]
    return out, whole


def thumbnails(images: list[bytes | None]) -> list[tuple[list[tuple[int, int, np.ndarray, int | None]], str | None]]:
    """For each value its frames as (width, height, thumbnail, samples) and a reason if it can't be read."""
    parsed = [parse(x) if x is not None else ([], "null") for x in images]
    groups: dict[tuple, list] = {}
    buffers, offset = [], 0
    for i, (frames, why) in enumerate(parsed):
        if why is None:
            for j, f in enumerate(frames):
                for parts, tables, restart, spans in f.scans:
                    if 0 in parts:  # only scans that hold the luminance
                        hv = tuple((f.parts[k][1], f.parts[k][2]) for k in parts)
                        groups.setdefault((tuple(parts), hv, tuple(tables)), []).append((i, j, offset, restart, spans))
            buffers.append(np.frombuffer(images[i], np.uint8))
            offset += len(images[i])
    raw = np.concatenate(buffers) if buffers else np.zeros(0, np.uint8)
    reasons = [why for _, why in parsed]
    got: dict[tuple[int, int], np.ndarray] = {}
    for (parts, hv, tables), members in groups.items():
        alone = len(parts) == 1
        pattern = [(c, *tables[c]) for c, (h, v) in enumerate(hv) for _ in range(1 if alone else h * v)]
        first, last, blocks, sizes = [], [], [], []
        for i, j, base, restart, spans in members:
            f = parsed[i][0][j]
            top_h, top_v = max(p[1] for p in f.parts), max(p[2] for p in f.parts)
            if alone:
                wide, high = -(-f.width * hv[0][0] // (8 * top_h)), -(-f.height * hv[0][1] // (8 * top_v))
            else:
                wide, high = -(-f.width // (8 * top_h)), -(-f.height // (8 * top_v))
            mcus = wide * high
            each = restart or mcus
            count = -(-mcus // each)
            if len(spans) < count:
                reasons[i] = "intervals are missing"
            for n, (a, z) in enumerate(spans[:count]):
                first.append(base + a)
                last.append(base + z)
                blocks.append((min(each, mcus - n * each)) * len(pattern))
            sizes.append((wide, high, min(count, len(spans))))
        diffs, whole = _run_lanes(raw, np.array(first, np.int64), np.array(last, np.int64), np.array(blocks, np.int64), pattern)
        start = np.concatenate([[0], np.cumsum(blocks)])
        lane = 0
        mine = np.array([c for c, *_ in pattern]) == parts.index(0)
        h, v = (1, 1) if alone else hv[parts.index(0)]
        for (i, j, *_), (wide, high, count) in zip(members, sizes):
            a, z = start[lane], start[lane + count]
            if not whole[lane : lane + count].all():
                reasons[i] = "the scan is damaged"
            d = diffs[a:z].reshape(-1, len(pattern))[:, mine].reshape(-1)
            # Prediction starts anew in each interval.
            c = np.cumsum(d)
            heads = (start[lane : lane + count] - a) // len(pattern) * int(mine.sum())
            heads = heads[heads < len(c)]
            before = np.where(heads > 0, c[heads - 1], 0)
            c -= np.repeat(before, np.diff(np.append(heads, len(c))))
            lane += count
            if reasons[i]:
                continue
            f = parsed[i][0][j]
            q = f.quant.get(f.parts[0][3], 1)
            y = np.clip((c * q + 4 >> 3) + 128, 0, 255).astype(np.uint8)
            y = y.reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h)
            got[i, j] = y[: -(-f.height // 8) if v == 1 else None, : -(-f.width // 8) if h == 1 else None]
    out = []
    for i, (frames, _) in enumerate(parsed):
        if reasons[i] is None and any((i, j) not in got for j in range(len(frames))):
            reasons[i] = "no luminance scan"
        out.append(([(f.width, f.height, got[i, j], f.samples) for j, f in enumerate(frames)] if reasons[i] is None else [], reasons[i]))
    return out


def thumbnail_hash(y: np.ndarray) -> int:
    """64 bits: whether each cell of an 8 x 8 grid of means is over the grid's mean."""
    rows, cols = np.linspace(0, y.shape[0], 9).astype(int), np.linspace(0, y.shape[1], 9).astype(int)
    total = np.zeros((y.shape[0] + 1, y.shape[1] + 1))
    total[1:, 1:] = y.cumsum(0, dtype=np.float64).cumsum(1)
    area = np.maximum(np.diff(rows), 1)[:, None] * np.maximum(np.diff(cols), 1)[None]
    low_r, low_c = np.minimum(rows[:-1], y.shape[0] - 1), np.minimum(cols[:-1], y.shape[1] - 1)
    high_r, high_c = np.maximum(rows[1:], low_r + 1), np.maximum(cols[1:], low_c + 1)
    mean = (total[high_r][:, high_c] - total[low_r][:, high_c] - total[high_r][:, low_c] + total[low_r][:, low_c]) / area
    return int("".join("1" if x else "0" for x in (mean > mean.mean()).ravel()), 2)


def store_samples(df: DataFrame, column: str, keep: list[str], media: str = "media") -> DataFrame:
    """The columns ``keep`` and ``column``'s bytes, padded with 255 to a positive multiple of 576, as JPEG."""
    rows = df.select(*keep, F.col(column).alias("_bytes"))
    fields = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_bytes", 1 << 19):
            raw, offsets = utf8(batch.column(len(keep)))
            payloads = []
            for a, z in zip(offsets[:-1], offsets[1:]):
                padded = np.full(max(1, -(-(z - a) // UNIT)) * UNIT, 255, np.uint8)
                padded[: z - a] = raw[a:z]
                payloads.append(padded)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(encode(payloads), pa.binary())], names=[*keep, media])

    return rows.mapInArrow(run, f"{fields}`{media}` binary")


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with width, height, thumb_width, thumb_height, thumbnail, thumb_hash, samples and error added.

    Dimensions are those of the first frame; ``thumbnail`` holds the samples of all frames, row by row.
    """
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)
    added = ["width", "height", "thumb_width", "thumb_height", "thumbnail", "thumb_hash", "samples", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, media, 1 << 20):
            rows = []
            for frames, why in thumbnails(batch.column(batch.schema.get_field_index(media)).to_pylist()):
                if why:
                    rows.append((None,) * 7 + (why,))
                    continue
                w, h, y, _ = frames[0]
                marked = all(s is not None for *_, s in frames)
                samples = b"".join(t.tobytes()[: s if marked else None] for *_, t, s in frames)
                rows.append((w, h, y.shape[1], y.shape[0], samples, "-".join(f"{thumbnail_hash(t):016x}" for *_, t, _ in frames), len(samples), None))
            kinds = [pa.int32()] * 4 + [pa.binary(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(c), t) for c, t in zip(zip(*rows), kinds))], names=[*batch.schema.names, *added])

    return df.mapInArrow(run, f"{fields}width int, height int, thumb_width int, thumb_height int, thumbnail binary, thumb_hash string, samples long, error string")


def op2_media(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("text"))
    stored = store_samples(rows.withColumn("n_bytes", F.length("text").cast("long")), "text", ["doc_id", "n_bytes"])
    read = read_media(stored)
    payload = F.col("thumbnail")
    return read.select(
        "doc_id", "n_bytes", F.length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(thumbnail, -32, 32)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(" ", F.concat_ws("x", "width", "height"), F.concat_ws("x", "thumb_width", "thumb_height"), "thumb_hash", "error").alias("feature"),
    )
