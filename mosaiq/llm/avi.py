"""AVI motion-JPEG columns: container, baseline JPEG frames, shots.

Writing: a text's bytes, padded with blanks to a positive multiple of 192, become frames of 16 x 12 blocks. Each block
is a flat 8 x 8 square whose grey level is one byte: its only coefficient is DC = level - 128 at quantiser 8, which
every baseline decoder gives back exactly. So the stored form is an ordinary AVI file and loses nothing.

Reading: the RIFF tree gives the header, the `movi` list and the `idx1` index; frames are decoded by a baseline JPEG
decoder that reads one symbol of every frame of the batch at a time, so NumPy works on thousands of frames at once.
AC coefficients, restart intervals and several components are understood too.

Shots: a histogram of grey levels per frame; a cut falls where the difference to the frame before exceeds both a floor
and mean plus three deviations of the differences before it (at most 8, same clip). Sums are integers, so equal texts
give equal values whatever batch they are in.

Defined results: null counts as empty (one frame of blanks); equal texts give equal values; repeated rows each get a
row; other columns are not read; a file that isn't an AVI with MJPG frames raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mosaiq.llm.common import arrow_map, slices, spread, utf8

UNIT, BLOCKS_WIDE, BLOCKS_HIGH, FPS = 192, 16, 12, 25
#: Payload bytes that are coded together.
CHUNK = 1 << 20
FLOOR, PAST = 96, 8
#: The order in which JPEG stores the 64 coefficients of a block.
ZIGZAG = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def frame_head() -> bytes:
    """From SOI to SOS: quantiser 8 everywhere; DC categories 0 to 8 in four bits each; one AC symbol, end of block, in one bit."""
    size = struct.pack(">BHHB", 8, BLOCKS_HIGH * 8, BLOCKS_WIDE * 8, 1) + bytes([1, 0x11, 0])
    dc = bytes([0x00, 0, 0, 0, 9, *[0] * 12, *range(9)])
    ac = bytes([0x10, 1, *[0] * 15, 0])
    return b"\xff\xd8" + segment(0xDB, bytes([0, *[8] * 64])) + segment(0xC0, size) + segment(0xC4, dc + ac) + segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


HEAD = frame_head()


def encode_frames(levels: np.ndarray) -> list[bytes]:
    """JPEG files of frames, each a row of UNIT grey levels."""
    n = len(levels)
    d = np.diff(levels.astype(np.int32), axis=1, prepend=128)
    size = np.zeros(512, np.int64)
    size[1:] = np.floor(np.log2(np.arange(1, 512))).astype(np.int64) + 1
    s = size[np.abs(d)]
    extra = np.where(d < 0, d + (1 << s) - 1, d)
    value = ((s << s | extra) << 1).astype(np.int64)
    bits = s + 5
    total = bits.sum(axis=1)
    pad = -total % 8
    value = np.concatenate([value, ((1 << pad) - 1)[:, None]], axis=1)
    bits = np.concatenate([bits, pad[:, None]], axis=1)
    length = (total + pad) // 8
    begin = np.cumsum(length) - length
    at = (np.cumsum(bits, axis=1) - bits + begin[:, None] * 8).ravel()
    word = value.ravel() << (24 - (at & 7) - bits.ravel())
    out = np.zeros(int(length.sum()) + 3, np.int64)
    for k in range(3):
        out += np.bincount((at >> 3) + k, weights=((word >> (16 - 8 * k)) & 255), minlength=len(out))[: len(out)].astype(np.int64)
    scan = out[: int(length.sum())].astype(np.uint8)
    (ff,) = (scan == 0xFF).nonzero()
    if len(ff):
        scan = np.insert(scan, ff + 1, 0)
        length = length + np.bincount(np.searchsorted(begin, ff, side="right") - 1, minlength=n)
    ends = np.cumsum(length)
    data = scan.tobytes()
    return [HEAD + data[a:b] + b"\xff\xd9" for a, b in zip((ends - length).tolist(), ends.tolist(), strict=True)]


def chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], n_bytes: int) -> bytes:
    """An AVI 1.0 file; `tlen` in the header list tells how many payload bytes count."""
    w, h, n = BLOCKS_WIDE * 8, BLOCKS_HIGH * 8, len(frames)
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, n, 0, 1, 0, w, h, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, n, 0, 0xFFFFFFFF, 0, 0, 0, w, h)
    strf = struct.pack("<IiiHH4sIiiII", 40, w, h, 1, 24, b"MJPG", w * h * 3, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)) + chunk(b"tlen", struct.pack("<Q", n_bytes)))
    sizes = np.array([len(x) for x in frames], dtype=np.int64)
    steps = 8 + sizes + (sizes & 1)
    index = np.zeros(n, dtype=[("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])
    index["id"], index["flags"], index["at"], index["size"] = b"00dc", 0x10, 4 + np.cumsum(steps) - steps, sizes
    movi = chunk(b"LIST", b"movi" + b"".join([chunk(b"00dc", x) for x in frames]))
    return chunk(b"RIFF", b"AVI " + hdrl + movi + chunk(b"idx1", index.tobytes()))


def read_index(media: bytes) -> dict:
    """fps, width, height, n_bytes (None if the file doesn't tell), and at / size of each frame, from the RIFF tree."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found: dict = {"n_bytes": None}
    spans = [(12, min(len(media), 8 + struct.unpack_from("<I", media, 4)[0]))]
    while spans:
        at, end = spans.pop()
        while at + 8 <= end:
            tag, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            if tag == b"LIST" and media[at + 8 : at + 12] == b"movi":
                found["movi"] = (at + 8, at + 8 + size)
            elif tag == b"LIST":
                spans.append((at + 12, at + 8 + size))
            elif tag == b"avih":
                found["us"], found["width"], found["height"] = *struct.unpack_from("<I", media, at + 8), *struct.unpack_from("<II", media, at + 40)
            elif tag == b"strh" and media[at + 8 : at + 12] == b"vids":
                found["codec"] = media[at + 12 : at + 16]
            elif tag == b"tlen":
                (found["n_bytes"],) = struct.unpack_from("<Q", media, at + 8)
            elif tag == b"idx1":
                found["index"] = np.frombuffer(media, dtype=[("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")], count=size // 16, offset=at + 8)
            at += 8 + size + (size & 1)
    if "movi" not in found or "us" not in found or found.get("codec", b"MJPG").upper() != b"MJPG":
        raise ValueError("not a motion-JPEG AVI")
    if "index" in found:
        index = found["index"][np.isin(found["index"]["id"], [b"00dc", b"00db"])]
        at, size = index["at"].astype(np.int64), index["size"].astype(np.int64)
        # Offsets count from the list's tag by the format, from the file's start in some writers.
        at = at + 8 + (0 if len(at) and at[0] >= found["movi"][0] else found["movi"][0])
    else:
        marks, k = [], found["movi"][0] + 4
        while k + 8 <= min(found["movi"][1], len(media)):
            size = struct.unpack_from("<I", media, k + 4)[0]
            if media[k : k + 4] in (b"00dc", b"00db"):
                marks.append((k + 8, size))
            k += 8 + size + (size & 1)
        at, size = (np.array([m[i] for m in marks], dtype=np.int64) for i in (0, 1))
    return found | {"at": at, "size": size, "fps": 1e6 / found["us"]}


def huffman(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16-bit window: code length + 256 * symbol; 0 where no code fits."""
    table, code, k = np.zeros(65536, np.int64), 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            table[code << (16 - length) : (code + 1) << (16 - length)] = length | symbols[k] << 8
            code, k = code + 1, k + 1
        code <<= 1
    return table


@lru_cache(maxsize=64)
def read_head(head: bytes) -> dict:
    """What the segments up to the scan say. head ends where the scan's data begin."""
    at, quant, dc, ac, out = 2, {}, {}, {}, {"every": 0}
    while at < len(head):
        marker, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], dtype=">u2" if wide else "u1").astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC0:
            out["height"], out["width"] = struct.unpack_from(">HH", body, 1)
            out["parts"] = [{"id": body[6 + 3 * k], "h": body[7 + 3 * k] >> 4, "v": body[7 + 3 * k] & 15, "q": body[8 + 3 * k]} for k in range(body[5])]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline JPEG frames are decoded")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                (ac if body[0] >> 4 else dc)[body[0] & 15] = huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            out["every"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            for k in range(body[0]):
                part = next(p for p in out["parts"] if p["id"] == body[1 + 2 * k])
                part["dc"], part["ac"] = dc[body[2 + 2 * k] >> 4], ac[body[2 + 2 * k] & 15]
        at += 2 + size
    if len(out["parts"]) == 1:
        out["parts"][0]["h"] = out["parts"][0]["v"] = 1
    out["hmax"], out["vmax"] = max(p["h"] for p in out["parts"]), max(p["v"] for p in out["parts"])
    out["wide"], out["high"] = -(-out["width"] // (8 * out["hmax"])), -(-out["height"] // (8 * out["vmax"]))
    for p in out["parts"]:
        p["quant"] = quant[p["q"]]
    return out


def head_length(data: bytes, at: int) -> int:
    k = at + 2
    while data[k + 1] != 0xDA:
        k += 2 + struct.unpack_from(">H", data, k + 2)[0]
    return k + 2 + struct.unpack_from(">H", data, k + 2)[0] - at


def read_scans(scan: np.ndarray, begin: np.ndarray, head: dict, mcus: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Entropy-decode segments side by side: DC differences (segments x blocks) and sparse AC entries (segment, block, k, value)."""
    padded = np.concatenate([scan, np.zeros(16, np.uint8)])
    word = np.zeros(len(scan) + 8, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + len(word)]
    layout = [p for p in head["parts"] for _ in range(p["h"] * p["v"])]
    longest = int(mcus.max(initial=0))
    diffs = np.zeros((len(begin), longest * len(layout)), np.int32)
    pos = begin.astype(np.int64) * 8
    most = len(scan) * 8
    half = np.array([0, *(1 << k for k in range(16))], np.int64)
    sparse = []
    for b in range(diffs.shape[1]):
        part = layout[b % len(layout)]
        live = slice(None) if (mcus > b // len(layout)).all() else (mcus > b // len(layout)).nonzero()[0]
        p = pos[live]
        if int(p.max(initial=0)) > most:
            raise ValueError("a JPEG scan ends early")
        w = word[p >> 3] << (p & 7).astype(np.uint64)
        e = part["dc"][(w >> np.uint64(48)).astype(np.int64)]
        length, s = e & 255, e >> 8
        w = w << length.astype(np.uint64)
        extra = ((w >> np.uint64(1)) >> (63 - s).astype(np.uint64)).astype(np.int64)
        diffs[live, b] = np.where(extra < half[s], extra - 2 * half[s] + 1, extra) * (s > 0)
        w = w << s.astype(np.uint64)
        e = part["ac"][(w >> np.uint64(48)).astype(np.int64)]
        if not e.all():
            raise ValueError("a JPEG scan holds an unknown code")
        p = p + length + s + (e & 255)
        (more,) = (e >> 8).nonzero()
        if len(more):
            # Blocks with AC coefficients: go on until each has ended.
            at, sym, k = p[more], e[more] >> 8, np.ones(len(more), np.int64)
            who = np.arange(len(begin))[live][more]
            spot = more
            while len(spot):
                run, s = sym >> 4, sym & 15
                w = word[at >> 3] << (at & 7).astype(np.uint64)
                extra = ((w >> np.uint64(1)) >> (63 - s).astype(np.uint64)).astype(np.int64)
                v = np.where(extra < half[s], extra - 2 * half[s] + 1, extra) * (s > 0)
                at, k = at + s, k + run
                sparse.append(np.stack([who[s > 0], np.full((s > 0).sum(), b), k[s > 0], v[s > 0]], axis=1))
                k = k + 1
                p[spot] = at
                going = k < 64
                spot, who, at, k = spot[going], who[going], at[going], k[going]
                w = word[at >> 3] << (at & 7).astype(np.uint64)
                e = part["ac"][(w >> np.uint64(48)).astype(np.int64)]
                at, sym = at + (e & 255), e >> 8
                p[spot] = at
                going = sym > 0
                spot, who, at, k, sym = spot[going], who[going], at[going], k[going], sym[going]
        pos[live] = p
    return diffs, sparse


def unstuffed(scan: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scan bytes of all segments in a row without stuffed zeros, and where each begins."""
    starts = np.cumsum(length) - length
    flat = scan[np.repeat(begin - starts, length) + np.arange(int(length.sum()))]
    stuffed = np.zeros(len(flat), bool)
    stuffed[1:] = (flat[1:] == 0) & (flat[:-1] == 0xFF)
    if not stuffed.any():
        return flat, starts
    before = np.concatenate([[0], np.cumsum(stuffed)])
    return flat[~stuffed], starts - before[starts]


@lru_cache(maxsize=1)
def cosines() -> np.ndarray:
    k = np.arange(8)
    return np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)[:, None]


def decode_frames(data: bytes, at: np.ndarray, size: np.ndarray) -> list[np.ndarray] | np.ndarray:
    """Grey levels (luma) of frames. One array (frames x blocks) of block levels if all are flat blocks of one header,
    else a list of pixel arrays."""
    raw = np.frombuffer(data, np.uint8)
    n = head_length(data, int(at[0]))
    head_bytes = data[int(at[0]) : int(at[0]) + n]
    same = (size >= n + 2).all() and (raw[at[:, None] + np.arange(n)] == np.frombuffer(head_bytes, np.uint8)).all()
    head = read_head(head_bytes)
    if same and not head["every"] and len(head["parts"]) == 1 and head["width"] % 8 == head["height"] % 8 == 0:
        scan, begin = unstuffed(raw, at + n, size - n - 2)
        diffs, sparse = read_scans(scan, begin, head, np.full(len(at), head["wide"] * head["high"]))
        if not sparse:
            level = np.cumsum(diffs, axis=1) * int(head["parts"][0]["quant"][0])
            return np.clip((level + 4) // 8 + 128, 0, 255).astype(np.uint8)
    return [decode_frame(data[a : a + s]) for a, s in zip(at.tolist(), size.tolist(), strict=True)]


def decode_frame(jpeg: bytes) -> np.ndarray:
    """The luma plane of one baseline JPEG."""
    n = head_length(jpeg, 0)
    head = read_head(jpeg[:n])
    raw, mcus = np.frombuffer(jpeg, np.uint8), head["wide"] * head["high"]
    end = jpeg.rindex(b"\xff\xd9")
    marks = [k for k in (np.flatnonzero(raw[n : end - 1] == 0xFF) + n).tolist() if 0xD0 <= raw[k + 1] <= 0xD7]
    begin, stop = np.array([n, *(k + 2 for k in marks)]), np.array([*marks, end])
    every = head["every"] or mcus
    counts = np.array([min(every, mcus - k * every) for k in range(len(begin))])
    scan, first = unstuffed(raw, begin, stop - begin)
    diffs, sparse = read_scans(scan, first, head, counts)
    part, per = head["parts"][0], sum(p["h"] * p["v"] for p in head["parts"])
    own = part["h"] * part["v"]
    entries = np.concatenate(sparse) if sparse else np.empty((0, 4), np.int64)
    blocks = np.zeros((mcus, own, 64))
    for k, count in enumerate(counts.tolist()):
        mine = diffs[k, : count * per].reshape(count, per)[:, :own].reshape(-1)
        blocks[k * every : k * every + count, :, 0] = np.cumsum(mine).reshape(count, own)
    mcu, inside = entries[:, 0] * every + entries[:, 1] // per, entries[:, 1] % per
    luma = inside < own
    blocks[mcu[luma], inside[luma], entries[luma, 2]] = entries[luma, 3]
    natural = np.zeros_like(blocks)
    natural[:, :, ZIGZAG] = blocks * part["quant"]
    c = cosines()
    pixels = np.clip(np.rint(c.T @ natural.reshape(mcus, own, 8, 8) @ c + 128), 0, 255).astype(np.uint8)
    grid = pixels.reshape(head["high"], head["wide"], part["v"], part["h"], 8, 8).transpose(0, 2, 4, 1, 3, 5)
    return grid.reshape(head["high"] * part["v"] * 8, head["wide"] * part["h"] * 8)[: head["height"], : head["width"]]


def cuts(hist: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """For frames of clips laid end to end (clip: ascending numbers), whether a shot begins at each for another reason than its clip's start.
    hist: one row of integer counts per frame, all of one sum."""
    n = len(hist)
    d = np.zeros(n, np.int64)
    d[1:] = np.abs(np.diff(hist, axis=0)).sum(axis=1)
    same = np.zeros(n, bool)
    same[1:] = clip[1:] == clip[:-1]
    d[~same] = 0
    start = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    # Differences before frame i lie at start + 1 .. i - 1, of which the last PAST count.
    low, high = np.maximum(start + 1, np.arange(n) - PAST), np.arange(n)
    m = np.maximum(high - low, 0)
    one, two = (np.concatenate([[0], np.cumsum(x)]) for x in (d, d * d))
    low = np.minimum(low, high)
    s, q = one[high] - one[low], two[high] - two[low]
    scale = hist[0].sum() if n else 1
    # d > s/m + 3 * sqrt(q/m - (s/m)^2), in integers: (d*m - s)^2 > 9 * (q*m - s^2)
    over = (d * m > s) & ((d * m - s) ** 2 > 9 * (q * m - s * s))
    return same & (d * 192 > FLOOR * scale) & (over | (m == 0))


def encode(payloads: list[bytes]) -> list[bytes]:
    padded = [x + b" " * (-len(x) % UNIT if x else UNIT) for x in payloads]
    frames = encode_frames(np.frombuffer(b"".join(padded), np.uint8).reshape(-1, UNIT))
    out, k = [], 0
    for x, p in zip(payloads, padded, strict=True):
        out.append(write_avi(frames[k : k + len(p) // UNIT], len(x)))
        k += len(p) // UNIT
    return out


def decode(media: list[bytes]) -> list[dict]:
    """Of each file: fps, levels (frames x blocks, or a list of pixel arrays), n_bytes, cut (first frames of later shots)."""
    index = [read_index(x) for x in media]
    base = np.cumsum([0, *(len(x) for x in media)])
    at = np.concatenate([x["at"] + b for x, b in zip(index, base[:-1], strict=True)]) if media else np.empty(0, np.int64)
    clip = np.repeat(np.arange(len(media)), [len(x["at"]) for x in index])
    levels = decode_frames(b"".join(media), at, np.concatenate([x["size"] for x in index])) if len(at) else []
    n = len(levels)
    if isinstance(levels, np.ndarray):
        hist = np.bincount((np.arange(n)[:, None] * 16 + (levels >> 4)).ravel(), minlength=n * 16).reshape(n, 16)
    else:
        hist = np.array([np.bincount(x.ravel() >> 4, minlength=16) * 192 * 64 // x.size for x in levels], np.int64).reshape(n, 16)
    cut = cuts(hist, clip) if n else np.empty(0, bool)
    ends = np.cumsum([len(x["at"]) for x in index])
    return [x | {"levels": levels[e - len(x["at"]) : e], "cut": np.flatnonzero(cut[e - len(x["at"]) : e])} for x, e in zip(index, ends.tolist(), strict=True)]


def to_avi(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and media (an AVI file) of each row."""

    def run(batch: pa.RecordBatch):
        texts = utf8(batch.column(1))
        for a, b in slices(texts, CHUNK):
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64())[a:b], pa.array(encode(texts[a:b]), pa.binary())], names=[id_col, "media"])

    return arrow_map(spread(docs.select(id_col, text_col)), run, f"{id_col} long, media binary")


def clip_rows(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per shot: id, clip (from 0), first_frame, n_frames, start_s, end_s. Null media give no rows."""

    def run(batch: pa.RecordBatch):
        ids, files = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        pairs = [(i, f) for i, f in zip(ids, files, strict=True) if f]
        files = [f for _, f in pairs]
        for a, b in slices(files, 4 * CHUNK):
            rows = []
            for (i, _), x in zip(pairs[a:b], decode(files[a:b]), strict=True):
                marks = [0, *x["cut"].tolist(), len(x["at"])]
                rows += [(i, k, s, e - s, s / x["fps"], e / x["fps"]) for k, (s, e) in enumerate(zip(marks, marks[1:], strict=False)) if e > s]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()], strict=True)], names=[id_col, "clip", "first_frame", "n_frames", "start_s", "end_s"])

    return arrow_map(media.select(id_col, media_col), run, f"{id_col} long, clip int, first_frame int, n_frames int, start_s double, end_s double")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as AVI, read the stored bytes back, and return digests of both and the shots as `feature`."""

    def run(batch: pa.RecordBatch):
        ids, texts = batch.column(0).cast(pa.int64()), utf8(batch.column(1))
        for a, b in slices(texts, CHUNK):
            rows = []
            media = encode(texts[a:b])
            for file, x in zip(media, decode(media), strict=True):
                payload = x["levels"].tobytes()
                marks = ",".join(map(str, x["cut"].tolist()))
                rows.append((x["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(), f"frames={len(x['at'])};shots={len(x['cut']) + 1};cuts={marks}"))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([ids[a:b], *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return arrow_map(spread(docs.select(id_col, text_col)), run, f"{id_col} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
