import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mosaiq.llm import avi


def padded(x):
    return x + b" " * (-len(x) % 192 if x else 192)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=900), min_size=1, max_size=6))
def test_round_trip(payloads):
    for x, y in zip(payloads, avi.decode(avi.encode(payloads)), strict=True):
        assert y["levels"].tobytes() == padded(x) and y["n_bytes"] == len(x)


def test_flat_blocks_decode_as_pixels():
    data = bytes(range(192))
    media = avi.encode([data])[0]
    index = avi.read_index(media)
    assert (index["width"], index["height"], round(index["fps"])) == (128, 96, 25)
    frame = avi.decode_frame(media[index["at"][0] : index["at"][0] + index["size"][0]])
    want = np.kron(np.frombuffer(data, np.uint8).reshape(12, 16), np.ones((8, 8), np.uint8))
    assert (frame == want).all()


def coded(values, table):
    return "".join(table[v] for v in values)


def small_jpeg(blocks, quant, every=0, parts=1):
    """A baseline JPEG of 8 x 8 blocks in a row with fixed-length codes, written bit by bit; blocks: lists of 64 zigzag coefficients."""
    dc, ac = list(range(12)), [0, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 9)]
    extra = lambda v, s: format(v if v > 0 else v + (1 << s) - 1, f"0{s}b") if s else ""
    scan, bits, before, out = b"", "", [0] * parts, []
    mcus = len(blocks) // parts
    for m in range(mcus):
        if every and m and m % every == 0:
            bits += "1" * (-len(bits) % 8)
            out.append(bits)
            bits, before = "", [0] * parts
        for p in range(parts):
            b = blocks[m * parts + p]
            d = b[0] - before[p]
            before[p] = b[0]
            s = abs(d).bit_length()
            bits += format(dc.index(s), "04b") + extra(d, s)
            run = 0
            last = max((k for k in range(1, 64) if b[k]), default=0)
            for k in range(1, last + 1):
                if b[k] == 0:
                    run += 1
                    continue
                while run > 15:
                    bits += format(1, "08b")
                    run -= 16
                s = abs(b[k]).bit_length()
                bits += format(ac.index(run << 4 | s), "08b") + extra(b[k], s)
                run = 0
            if last < 63:
                bits += format(0, "08b")
    out.append(bits + "1" * (-len(bits) % 8))
    for k, x in enumerate(out):
        raw = int(x, 2).to_bytes(len(x) // 8, "big").replace(b"\xff", b"\xff\x00")
        scan += (bytes([0xFF, 0xD0 + (k - 1) % 8]) if k else b"") + raw
    head = b"\xff\xd8" + avi.segment(0xDB, bytes([0, *quant]))
    head += avi.segment(0xC0, struct.pack(">BHHB", 8, 8, 8 * mcus, parts) + b"".join(bytes([p + 1, 0x11, 0]) for p in range(parts)))
    head += avi.segment(0xC4, bytes([0, 0, 0, 0, 12, *[0] * 12, *dc]) + bytes([0x10, 0, 0, 0, 0, 0, 0, 0, len(ac), *[0] * 8, *ac]))
    if every:
        head += avi.segment(0xDD, struct.pack(">H", every))
    return head + avi.segment(0xDA, bytes([parts]) + b"".join(bytes([p + 1, 0]) for p in range(parts)) + bytes([0, 63, 0])) + scan + b"\xff\xd9"


@pytest.mark.parametrize(("every", "parts"), [(0, 1), (2, 1), (0, 3), (1, 3)])
def test_full_decoder_against_the_transform(every, parts):
    rng = np.random.default_rng(7)
    quant = rng.integers(1, 9, 64).tolist()
    blocks = []
    for _ in range(5 * parts):
        b = [0] * 64
        b[0] = int(rng.integers(-60, 60))
        for k in rng.choice(np.arange(1, 64), 6, replace=False):
            b[int(k)] = int(rng.integers(-20, 20))
        blocks.append(b)
    blocks[0][63] = 5
    frame = avi.decode_frame(small_jpeg(blocks, quant, every, parts))
    cos = [[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)]
    for m in range(5):
        coef = np.zeros(64)
        coef[avi.ZIGZAG] = np.array(blocks[m * parts]) * np.array(quant)
        c = np.array(cos)
        want = np.clip(np.rint(c.T @ coef.reshape(8, 8) @ c + 128), 0, 255)
        assert np.abs(frame[:, 8 * m : 8 * m + 8].astype(int) - want).max() <= 1


def test_index_can_be_rebuilt_and_other_files_are_refused():
    media = avi.encode([b"x" * 1000])[0]
    whole, cut = avi.read_index(media), avi.read_index(media[: media.rindex(b"idx1")])
    assert whole["at"].tolist() == cut["at"].tolist()
    with pytest.raises(ValueError):
        avi.read_index(b"RIFF\0\0\0\0WAVE")


def test_cuts_against_a_loop():
    rng = np.random.default_rng(1)
    clip = np.sort(rng.integers(0, 5, 120))
    hist = rng.multinomial(192, np.ones(16) / 16, 120)
    hist[::17] = np.eye(16, dtype=int)[rng.integers(0, 16, len(hist[::17]))] * 192
    want = []
    for i in range(120):
        past = []
        j = i
        while j > 0 and clip[j - 1] == clip[j]:
            if j < i:
                past.append(int(np.abs(hist[j] - hist[j - 1]).sum()))
            j -= 1
        past = past[: avi.PAST]
        d = int(np.abs(hist[i] - hist[i - 1]).sum()) if i and clip[i] == clip[i - 1] else 0
        m = len(past)
        over = not m or (d * m > sum(past) and (d * m - sum(past)) ** 2 > 9 * (m * sum(x * x for x in past) - sum(past) ** 2))
        want.append(bool(i and clip[i] == clip[i - 1] and d > avi.FLOOR and over))
    assert avi.cuts(hist, clip).tolist() == want


def test_digests_and_clips(hard, empty):
    found = avi.media_digests(hard).collect()
    texts = sorted((r.text or "").encode() for r in hard.collect())
    assert len(found) == len(texts)
    want = sorted((len(x), len(padded(x)), hashlib.sha256(padded(x)).hexdigest(), zlib.crc32(padded(x)[-16:])) for x in texts)
    assert sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found) == want
    assert len({r.media_sha256 for r in found if r.doc_id == 1}) == 1
    media = avi.to_avi(hard)
    clips = avi.clip_rows(media).collect()
    frames = {}
    for c in sorted(clips, key=lambda c: (c.doc_id or 0, c.clip)):
        assert c.end_s - c.start_s == pytest.approx(c.n_frames / 25)
        frames[c.doc_id] = frames.get(c.doc_id, 0) + c.n_frames
    assert frames[6] == len(padded(next(x for x in texts if len(x) > 10_000))) // 192
    assert avi.media_digests(empty).collect() == [] and avi.clip_rows(avi.to_avi(empty)).collect() == []
