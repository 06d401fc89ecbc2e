import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from strandline.llm import tiff
from tests.llm.conftest import ODD


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 1152, 5_000, 9_216, 9_217, 40_000])
@pytest.mark.parametrize("kind", ["few", "random", "one"])
def test_payload_round_trip(size, kind):
    rng = random.Random(size)
    raw = bytes(rng.choice(b"abc ") for _ in range(size)) if kind == "few" else rng.randbytes(size) if kind == "random" else b"a" * size
    payload = tiff.padded(raw)
    assert len(payload) % 576 == 0 and payload.startswith(raw)
    assert b"".join(p.pixels.tobytes() for p in tiff.pages(tiff.write_payload(payload))) == payload
    assert tiff.unpack_lzw(tiff.pack_lzw(raw), size) == raw and tiff.unpack_bits(tiff.pack_bits(raw), size) == raw


def test_published_examples():
    # the PackBits example of a well-known technical note, and the LZW codes of a small run
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert tiff.unpack_bits(packed, 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert tiff.unpack_lzw(bytes.fromhex("8001E0408180"), 3)[:1] == b"\x07"


def make(order, tags, extra=b""):
    """A file with one directory; long values lie in ``extra`` right after the header."""
    at = 8 + len(extra)
    out = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at) + extra + struct.pack(order + "H", len(tags))
    for tag, kind, count, value in tags:
        raw = struct.pack(order + ("HH" if kind == 3 else "I"), *((value, 0) if kind == 3 else (value,)))
        out += struct.pack(order + "HHI", tag, kind, count) + raw
    return out + b"\0\0\0\0"


def one_strip(order, pixels, compression, predictor, body, planar=1, samples=1, bits=8, kind=1):
    h, w = pixels.shape[:2]
    return make(order, [(256, 3, 1, w), (257, 3, 1, h), (258, 3, 1, bits), (259, 3, 1, compression), (273, 4, 1, 8), (277, 3, 1, samples), (278, 3, 1, h), (279, 4, 1, len(body)), (284, 3, 1, planar), (317, 3, 1, predictor), (339, 3, 1, kind)], body + b"\0" * (len(body) % 2))


@pytest.mark.parametrize("order", "<>")
def test_both_byte_orders_and_16_bits(order):
    px = np.arange(12, dtype=np.uint16).reshape(3, 4) * 1000
    diff = np.concatenate((px[:, :1], np.diff(px, axis=1)), axis=1).astype(f"{order}u2")
    (p,) = tiff.pages(one_strip(order, px, tiff.DEFLATE, 2, zlib.compress(diff.tobytes()), bits=16))
    assert (p.pixels[:, :, 0] == px).all()


def test_samples_side_by_side_and_in_planes():
    px = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    diff = np.concatenate((px[:, :1], np.diff(px, axis=1)), axis=1)
    (p,) = tiff.pages(one_strip("<", px, tiff.LZW, 2, tiff.pack_lzw(diff.tobytes()), samples=3))
    assert (p.pixels == px).all()


def test_floating_point_predictor():
    px = np.linspace(-2, 3, 12, dtype=np.float32).reshape(3, 4)
    planes = px.astype(">f4").view(np.uint8).reshape(3, 4, 4).transpose(0, 2, 1).reshape(3, 16)
    diff = np.concatenate((planes[:, :1], np.diff(planes, axis=1)), axis=1)
    (p,) = tiff.pages(one_strip("<", px, tiff.DEFLATE, 3, zlib.compress(diff.tobytes()), bits=32, kind=3))
    assert (p.pixels[:, :, 0] == px).all()


def test_damage_is_an_error_not_a_crash(spark):
    good = tiff.write_payload(tiff.padded(b"abc" * 4_000))
    rng = random.Random(4)
    files = [(0, good), (1, None), (2, b""), (3, b"nonsense"), (4, good[:-30]), (5, good[:20])]
    for k in range(60):
        bad = bytearray(good)
        bad[rng.randrange(len(bad))] ^= 1 << rng.randrange(8)
        files.append((10 + k, bytes(bad)))
    loop = bytearray(b"II*\0\x08\0\0\0" + struct.pack("<H", 0) + struct.pack("<I", 8))
    files.append((90, bytes(loop)))
    got = tiff.read_pages(spark.createDataFrame(files, "i bigint, media binary"), "i", "media").collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert 1 not in by and all(k in by for k, m in files if m is not None)
    assert b"".join(r.pixels for r in sorted(by[0], key=lambda r: r.page)) == tiff.padded(b"abc" * 4_000)
    assert by[3][0].error and by[90][-1].error


def test_odd_rows(documents):
    got = tiff.text_round_trip(documents(ODD)).collect()
    assert len(got) == len(ODD)
    texts = dict(ODD)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        want = tiff.padded(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (5, 6)}) == 1
    assert tiff.text_round_trip(documents(ODD).limit(0)).collect() == []


def test_codec_predictor_and_layout_do_not_depend_on_size():
    rng = random.Random(8)
    for rows in (6, 12, 36, 96):
        seen = set()
        for _ in range(200):
            (p,) = tiff.pages(tiff.write_payload(bytes(rng.choice(b"abc ") for _ in range(96 * rows))))
            seen.add((tiff.NAMES[p.compression], p.predictor, p.tiled))
        assert len(seen) == 12  # three codecs, with and without predictor, strips and tiles


def test_sizes_that_ask_for_all_memory_are_errors(spark):
    big = (1 << 32) - 1
    tile = [(256, 3, 1, 8), (257, 3, 1, 8), (258, 3, 1, 8), (259, 3, 1, 1), (322, 4, 1, big), (323, 4, 1, big), (324, 4, 1, 8), (325, 4, 1, 4)]
    page = [(256, 4, 1, big), (257, 4, 1, big), (258, 3, 1, 64), (259, 3, 1, 1), (273, 4, 1, 8), (278, 4, 1, big), (279, 4, 1, 4)]
    strip = [(256, 4, 1, 0), (257, 4, 1, 0), (258, 3, 1, 8), (259, 3, 1, 1), (273, 4, 1, 8), (278, 4, 1, 0), (279, 4, 1, 4)]
    files = [(i, make("<", t, b"abcd")) for i, t in enumerate((tile, page, strip))] + [(9, b"II+\0" + bytes(20))]
    got = tiff.read_pages(spark.createDataFrame(files, "i bigint, media binary"), "i", "media").collect()
    assert sorted(r.id for r in got) == [0, 1, 2, 9] and all(r.error for r in got)


def test_features_of_pages_one_by_one():
    rng = np.random.default_rng(4)
    images = [rng.integers(0, 256, (h, 48, 1), dtype=np.uint8) for h in (12, 6, 7)] + [np.full((6, 8, 1), 255, np.uint8)]
    flat = np.concatenate([p.ravel() for p in images]).astype(float)
    steps = np.concatenate([np.abs(np.diff(p[:, :, 0].astype(int), axis=1)).ravel() for p in images])
    got = dict(x.split("=") for x in tiff.features(images).split(";"))
    assert got["pages"] == "4" and got["mean"] == f"{flat.mean():.4f}" and got["std"] == f"{flat.std():.4f}" and got["step"] == f"{steps.mean():.4f}"


def test_a_long_text_is_read_back_page_by_page(documents):
    import tracemalloc

    raw = b"some long text 123 " * 400_000
    tracemalloc.start()
    row = tiff._round_trip(raw)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert row[0] == len(raw) and row[1] == len(tiff.padded(raw)) and peak < 8 * len(raw)
