"""TIFF media columns: a reader that emits one row per page, and a writer for 8-bit payloads.

The reader walks the chain of image directories, decodes strips or tiles that
are stored plain or by PackBits, LZW or deflate, undoes the horizontal and the
floating-point predictor, and assembles each page's samples.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: tags, field types' sizes and codes, compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
_TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d")}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {PLAIN: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}
#: Pages of one file, and bytes of one page or segment, that the reader takes; more is an error of that file, so that a few damaged bytes cannot ask for all memory.
MOST_PAGES = 1_000_000
MOST_PAGE_BYTES = 1 << 30


class TiffError(ValueError):
    """A file that is not TIFF, is damaged, or uses what the reader has not."""


def unpack_bits(data: bytes, size: int) -> bytes:
    out = bytearray()
    i, n = 0, len(data)
    while i < n and len(out) < size:
        k = data[i]
        if k < 128:
            out += data[i + 1 : i + 2 + k]
            i += k + 2
        elif k > 128:
            out += data[i + 1 : i + 2] * (257 - k)
            i += 2
        else:
            i += 1
    return bytes(out)


_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def pack_bits(data: bytes) -> bytes:
    out = bytearray()

    def literal(start: int, end: int) -> None:
        for at in range(start, end, 128):
            piece = data[at : min(at + 128, end)]
            out.append(len(piece) - 1)
            out.extend(piece)

    done = 0
    for m in _RUN.finditer(data):
        literal(done, m.start())
        out += bytes((257 - (m.end() - m.start()), data[m.start()]))
        done = m.end()
    literal(done, len(data))
    return bytes(out)


# Codes of LZW: what clears the table and what ends the data; fixed values.
_CLEAR, _END, _FREE = 256, 257, 258
#: Bits of the k-th code after a clearing one: 9 to 12, which widen one code early.
_WIDTHS = np.array([min(12, (_FREE + k).bit_length()) for k in range(4096 - _FREE)], np.int64)
_LITERALS = [bytes((b,)) for b in range(256)] + [b"", b""]


def _widths(k: int, n: int) -> np.ndarray:
    """Widths of n codes from the k-th after a clearing one on."""
    return np.concatenate((_WIDTHS[k : k + n], np.full(max(0, n - max(0, len(_WIDTHS) - k)), 12)))


def _codes(data: bytes) -> Iterator[list[int] | None]:
    """The codes between clearing ones, high bits first, up to the end; a long run without one comes in parts.

    All codes up to the next clearing one have known places, so they are read at
    once; None in place of a part says that the table was cleared.
    """
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    at, k = 0, 0
    while True:
        width = _widths(k, 4096)
        place = at + np.cumsum(width) - width
        width = width[: np.searchsorted(place + width, 8 * len(data), "right")]
        place = place[: len(width)]
        if not len(width):
            return
        first = place >> 3
        window = raw[first].astype(np.int64) << 16 | raw[first + 1].astype(np.int64) << 8 | raw[first + 2]
        code = window >> (24 - (place & 7) - width) & ((1 << width) - 1)
        stops = np.flatnonzero((code == _CLEAR) | (code == _END))
        n = int(stops[0]) if len(stops) else len(code)
        yield code[:n].tolist()
        if not len(stops):
            at, k = int(place[-1] + width[-1]), k + n
        elif code[n] == _END:
            return
        else:
            yield None
            at, k = int(place[n] + width[n]), 0


def unpack_lzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, high bits first, that widen one code early."""
    table, last = list(_LITERALS), b""
    out: list[bytes] = []
    have = 0
    for codes in _codes(data):
        if codes is None:
            table, last = list(_LITERALS), b""
            continue
        for code in codes:
            if not last:
                if code >= _CLEAR:
                    raise TiffError("an LZW strip starts with no literal")
                now = table[code]
            elif code < len(table):
                now = table[code]
            elif code == len(table):
                now = last + last[:1]
            else:
                raise TiffError("an LZW code is not in the table")
            if last and len(table) < 4096:
                table.append(last + now[:1])
            out.append(now)
            have += len(now)
            last = now
            if have >= size:
                return b"".join(out)
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    codes, width = [_CLEAR], [np.array([9])]
    table: dict[int, int] = {}  # a code and the byte that follows it, to the code of both
    size, begun = _FREE, 1
    now = data[0] if data else None
    for byte in data[1:]:
        longer = table.get(now << 8 | byte)
        if longer is not None:
            now = longer
            continue
        codes.append(now)
        table[now << 8 | byte] = size
        size += 1
        if size > 4093:
            codes.append(_CLEAR)
            width.append(_widths(0, len(codes) - begun))
            table, size, begun = {}, _FREE, len(codes)
        now = byte
    codes += [_END] if now is None else [now, _END]
    width.append(_widths(0, len(codes) - begun))
    # each code's low bits, laid end to end
    wide = np.unpackbits(np.array(codes, ">u2").view(np.uint8)).reshape(-1, 16)
    return np.packbits(wide[np.arange(16) >= 16 - np.concatenate(width)[:, None]]).tobytes()


def _decode(data: bytes, compression: int, size: int) -> bytes:
    if compression == PLAIN:
        out = data
    elif compression == PACKBITS:
        out = unpack_bits(data, size)
    elif compression == LZW:
        out = unpack_lzw(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(f"a deflate segment is damaged: {e}") from None
    else:
        raise TiffError(f"compression {compression} is not supported")
    if len(out) < size:
        raise TiffError(f"a segment holds {len(out)} of {size} bytes")
    return out[:size]


@dataclass
class Page:
    """One image directory with its samples, rows by columns by samples, in the machine's byte order."""

    page: int
    pixels: np.ndarray
    compression: int
    predictor: int
    tiled: bool
    bits: int


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    if at + 2 > len(data):
        raise TiffError("a directory lies past the end")
    (n,) = struct.unpack_from(order + "H", data, at)
    if at + 6 + 12 * n > len(data):
        raise TiffError("a directory is cut short")
    tags: dict[int, tuple] = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in _TYPES:
            continue
        size, code = _TYPES[kind]
        where = at + 10 + 12 * i
        if size * count > 4:
            (where,) = struct.unpack_from(order + "I", data, where)
        if where + size * count > len(data):
            raise TiffError(f"the values of tag {tag} lie past the end")
        if code != "s":
            tags[tag] = struct.unpack_from(f"{order}{count * len(code)}{code[0]}", data, where)
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _unpredict(a: np.ndarray, predictor: int, order: str) -> np.ndarray:
    if predictor == 1:
        return a
    if predictor == 2:
        return np.cumsum(a, axis=1, dtype=a.dtype)
    if predictor == 3:
        rows, cols, samples = a.shape
        raw = np.cumsum(a.reshape(rows, -1).view(np.uint8).reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, -1)
        width = a.dtype.itemsize
        planes = raw.reshape(rows, width, cols * samples).transpose(0, 2, 1)
        return np.ascontiguousarray(planes).view(np.dtype(f">f{width}")).astype(f"f{width}").reshape(rows, cols, samples)
    raise TiffError(f"predictor {predictor} is not supported")


def _read_page(data: bytes, tags: dict[int, tuple], order: str, number: int) -> Page:
    def one(tag: int, default: int | None = None) -> int:
        if tag in tags and tags[tag]:
            return tags[tag][0]
        if default is None:
            raise TiffError(f"tag {tag} is missing")
        return default

    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits, compression, predictor = one(BITS, 1), one(COMPRESSION, PLAIN), one(PREDICTOR, 1)
    kind, planar = one(SAMPLE_FORMAT, 1), one(PLANAR, 1)
    if bits not in (8, 16, 32, 64) or any(b != bits for b in tags.get(BITS, ())) or kind not in (1, 2, 3):
        raise TiffError(f"{bits}-bit samples of format {kind} are not supported")
    if width * height * samples * bits // 8 > MOST_PAGE_BYTES:
        raise TiffError(f"a page of more than {MOST_PAGE_BYTES} bytes")
    dtype = np.dtype(f"{order}{'uif'[kind - 1]}{bits // 8}")
    tiled = TILE_OFFSETS in tags
    if tiled:
        seg_w, seg_h, offs, sizes = one(TILE_WIDTH), one(TILE_HEIGHT), tags[TILE_OFFSETS], tags.get(TILE_BYTES, ())
    else:
        seg_w, seg_h, offs, sizes = width, min(one(ROWS_PER_STRIP, height), height), tags.get(STRIP_OFFSETS, ()), tags.get(STRIP_BYTES, ())
    if not width or not height or not seg_w or not seg_h:
        raise TiffError("a page has no samples")
    if seg_w * seg_h * samples * bits // 8 > MOST_PAGE_BYTES:
        raise TiffError(f"a segment of more than {MOST_PAGE_BYTES} bytes")
    across, down = -(-width // seg_w), -(-height // seg_h)
    planes, deep = (samples, 1) if planar == 2 else (1, samples)
    if len(offs) < across * down * planes or len(sizes) < len(offs):
        raise TiffError("segments are missing")
    out = np.empty((height, width, samples), dtype.newbyteorder("="))
    for k in range(across * down * planes):
        plane, r, c = k // (across * down), k // across % down, k % across
        rows = seg_h if tiled else min(seg_h, height - r * seg_h)
        if offs[k] + sizes[k] > len(data):
            raise TiffError("a segment lies past the end")
        raw = _decode(data[offs[k] : offs[k] + sizes[k]], compression, rows * seg_w * deep * dtype.itemsize)
        seg = np.frombuffer(raw, dtype).reshape(rows, seg_w, deep)
        seg = _unpredict(seg if predictor == 3 else seg.astype(out.dtype), predictor, order)
        y, x = r * seg_h, c * seg_w
        h, w = min(rows, height - y), min(seg_w, width - x)
        out[y : y + h, x : x + w, plane : plane + deep] = seg[:h, :w]
    return Page(number, out, compression, predictor, tiled, bits)


def pages(data: bytes) -> Iterator[Page]:
    """The pages of a file, in the order of its directories."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at:
        if at in seen or len(seen) >= MOST_PAGES:
            raise TiffError("the directories run in a circle")
        seen.add(at)
        tags, following = _directory(data, at, order)
        yield _read_page(data, tags, order, len(seen) - 1)
        at = following


#: Geometry of stored payloads: 576 bytes are six rows of a page.
BLOCK, PAGE_WIDTH, PAGE_ROWS, TILE, STRIP_ROWS = 576, 96, 96, 48, 24
_CODECS = (DEFLATE, LZW, PACKBITS)


def _segments(page: np.ndarray) -> tuple[bool, int, int, list[np.ndarray]]:
    """(tiled, compression, predictor, segments) of a page, all dealt by a checksum of its samples.

    So each codec, with and without the predictor, in tiles and in strips, gets
    its share of all pages whatever their size, and equal pages are stored alike.
    """
    deal = zlib.crc32(page.tobytes())
    compression, predictor, tiled = _CODECS[deal % 3], 1 + deal // 3 % 2, deal // 6 % 2 == 1
    if not tiled:
        return False, compression, predictor, [page[r : r + STRIP_ROWS] for r in range(0, len(page), STRIP_ROWS)]
    down = -(-len(page) // TILE)
    whole = np.full((down * TILE, PAGE_WIDTH), 255, np.uint8)
    whole[: len(page)] = page
    return True, compression, predictor, list(whole.reshape(down, TILE, PAGE_WIDTH // TILE, TILE).swapaxes(1, 2).reshape(-1, TILE, TILE))


def write_payload(payload: bytes) -> bytes:
    """A little-endian file of 8-bit pages that hold the payload, whose length is a multiple of 96."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, PAGE_WIDTH)
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for at in range(0, len(rows), PAGE_ROWS):
        page = rows[at : at + PAGE_ROWS]
        tiled, compression, predictor, segs = _segments(page)
        where, sizes = [], []
        for seg in segs:
            if predictor == 2:
                seg = np.concatenate((seg[:, :1], np.diff(seg, axis=1)), axis=1)
            raw = seg.tobytes()
            packed = {DEFLATE: zlib.compress, LZW: pack_lzw, PACKBITS: pack_bits}[compression](raw)
            where.append(len(out))
            sizes.append(len(packed))
            out += packed + b"\0" * (len(packed) % 2)
        n = len(segs)
        tags: list[tuple[int, int, list[int]]] = [(WIDTH, 3, [PAGE_WIDTH]), (HEIGHT, 3, [len(page)]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1])]
        if not tiled:
            tags += [(STRIP_OFFSETS, 4, where)]
        tags += [(SAMPLES, 3, [1])]
        if not tiled:
            tags += [(ROWS_PER_STRIP, 3, [STRIP_ROWS]), (STRIP_BYTES, 4, sizes)]
        tags += [(PREDICTOR, 3, [predictor])]
        if tiled:
            tags += [(TILE_WIDTH, 3, [TILE]), (TILE_HEIGHT, 3, [TILE]), (TILE_OFFSETS, 4, where), (TILE_BYTES, 4, sizes)]
        spill = len(out)
        if n > 1:
            out += struct.pack(f"<{2 * n}I", *where, *sizes)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags))
        for tag, kind, values in tags:
            if kind == 4 and n > 1:
                value = struct.pack("<I", spill + (0 if values is where else 4 * n))
            else:
                value = struct.pack("<HH", values[0], 0) if kind == 3 else struct.pack("<I", values[0])
            out += struct.pack("<HHI", tag, kind, len(values)) + value
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def padded(raw: bytes) -> bytes:
    """Bytes 255 appended up to a positive multiple of 576."""
    return raw + b"\xff" * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw))


class Look:
    """Features of pages that are added one by one: what is held is a page's size, a histogram and the first page's cells."""

    def __init__(self) -> None:
        self.pages, self.steps, self.places = 0, 0, 0
        self.counts = np.zeros(256, np.int64)

    def add(self, page: np.ndarray) -> None:
        self.counts += np.bincount(page.ravel(), minlength=256)
        row = page[:, :, 0]
        right, left = row[:, 1:], row[:, :-1]
        # bytes have no sign, so the smaller is taken from the greater
        self.steps += int((np.maximum(right, left) - np.minimum(right, left)).sum(dtype=np.int64))
        self.places += right.size
        if not self.pages:
            h, w = row.shape
            cells = row[: h // 6 * 6].reshape(6, h // 6, 8, w // 8).sum(axis=(1, 3), dtype=np.int64).ravel()
            self.hash = "".join("01"[int(c * 48 > cells.sum())] for c in cells)
        self.pages += 1

    def text(self) -> str:
        """Pages, mean, standard deviation, mean horizontal step, and an average hash of 6 by 8 cells of the first page."""
        levels = np.arange(256, dtype=np.int64)
        n, total, square = (int(x) for x in (self.counts.sum(), (self.counts * levels).sum(), (self.counts * levels * levels).sum()))
        var = max(0, n * square - total * total) / (n * n)
        return f"pages={self.pages};mean={total / n:.4f};std={var**0.5:.4f};step={self.steps / self.places:.4f};hash={int(self.hash, 2):012x}"


def features(images: list[np.ndarray]) -> str:
    """The features of pages, as :class:`Look` gives them."""
    look = Look()
    for p in images:
        look.add(p)
    return look.text()


_DIGEST = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _round_trip(raw: bytes) -> tuple:
    media = write_payload(padded(raw))
    look, digest, size, tail = Look(), hashlib.sha256(), 0, b""
    for p in pages(media):
        part = p.pixels.tobytes()
        look.add(p.pixels)
        digest.update(part)
        size, tail = size + len(part), (tail + part[-32:])[-32:]
    return len(raw), size, digest.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), look.text()


def text_round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each whole text as TIFF pages, read the stored bytes back and describe them.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256 and tail_crc32 (read
    back), media_bytes, media_sha256 (stored form), feature. A null or empty
    text is one block of padding; repeated rows give equal rows; a null id is
    kept; an empty table gives an empty result; extra columns are not read. Rows
    are worked on where they are, with no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _DIGEST.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                rows = [_round_trip((t or "").encode("utf-8", "surrogatepass")) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0)] + [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _DIGEST)


#: What bytes that are not what they say can lead to.
_DAMAGE = (ValueError, ArithmeticError, LookupError, TypeError, MemoryError, struct.error, zlib.error)
_PAGES = "id bigint, page int, width int, height int, samples int, bits int, compression string, predictor int, tiled boolean, pixels binary, error string"


def read_pages(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per page of each TIFF in a binary column.

    Returns id, page, width, height, samples, bits, compression, predictor,
    tiled, pixels (samples in rows, machine byte order), error. A file that is
    damaged gives the pages before the damage and one row with ``error`` set,
    whatever is wrong with it, and so does one that has what this reader does
    not read: 64-bit offsets (BigTIFF), samples of fewer than 8 bits, other
    codecs, over MOST_PAGES pages, or a page over MOST_PAGE_BYTES. A null file
    gives no rows; a repeated row gives its pages again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("bits", pa.int32()), ("compression", pa.string()), ("predictor", pa.int32()), ("tiled", pa.bool_()), ("pixels", pa.binary()), ("error", pa.string())])
        for b in batches:
            for i, media in zip(b.column(0), b.column(1), strict=True):
                data = media.as_py()
                if data is None:
                    continue
                rows: list[tuple] = []
                try:
                    for p in pages(data):
                        h, w, s = p.pixels.shape
                        rows.append((i.as_py(), p.page, w, h, s, p.bits, NAMES[p.compression], p.predictor, p.tiled, p.pixels.tobytes(), None))
                except _DAMAGE as e:
                    rows.append((i.as_py(), len(rows), *[None] * 8, str(e) or type(e).__name__))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(media_col).alias("media")).mapInArrow(run, _PAGES)
