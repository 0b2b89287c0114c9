"""Media columns: Netpbm and BMP images as numpy arrays, area-resized by integral images, as NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, texts_of

#: Rows of an image whose integral image is held at once.
STRIP_ROWS = 4096
TILE = 16
#: A few bytes can claim any size in a run-length BMP; larger ones are refused.
MOST_RUN_PIXELS = 1 << 28


# --- formats -----------------------------------------------------------------------------------------------------------


def _netpbm_head(data: bytes, fields: int) -> tuple[list[int], int]:
    values, at = [], 2
    for _ in range(fields):
        m = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)").match(data, at)
        if not m:
            raise ValueError("Netpbm header ends early")
        values.append(int(m[1]))
        at = m.end()
    return values, at


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[1:2]
    bitmap, plain = kind in b"14", kind in b"123"
    head, at = _netpbm_head(data, 2 if bitmap else 3)
    width, height, top = head[0], head[1], 1 if bitmap else head[2]
    if not (width > 0 and height > 0 and 0 < top < 65536):
        raise ValueError("Netpbm size or maximum out of range")
    bands = 3 if kind in b"36" else 1
    n = width * height * bands
    if plain:
        body = re.sub(rb"#[^\n\r]*", b"", data[at:])
        raw = np.array([int(x) for x in (re.findall(rb"[01]", body) if bitmap else body.split())[:n]], np.uint32)
    elif bitmap:
        line = -(-width // 8)
        rows = np.frombuffer(data, np.uint8, min(line * height, len(data) - at - 1), at + 1)
        if len(rows) < line * height:
            raise ValueError("Netpbm body ends early")
        raw = np.unpackbits(rows.reshape(height, line), axis=1)[:, :width].reshape(-1)
    else:
        kind_of = np.dtype(">u2" if top > 255 else np.uint8)
        if len(data) - at - 1 < n * kind_of.itemsize:
            raise ValueError("Netpbm body ends early")
        raw = np.frombuffer(data, kind_of, n, at + 1)
    if len(raw) < n:
        raise ValueError("Netpbm body ends early")
    if bitmap:
        raw = np.where(raw != 0, 0, 255).astype(np.uint8)
    elif top != 255:
        raw = ((raw.astype(np.uint64) * 255 + top // 2) // top).clip(0, 255).astype(np.uint8)
    return raw.reshape(height, width, bands)


def _bmp_runs(data: bytes, at: int, rows: int, width: int, depth: int) -> np.ndarray:
    """Colour indexes of a run-length body, its last row first; pixels that no run reaches have index 0."""
    if rows * width > MOST_RUN_PIXELS:
        raise ValueError("run-length BMP is too large")
    out = np.zeros((rows, width), np.uint8)
    x = y = 0
    while y < rows:
        if at + 2 > len(data):
            raise ValueError("BMP body ends early")
        n, value = data[at], data[at + 1]
        at += 2
        if n:
            raw = bytes([value]) * (n if depth == 8 else -(-n // 2))
        elif value == 0:
            x, y = 0, y + 1
            continue
        elif value == 1:
            break
        elif value == 2:
            if at + 2 > len(data):
                raise ValueError("BMP body ends early")
            x, y, at = x + data[at], y + data[at + 1], at + 2
            continue
        else:
            n = value
            size = n if depth == 8 else -(-n // 2)
            raw = data[at : at + size]
            if len(raw) < size:
                raise ValueError("BMP body ends early")
            at += size + size % 2
        pixels = np.frombuffer(raw, np.uint8)
        if depth == 4:
            pixels = np.stack((pixels >> 4, pixels & 15), 1).reshape(-1)
        n = min(n, max(0, width - x))
        out[y, x : x + n] = pixels[:n]
        x += n
    return out


def _bmp(data: bytes) -> np.ndarray:
    if len(data) < 26:
        raise ValueError("BMP header ends early")
    start, head = struct.unpack_from("<II", data, 10)
    core, packing = head == 12, 0
    if core:
        width, height, _, depth = struct.unpack_from("<HHHH", data, 18)
    elif head >= 40 and len(data) >= 54:
        width, height, _, depth, packing = struct.unpack_from("<iiHHI", data, 18)
    else:
        raise ValueError("BMP header ends early")
    known = {0: (1, 4, 8, 16, 24, 32), 1: (8,), 2: (4,), 3: (16, 32), 6: (16, 32)}
    if depth not in known.get(packing, ()) or width <= 0 or height == 0 or (packing in (1, 2) and height < 0):
        raise ValueError(f"BMP of depth {depth} and packing {packing} isn't supported")
    line, rows = (width * depth + 31) // 32 * 4, abs(height)
    if packing in (1, 2):
        index = _bmp_runs(data, start, rows, width, depth)
    else:
        if len(data) - start < line * rows:
            raise ValueError("BMP body ends early")
        body = np.frombuffer(data, np.uint8, line * rows, start).reshape(rows, line)
    if packing in (3, 6) or depth == 16:
        if packing and len(data) < 66:
            raise ValueError("BMP header ends early")
        masks = struct.unpack_from("<III", data, 54) if packing else (0x7C00, 0x3E0, 0x1F)
        pixels = np.ascontiguousarray(body[:, : width * depth // 8]).view("<u2" if depth == 16 else "<u4").astype(np.uint64)
        out = np.zeros((rows, width, 3), np.uint8)
        for band, mask in enumerate(masks):
            if mask:
                low = (mask & -mask).bit_length() - 1
                top = mask >> low
                out[:, :, band] = (((pixels & np.uint64(mask)) >> np.uint64(low)) * np.uint64(255) + np.uint64(top // 2)) // np.uint64(top)
    elif depth >= 24:
        out = body[:, : width * depth // 8].reshape(rows, width, depth // 8)[:, :, 2::-1]
    else:
        colours = 1 << depth if core else struct.unpack_from("<I", data, 46)[0] or 1 << depth
        each = 3 if core else 4
        palette = np.frombuffer(data, np.uint8, each * colours, 14 + head).reshape(-1, each)[:, 2::-1]
        if not packing:
            bits = np.unpackbits(body, axis=1).reshape(rows, -1, depth)
            index = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2)[:, :width]
        if index.max() >= len(palette):
            raise ValueError("BMP index beyond its palette")
        out = palette[index]
    return out[::-1] if height > 0 else out


def decode_image(data: bytes) -> np.ndarray:
    """A height x width x bands array of 8-bit samples, of Netpbm P1-P6 or of a BMP; ValueError for the rest."""
    if len(data) > 2 and data[:1] == b"P" and data[1:2] in b"123456":
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def encode_ppm(pixels: np.ndarray) -> bytes:
    height, width, bands = pixels.shape
    return b"P%d\n%d %d\n255\n" % (6 if bands == 3 else 5, width, height) + np.ascontiguousarray(pixels).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24 bits a pixel, last row first."""
    height, width, _ = pixels.shape
    line = (width * 3 + 3) // 4 * 4
    body = np.zeros((height, line), np.uint8)
    body[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, -1)
    return b"BM" + struct.pack("<IHHI", 54 + body.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def npy_bytes(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(tile), allow_pickle=False)
    return out.getvalue()


# --- pixels ------------------------------------------------------------------------------------------------------------


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the source area under each target pixel, from integral images of at most STRIP_ROWS rows each.

    The area's borders fall between samples; there the integral image is interpolated, which weighs samples by the
    part of them that is covered. Works in either direction, and memory does not grow with the image's height.
    """
    rows, cols, bands = pixels.shape
    xs, ys = np.linspace(0, cols, width + 1), np.linspace(0, rows, height + 1)
    x0 = np.minimum(xs.astype(np.int64), cols - 1)
    fx = (xs - x0)[:, None]
    total = np.zeros((height, width, bands))
    for top in range(0, rows, STRIP_ROWS):
        strip = pixels[top : top + STRIP_ROWS]
        n = len(strip)
        integral = np.zeros((n + 1, cols + 1, bands))
        np.cumsum(strip, axis=0, out=integral[1:, 1:], dtype=np.float64)
        np.cumsum(integral[1:, 1:], axis=1, out=integral[1:, 1:])
        y = np.clip(ys - top, 0, n)
        y0 = np.minimum(y.astype(np.int64), n - 1)
        fy = (y - y0)[:, None, None]
        at = integral[y0] * (1 - fy) + integral[y0 + 1] * fy
        at = at[:, x0] * (1 - fx) + at[:, x0 + 1] * fx
        total += np.diff(np.diff(at, axis=0), axis=1)
    return np.rint(total * (height * width / (rows * cols))).clip(0, 255).astype(np.uint8)


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits as hex: in a grey 9 x 8 thumbnail, is a pixel brighter than its right neighbour?"""
    small = area_resize(pixels, 8, 9).astype(np.int64)
    grey = small[:, :, 0] if small.shape[2] == 1 else (299 * small[:, :, 0] + 587 * small[:, :, 1] + 114 * small[:, :, 2]) // 1000
    return np.packbits(grey[:, :-1] > grey[:, 1:]).tobytes().hex()


# --- operators ---------------------------------------------------------------------------------------------------------

_MEDIA = "height int, width int, bands int, tile_npy binary, dhash string, media_error string"


def media_columns(df: DataFrame, column: str, tile: int = TILE) -> DataFrame:
    """df with what the image bytes in ``column`` hold: height, width, bands, an NPY tile of tile x tile pixels, and a difference hash.

    A null, or bytes that are no supported image, gives nulls and says why in media_error; other rows go on. Rows are
    independent: nothing is shuffled, and a lost task is just run again. df's columns of the same names are replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for value in batch.column(0):
                data = value.as_py()
                try:
                    if data is None:
                        raise ValueError("null")
                    pixels = decode_image(data)
                    out.append((*pixels.shape, npy_bytes(area_resize(pixels, tile, tile)), difference_hash(pixels), None))
                except ValueError as e:
                    out.append((None, None, None, None, None, str(e)))
            made = [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 6, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], names=[*names, *(x.split()[0] for x in _MEDIA.split(", "))])

    made = {x.split()[0].lower() for x in _MEDIA.split(", ")}
    names = [c for c in df.columns if c.lower() not in made]
    schema = ", ".join(f"`{c.replace('`', '``')}` {df.schema[c].dataType.simpleString()}" for c in names)
    q = lambda c: F.col(f"`{c.replace('`', '``')}`")
    return df.select(q(column).alias("__image"), *map(q, names)).mapInArrow(run, f"{schema}, {_MEDIA}" if schema else _MEDIA)


def text_image(text: bytes, pad: int = 192) -> bytes:
    """A binary PPM, 64 pixels wide, whose samples are the text, filled up with spaces to a positive multiple of ``pad`` bytes."""
    payload = text + b" " * (-len(text) % pad or (0 if text else pad))
    return encode_ppm(np.frombuffer(payload, np.uint8).reshape(-1, 64, 3))


def text_media(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """Texts stored as PPM images, read back, and described: one row for each row of documents.

    A null text counts as empty, and an empty one is stored as 192 spaces. Equal texts give equal values; doc_id is
    passed through, nulls and repeats included; other columns are not read. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = texts_of(batch.column(1))
            for a, b in chunks(offsets):
                rows = []
                for i in range(a, b):
                    text = data[offsets[i] : offsets[i + 1]].tobytes()
                    media = text_image(text)
                    pixels = decode_image(media)
                    payload = np.ascontiguousarray(pixels).data.cast("B")
                    small = npy_bytes(area_resize(pixels, tile, tile))
                    rows.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(pixels), small))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "dhash", "tile_npy"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, dhash string, tile_npy binary")


def op5_media(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    out = text_media(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat(F.col("dhash"), F.lit(":"), F.sha2("tile_npy", 256)).alias("feature"))
