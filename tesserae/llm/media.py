"""Media columns: Netpbm and BMP images to numpy arrays, resized by area, written as NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batch_of, in_arrow, table
from .kernels import slices

#: Samples in a row of the images that hold text bytes.
WIDTH = 64
#: Rows and columns of a tile.
TILE = 256
#: Rows of an image whose running sums are held at once.
BAND = 4096


def _header(data: bytes, fields: int) -> tuple[list[int], int]:
    """Numbers after a Netpbm magic, with comments skipped, and the place after the one white space that ends them."""
    at, found = 2, []
    while len(found) < fields:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            while data[at : at + 1] not in (b"\n", b""):
                at += 1
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("not a Netpbm header")
        found.append(int(data[at:end]))
        at = end
    return found, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array (rows, columns) or (rows, columns, 3), unsigned 8 or 16 bits; a set bit of P1 and P4 is 0."""
    kind = data[:2]
    (width, height, *most), at = _header(data, 2 if kind in (b"P1", b"P4") else 3)
    most = most[0] if most else 1
    depth = 3 if kind in (b"P3", b"P6") else 1
    count = width * height * depth
    # A header that claims more than the data holds is an error before anything is allocated.
    if not width * height or count > 8 * (len(data) - at):
        raise ValueError("not as many samples as the header says")
    if kind == b"P4":
        row = -(-width // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at).reshape(height, row), axis=1)[:, :width]
        return (1 - bits) * np.uint8(255)
    if kind == b"P1":
        body = bytes(c for c in data[at:] if c in b"01")
        return (1 - (np.frombuffer(body, np.uint8, count) - 48).reshape(height, width)) * np.uint8(255)
    wide = most > 255
    if kind in (b"P2", b"P3"):
        out = np.array(data[at:].split()[:count], np.uint16 if wide else np.uint8)
    elif kind in (b"P5", b"P6"):
        out = np.frombuffer(data, ">u2" if wide else np.uint8, count, at)
        out = out.astype(np.uint16) if wide else out
    else:
        raise ValueError("not a Netpbm image")
    return out.reshape((height, width, 3) if depth == 3 else (height, width))


def encode_pgm(image: np.ndarray) -> bytes:
    """A binary P5 image of 8-bit samples."""
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits as (rows, columns) if all grey by palette, else (rows, columns, 3)."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, head, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32) or width <= 0 or not height:
        raise ValueError("unsupported BMP image")
    row = (width * bits + 31) // 32 * 4
    body = np.frombuffer(data, np.uint8, row * abs(height), start).reshape(abs(height), row)
    if height > 0:
        body = body[::-1]
    if bits >= 24:
        step = bits // 8
        return body[:, : width * step].reshape(abs(height), width, step)[:, :, 2::-1].copy()
    colours = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.frombuffer(data, np.uint8, colours * 4, 14 + head).reshape(colours, 4)[:, 2::-1]
    if bits == 8:
        index = body[:, :width]
    else:
        each = np.unpackbits(body, axis=1).reshape(abs(height), -1, bits)
        index = (each * (1 << np.arange(bits - 1, -1, -1))).sum(2)[:, :width]
    out = palette[index]
    return out[:, :, 0].copy() if (palette == palette[:, :1]).all() else out


_GREY = b"".join(bytes((i, i, i, 0)) for i in range(256))


def encode_bmp(image: np.ndarray) -> bytes:
    """An 8-bit grey-palette BMP, or 24 bits for three channels; rows bottom up."""
    height, width = image.shape[:2]
    bits = 24 if image.ndim == 3 else 8
    row = (width * bits + 31) // 32 * 4
    body = np.zeros((height, row), np.uint8)
    flat = image[:, :, ::-1].reshape(height, -1) if image.ndim == 3 else image
    body[:, : flat.shape[1]] = flat
    grey = _GREY if bits == 8 else b""
    start = 54 + len(grey)
    return struct.pack(
        "<2sIHHIIiiHHIIiiII",
        b"BM",
        start + body.size,
        0,
        0,
        start,
        40,
        width,
        height,
        1,
        bits,
        0,
        body.size,
        2835,
        2835,
        256 if grey else 0,
        0,
    ) + grey + body[::-1].tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean of the source area that each target cell covers, fractions included, from an integral image.

    The integral image is made band by band, and only its rows next to an edge of a target cell are kept.
    """
    height, width = image.shape[:2]

    def edges(size: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
        """Last whole row before each edge between cells, and the part of the next row that lies before it."""
        at = np.arange(cells + 1) * size / cells
        low = np.minimum(at.astype(np.int64), size - 1)
        return low, at - low

    low, part = edges(height, rows)
    wanted = np.union1d(low, low + 1)
    total = np.zeros((len(wanted), width))
    carry = np.zeros(width)
    for start in range(0, height, BAND):
        band = image[start : start + BAND]
        band = np.cumsum(band if band.ndim == 2 else band.mean(2), axis=0, dtype=np.float64) + carry
        here = (wanted > start) & (wanted <= start + len(band))
        total[here] = band[wanted[here] - start - 1]
        carry = band[-1]
    whole = np.searchsorted(wanted, low)
    bands = np.diff(total[whole] * (1 - part)[:, None] + total[np.searchsorted(wanted, low + 1)] * part[:, None], axis=0)
    total = np.concatenate([np.zeros((rows, 1)), np.cumsum(bands, axis=1)], axis=1)
    low, part = edges(width, columns)
    sums = np.diff(total[:, low] * (1 - part) + total[:, low + 1] * part, axis=1)
    return sums / (height * width / (rows * columns))


def difference_hash(image: np.ndarray) -> str:
    """64 bits as 16 hex digits: whether each cell of an 8 x 9 resize is darker than its right neighbour."""
    small = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tiles(image: np.ndarray, tile: int = TILE) -> Iterator[tuple[int, int, bytes]]:
    """(row, column, NPY file) for each tile; those at the right and lower edge are smaller."""
    for y in range(0, image.shape[0], tile):
        for x in range(0, image.shape[1], tile):
            out = io.BytesIO()
            np.save(out, np.ascontiguousarray(image[y : y + tile, x : x + tile]))
            yield y // tile, x // tile, out.getvalue()


def packed(tiles: Iterator[tuple[int, int, bytes]]) -> bytes:
    """An archive of tiles: for each its row, column and length (three little-endian 32-bit numbers) and its NPY file."""
    return b"".join(struct.pack("<III", y, x, len(npy)) + npy for y, x, npy in tiles)


def unpacked(archive: bytes, tile: int = TILE) -> np.ndarray:
    """The image whose tiles an archive holds."""
    at, found = 0, {}
    while at < len(archive):
        y, x, size = struct.unpack_from("<III", archive, at)
        found[y, x] = np.load(io.BytesIO(archive[at + 12 : at + 12 + size]))
        at += 12 + size
    high, wide = (1 + max(place[i] for place in found) for i in (0, 1))
    if wide == 1:
        return found[0, 0] if high == 1 else np.concatenate([found[y, 0] for y in range(high)])
    return np.concatenate([np.concatenate([found[y, x] for x in range(wide)], axis=1) for y in range(high)])


def media_tiles(images: DataFrame, *, id_col: str, data_col: str, tile: int = TILE) -> DataFrame:
    """One row for each tile of each image: id, row, col, height, width, dhash (the image's), npy.

    Null images give no row; bytes that can't be decoded give one row with null tile and an error text.
    """
    kind = images.schema[id_col].dataType.simpleString()

    def per_batch(batch: pa.RecordBatch):
        for key, data in zip(batch.column(0), batch.column(1), strict=True):
            if not data.is_valid:
                continue
            key = pa.array([key.as_py()], batch.schema.field(0).type)
            try:
                image = decode(data.as_py())
                mark = difference_hash(image)
            except (ValueError, struct.error, IndexError) as e:
                none = pa.nulls(1, pa.int32())
                yield batch_of(
                    id=key,
                    row=none,
                    col=none,
                    height=none,
                    width=none,
                    dhash=pa.nulls(1, pa.string()),
                    npy=pa.nulls(1, pa.binary()),
                    error=[str(e)],
                )
                continue
            for y, x, npy in npy_tiles(image, tile):
                yield batch_of(
                    id=key,
                    row=np.array([y], np.int32),
                    col=np.array([x], np.int32),
                    height=np.array([image.shape[0]], np.int32),
                    width=np.array([image.shape[1]], np.int32),
                    dhash=[mark],
                    npy=pa.array([npy], pa.binary()),
                    error=pa.nulls(1, pa.string()),
                )

    return in_arrow(
        images.select(id_col, data_col),
        per_batch,
        f"id {kind}, row int, col int, height int, width int, dhash string, npy binary, error string",
    )


def text_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """Each text's bytes as a grey image (PGM, or BMP where the number of rows is odd), decoded, and stored as an archive
    of NPY tiles, the column `tiles`; hashes are those of the archive, of what is read back from it, and its feature.

    One row for each row of docs. A null text is empty; an empty text is one row of 64 zeros. Repeated ids and texts
    give equal values; other columns don't matter; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_tiles long, tiles binary"

    def per_batch(batch: pa.RecordBatch):
        ids = batch.column(0)
        for a, b, data, offsets in slices(batch.column(1)):
            rows = []
            for start, end in itertools.pairwise(offsets.tolist()):
                size = end - start
                samples = np.zeros(max(1, -(-size // WIDTH)) * WIDTH, np.uint8)
                samples[:size] = data[start:end]
                samples = samples.reshape(-1, WIDTH)
                image = decode(encode_bmp(samples) if len(samples) % 2 else encode_pgm(samples))
                tiles = list(npy_tiles(image, tile))
                archive = packed(iter(tiles))
                image = unpacked(archive, tile)
                payload = image.tobytes()
                rows.append(
                    (
                        size,
                        len(payload),
                        hashlib.sha256(payload).hexdigest(),
                        zlib.crc32(payload[-64:]),
                        len(archive),
                        hashlib.sha256(archive).hexdigest(),
                        difference_hash(image),
                        len(tiles),
                        archive,
                    )
                )
            cols = list(zip(*rows, strict=True))
            yield batch_of(
                doc_id=ids.slice(a, b - a),
                n_bytes=cols[0],
                payload_bytes=cols[1],
                payload_sha256=cols[2],
                tail_crc32=cols[3],
                media_bytes=cols[4],
                media_sha256=cols[5],
                feature=cols[6],
                n_tiles=cols[7],
                tiles=pa.array(cols[8], pa.binary()),
            )

    return in_arrow(docs.select(id_col, text_col), per_batch, schema)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents")).drop("tiles")
