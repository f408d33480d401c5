"""Media columns: Netpbm and BMP images as numpy arrays, resized by area, kept as NPY tiles with difference hashes."""

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

from quillspark.llm.common import settle, slices

#: Payloads are padded to a multiple of this many bytes, the samples of one row of their image.
UNIT = 576
#: Samples of an image that are summed at once.
BLOCK_SAMPLES = 1 << 20
_HEADER = re.compile(rb"(?:\s|#[^\r\n]*[\r\n])*([^\s#]+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width) or (height, width, 3) samples; 16-bit ones big-endian; bitmaps as 0 (black) and 255."""
    place, fields = 0, []
    kind = data[:2]
    need = 3 if kind in (b"P1", b"P4") else 4
    while len(fields) < need:
        if not (found := _HEADER.match(data, place)):
            raise ValueError("not a Netpbm image: its header ends early")
        fields.append(found[1])
        place = found.end()
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6") or fields[0] != kind:
        raise ValueError(f"not a Netpbm image: it starts with {data[:2]!r}")
    width, height = int(fields[1]), int(fields[2])
    most = int(fields[3]) if need == 4 else 1
    bands = 3 if kind in (b"P3", b"P6") else 1
    sample = np.dtype(">u2") if most > 255 else np.dtype("u1")
    if kind == b"P4":
        bits = np.frombuffer(data, np.uint8, height * (-(-width // 8)), place + 1).reshape(height, -1)
        return (1 - np.unpackbits(bits, axis=1)[:, :width]) * np.uint8(255)
    if kind in (b"P5", b"P6"):
        values = np.frombuffer(data, sample, height * width * bands, place + 1)
    else:
        text = re.sub(rb"#[^\r\n]*", b"", data[place:])
        values = np.array(re.findall(rb"[01]", text) if kind == b"P1" else text.split(), dtype=np.int64)[: height * width * bands].astype(sample)
    if kind == b"P1":
        values = (1 - values) * np.uint8(255)
    return values.reshape((height, width, 3) if bands == 3 else (height, width))


def encode_netpbm(image: np.ndarray) -> bytes:
    """8-bit grey (P5) or colour (P6)."""
    kind = "P6" if image.ndim == 3 else "P5"
    return f"{kind}\n{image.shape[1]} {image.shape[0]}\n255\n".encode() + np.ascontiguousarray(image, np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 bits with palette, 24 or 32 bits, either row order, as RGB (grey if the palette is)."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, header = struct.unpack_from("<II", data, 10)
    width, height, _, depth, packed = struct.unpack_from("<iiHHI", data, 18)
    if packed not in (0, 3) or depth not in (8, 24, 32):
        raise ValueError(f"BMP of {depth} bits, compression {packed}, isn't supported")
    stride = (width * depth + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * depth // 8]
    rows = rows[::-1] if height > 0 else rows
    if depth == 8:
        colours = np.frombuffer(data, np.uint8, (start - 14 - header) // 4 * 4, 14 + header).reshape(-1, 4)[:, 2::-1]
        if rows.size and rows.max() >= len(colours):
            raise ValueError("BMP names a colour that its palette lacks")
        grey = bool((colours == colours[:, :1]).all())
        return (colours[:, 0] if grey else colours)[rows]
    return np.ascontiguousarray(rows.reshape(abs(height), width, depth // 8)[:, :, 2::-1])


def encode_bmp(image: np.ndarray) -> bytes:
    """24-bit BMP of an RGB or grey 8-bit image, lowest row first."""
    colour = np.repeat(image[:, :, None], 3, axis=2) if image.ndim == 2 else image
    height, width = colour.shape[:2]
    stride = (width * 24 + 31) // 32 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = colour[::-1, :, ::-1].reshape(height, width * 3)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return head + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    """An image of either format; ValueError for what is neither, cut short, or without a sample."""
    try:
        image = decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)
    except (struct.error, OverflowError, IndexError) as error:
        raise ValueError(f"unreadable image: {error}") from error
    if not image.size:
        raise ValueError("an image without a sample")
    return image


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of a colour image."""
    return image @ np.array([0.299, 0.587, 0.114]) if image.ndim == 3 else image.astype(np.float64)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each output sample's area of an image's grey, by its integral image; area edges are interpolated.

    The integral image is summed in blocks of rows, of which only those at the edges are kept.
    """
    rows, columns = image.shape[:2]
    low, part = _edges(height, rows)
    wanted = np.unique(np.concatenate([low, low + 1]))
    kept = np.zeros((len(wanted), columns + 1))
    carry = np.zeros(columns + 1)
    step = max(1, BLOCK_SAMPLES // columns)
    for start in range(0, rows, step):
        total = np.zeros((min(step, rows - start) + 1, columns + 1))
        np.cumsum(np.cumsum(grey(image[start : start + step]), axis=1), axis=0, out=total[1:, 1:])
        total += carry
        some = (wanted >= start) & (wanted < start + len(total))
        kept[some] = total[wanted[some] - start]
        carry = total[-1]
    place = np.searchsorted(wanted, low)
    sums = kept[place] * (1 - part)[:, None] + kept[place + 1] * part[:, None]
    low, part = _edges(width, columns)
    sums = sums[:, low] * (1 - part) + sums[:, low + 1] * part
    return np.diff(np.diff(sums, axis=0), axis=1) / (rows / height * columns / width)


def _edges(count: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sample that each of `count` equal parts' edges falls in, and where in it."""
    edge = np.arange(count + 1) * (size / count)
    low = np.minimum(edge.astype(np.int64), size - 1)
    return low, edge - low


def difference_hash(image: np.ndarray) -> int:
    """64 bits: whether each of 8 x 8 samples of the 9 x 8 resized image is brighter than the next in its row."""
    small = area_resize(image, 8, 9)
    return int.from_bytes(np.packbits(small[:, :-1] > small[:, 1:]).tobytes(), "big")


def to_npy(image: np.ndarray) -> bytes:
    """An array as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, image, allow_pickle=False)
    return out.getvalue()


def from_npy(data: bytes) -> np.ndarray:
    """The array of an NPY file's bytes."""
    return np.load(io.BytesIO(data), allow_pickle=False)


def payload_image(payload: bytes) -> bytes:
    """A payload as the grey PGM image whose rows hold UNIT samples; 255 fills the last row, and there is at least one."""
    size = max(UNIT, -(-len(payload) // UNIT) * UNIT)
    return encode_netpbm(np.frombuffer(payload.ljust(size, b"\xff"), np.uint8).reshape(-1, UNIT))


def media_tiles(media: DataFrame, id_col: str, media_col: str, tile: tuple[int, int] | None = None) -> DataFrame:
    """(id, tile, height, width, npy, dhash): each image's NPY tiles with their difference hashes.

    `tile` is (height, width) to resize to by area, or None to keep the image as it is.
    Null and unreadable media give a row with null npy and dhash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [_tile(data, tile) for data in batch.column(1).to_pylist()]
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "height", "width", "npy", "dhash"])

    return media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(run, "id long, height int, width int, npy binary, dhash long")


def _tile(data: bytes | None, tile: tuple[int, int] | None) -> tuple[int | None, int | None, bytes | None, int | None]:
    try:
        image = decode(data or b"")
    except ValueError:
        return None, None, None, None
    mark = difference_hash(image)
    if tile:
        image = np.clip(np.rint(area_resize(image, *tile)), 0, 255).astype(np.uint8)
    return image.shape[0], image.shape[1], to_npy(image), mark - (1 << 64 if mark >> 63 else 0)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, npy) of each text: its UTF-8 bytes (null: none) as a PGM image, decoded and kept as an NPY tile of 8-bit samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [data or b"" for data in batch.column(1).to_pylist()]
            tiles = [to_npy(decode_netpbm(payload_image(data))) for data in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(tiles, pa.binary())], names=["doc_id", "n_bytes", "npy"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("media")).mapInArrow(run, "doc_id long, n_bytes long, npy binary")


def read_tiles(stored: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload digests, media digests, feature) of stored tiles (doc_id, n_bytes, npy); the feature is the difference hash."""
    kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [_told(npy) for npy in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds.values(), strict=True))], names=["doc_id", "n_bytes", *kinds])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.mapInArrow(run, schema)


def _told(npy: bytes) -> tuple:
    image = from_npy(npy)
    payload = image.tobytes()
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(npy), hashlib.sha256(npy).hexdigest(), f"{difference_hash(image):016x}"


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text kept as an image and told by its stored bytes: `read_tiles` of `store_texts`, written in between.

    Equal texts give equal values; a text of any length, null or empty, is one row.  Repeated
    ids keep a row each; other columns are not used.
    """
    return read_tiles(settle(store_texts(docs, id_col, text_col)))
