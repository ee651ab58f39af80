"""Image files written from rasters: gray and colour PNG, BMP, TIFF, PGM, and JPEG of flat blocks.

Encoding is per image inside tasks, and a file appears under its name by a rename, so a task that is run again replaces what
it wrote before.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - used as pa.compute
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame

BLOCK = 8               # pixels of a side of a JPEG block


def pgm(v: np.ndarray) -> bytes:
    return f"P5\n{v.shape[1]} {v.shape[0]}\n255\n".encode() + v.tobytes()


def png(v: np.ndarray) -> bytes:
    """Gray for two dimensions, RGB for three."""
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.pad(v.reshape(len(v), -1), ((0, 0), (1, 0)))      # each line begins with filter type 0
    head = struct.pack(">IIBBBBB", v.shape[1], v.shape[0], 8, 2 if v.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def bmp(v: np.ndarray) -> bytes:
    """Gray by a palette, or 24 bits a pixel; lines from the bottom, padded to four bytes."""
    rows = (v[..., ::-1] if v.ndim == 3 else v).reshape(len(v), -1)[::-1]
    body = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4))).tobytes()
    palette = b"" if v.ndim == 3 else b"".join(bytes([g, g, g, 0]) for g in range(256))
    start = 54 + len(palette)
    return (b"BM" + struct.pack("<IHHI", start + len(body), 0, 0, start) + struct.pack(
        "<IiiHHIIiiII", 40, v.shape[1], v.shape[0], 1, 24 if v.ndim == 3 else 8, 0, len(body), 0, 0, 0 if v.ndim == 3 else 256, 0)
        + palette + body)


def tiff(v: np.ndarray) -> bytes:
    """One uncompressed strip, little-endian."""
    colours = 3 if v.ndim == 3 else 1
    data = v.tobytes() + b"\0" * (v.size % 2)
    directory = 8 + len(data)
    tags = [(256, 4, v.shape[1]), (257, 4, v.shape[0]), (258, 3, 8), (259, 3, 1), (262, 3, 2 if colours == 3 else 1), (273, 4, 8),
            (277, 3, colours), (278, 4, v.shape[0]), (279, 4, v.size), (284, 3, 1)]
    if colours == 3:        # three depths do not fit into the entry: they follow the directory
        tags[2] = (258, 3, directory + 2 + 12 * len(tags) + 4)
    entries = b"".join(struct.pack("<HHII", tag, kind, 3 if tag == 258 and colours == 3 else 1, value) for tag, kind, value in tags)
    return (b"II*\0" + struct.pack("<I", directory) + data + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0)
            + (struct.pack("<HHH", 8, 8, 8) if colours == 3 else b""))


def flat_jpeg(v: np.ndarray) -> bytes:
    """A gray baseline JPEG whose every 8 x 8 block has one value of ``v``: only mean coefficients, quantised by 1, so that
    any decoder gives the values back exactly. The file is eight times as high and wide as ``v``."""
    def segment(marker: int, data: bytes) -> bytes:
        return struct.pack(">HH", 0xFF00 | marker, len(data) + 2) + data

    # prefix codes: the twelve size classes of mean differences have four bits each; the end of a block has one bit
    means = segment(0xC4, bytes([0x00, 0, 0, 0, 12, *[0] * 12, *range(12)]))
    ends = segment(0xC4, bytes([0x10, 1, *[0] * 15, 0]))
    change = np.diff((v.astype(np.int64).ravel() - 128) * 8, prepend=0).tolist()
    bits = []
    for d in change:
        size = abs(d).bit_length()
        bits.append(f"{size:04b}" + (format(d if d > 0 else d + (1 << size) - 1, f"0{size}b") if size else "") + "0")
    text = "".join(bits)
    text += "1" * (-len(text) % 8)
    scan = int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\0")
    frame = struct.pack(">BHHBBBB", 8, BLOCK * v.shape[0], BLOCK * v.shape[1], 1, 1, 0x11, 0)
    return (b"\xff\xd8" + segment(0xDB, bytes([0, *[1] * 64])) + segment(0xC0, frame) + means + ends
            + segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])) + scan + b"\xff\xd9")


ENCODERS: dict[str, Callable[[np.ndarray], bytes]] = {
    "pgm": pgm, "png": png, "bmp": bmp, "tif": tiff, "tiff": tiff, "jpg": flat_jpeg, "jpeg": flat_jpeg}


def encode_images(rasters: DataFrame, name: str = "name", channels: str | None = None) -> DataFrame:
    """Rasters as files (name, content): the extension of ``name`` chooses the format.

    Images of 3 ``channels`` (a column) hold red, green and blue one after the other per pixel, for png, bmp, tif and
    tiff. JPEG files are eight times as high and wide, see ``flat_jpeg``."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = []
            for file, height, width, depth, px in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                v = px.values.to_numpy(zero_copy_only=False).astype(np.uint8)
                content.append(ENCODERS[file.rsplit(".", 1)[1].lower()](
                    v.reshape((height, width, 3) if depth == 3 else (height, width))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], ["name", "content"])

    depth = f"`{channels}`" if channels else "1"
    return rasters.selectExpr(f"`{name}` as name", "height", "width", f"cast({depth} as int) as depth", "px").mapInArrow(
        encode, "name string, content binary")


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write rows (name, content) as files below ``folder`` (local, or a URI that Arrow can write); returns (name, bytes).

    Nothing is written before an action; a name that repeats is overwritten."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        fs.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = f"{root}/.{file}.{attempt}"
                with fs.open_output_stream(part) as out:
                    out.write(content)
                fs.move(part, f"{root}/{file}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.compute.binary_length(batch.column(1)).cast(pa.int64())],
                                             ["name", "bytes"])

    return files.select("name", "content").mapInArrow(write, "name string, bytes long")
