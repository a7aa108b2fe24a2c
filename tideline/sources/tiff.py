"""Reading GeoTIFFs by byte ranges: classic and BigTIFF, strips and tiles, either byte
order, bands interleaved or apart; plain, LZW, deflated or PackBits; no, horizontal or
floating-point predictor.  The first image of a file is read; overviews behind it are not.

Only what is asked for is read: the header, the entries of the blocks (strips or tiles)
wanted, and their bytes.  ``TiffSource`` is the Spark data source over a folder of them.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the format: field type -> (bytes, struct code).
FIELD = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
#: Fixed values of the format: names of the tags that are read.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_AT, BANDS, STRIP_ROWS, STRIP_SIZE, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_SIZE, SAMPLE_FORMAT, SCALE, TIE, TRANSFORM, GEO_KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42113
#: Fixed values of the format: compressions, and geographic keys.
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
RASTER_TYPE, GEOGRAPHIC, PROJECTED, POINT = 1025, 2048, 3072, 2
BANDS_OUT = ("red", "green", "blue", "nir")

Read = Callable[[int, int], bytes]


def plain_path(path: str) -> str:
    """A local file's path without its scheme; others as they are."""
    return re.sub(r"^file:/+", "/", path)


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    path = plain_path(path)
    return (pa.fs.LocalFileSystem(), path) if path.startswith("/") else pa.fs.FileSystem.from_uri(path)


def by_ranges(path: str) -> bool:
    """Can files of this store be read in part from Python?"""
    try:
        file_system(path)
        return True
    except (pa.ArrowException, OSError, NotImplementedError):
        return False


def opened(path: str) -> Read:
    """Reads byte ranges of a file."""
    store, name = file_system(path)
    file = store.open_input_file(name)

    def read(at: int, n: int) -> bytes:
        return file.read_at(n, at)

    return read


def held(raw: bytes) -> Read:
    return lambda at, n: raw[at : at + n]


# ------------------------------------------------------------------- compression


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 clears the table, 257 ends.  The width
    grows one code before the table needs it."""
    start = [bytes([k]) for k in range(256)] + [b"", b""]
    table, width, before = list(start), 9, b""
    out, bits, have = [], 0, 0
    for byte in data:
        bits = bits << 8 | byte
        have += 8
        if have < width:
            continue
        have -= width
        code = bits >> have
        bits &= (1 << have) - 1
        if code == 256:
            table, width, before = list(start), 9, b""
            continue
        if code == 257:
            break
        if code < len(table):
            piece = table[code]
        elif code == len(table) and before:
            piece = before + before[:1]
        else:
            raise ValueError("a code of the LZW data is not in its table")
        out.append(piece)
        if before:
            table.append(before + piece[:1])
        before = piece
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def packbits(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += n + 2
        elif n > 128:
            out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2
        else:
            at += 1
    return b"".join(out)


UNPACK = {PLAIN: lambda b: b, LZW: lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: packbits}


# ------------------------------------------------------------------------- files


class Tiff:
    """One file through a function that reads byte ranges."""

    def __init__(self, read: Read):
        self.read = read
        head = read(0, 16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        kind = struct.unpack(order + "H", head[2:4])[0] if order and len(head) >= 8 else 0
        if kind not in (42, 43):
            raise ValueError("not a TIFF")
        self.order, self.big = order, kind == 43
        long, count, self.inline = ("Q", "Q", 8) if self.big else ("I", "H", 4)
        at = struct.unpack(order + long, head[8:16] if self.big else head[4:8])[0]
        n = struct.unpack(order + count, read(at, 8 if self.big else 2))[0]
        size = 20 if self.big else 12
        raw = read(at + (8 if self.big else 2), n * size)
        self.tags = {}
        for k in range(n):
            one = raw[k * size : (k + 1) * size]
            code, field, length = struct.unpack(order + "HH" + long, one[: size - self.inline])
            self.tags[code] = field, length, one[size - self.inline :]
        self._layout()

    def values(self, code: int, default: tuple = (), first: int = 0, count: int | None = None) -> tuple:
        """The values of a tag, or ``count`` of them from ``first`` on: only those are read."""
        if code not in self.tags:
            return default
        field, length, inline = self.tags[code]
        size, letter = FIELD[field]
        count = length - first if count is None else min(count, length - first)
        if size * length <= self.inline:
            data = inline[size * first : size * (first + count)]
        else:
            at = struct.unpack(self.order + ("Q" if self.big else "I"), inline)[0]
            data = self.read(at + size * first, size * count)
        return struct.unpack(f"{self.order}{count}{letter}", data)

    def text(self, code: int) -> str:
        return b"".join(self.values(code)).split(b"\0")[0].decode("latin1").strip()

    def one(self, code: int, default: int) -> int:
        return self.values(code, (default,))[0]

    def _layout(self) -> None:
        self.width, self.height, self.bands = self.one(WIDTH, 0), self.one(HEIGHT, 0), self.one(BANDS, 1)
        bits, kind = set(self.values(BITS, (1,))), set(self.values(SAMPLE_FORMAT, (1,)))
        if len(bits) > 1 or len(kind) > 1 or not kind <= {1, 2, 3} or not bits <= {8, 16, 32, 64}:
            raise ValueError(f"samples of {sorted(bits)} bits of kinds {sorted(kind)} are not supported")
        self.dtype = np.dtype({1: "u", 2: "i", 3: "f"}[kind.pop()] + str(bits.pop() // 8))
        self.apart = self.one(PLANAR, 1) == 2
        self.compression, self.predictor = self.one(COMPRESSION, 1), self.one(PREDICTOR, 1)
        if self.compression not in UNPACK:
            raise ValueError(f"compression {self.compression} is not supported")
        if self.predictor not in (1, 2, 3) or (self.predictor == 3 and self.dtype.kind != "f"):
            raise ValueError(f"predictor {self.predictor} is not supported")
        self.tiled = TILE_AT in self.tags
        if self.tiled:
            self.block_width, self.block_height = self.one(TILE_WIDTH, 0), self.one(TILE_HEIGHT, 0)
        else:
            self.block_width, self.block_height = self.width, min(self.one(STRIP_ROWS, self.height), self.height)
        self.across, self.down = -(-self.width // self.block_width), -(-self.height // self.block_height)

    @property
    def blocks(self) -> int:
        """Blocks of all bands, or of each one where bands lie apart."""
        return self.across * self.down

    def meta(self) -> dict:
        scale, tie, matrix = self.values(SCALE), self.values(TIE), self.values(TRANSFORM)
        if matrix:
            if matrix[1] or matrix[4]:
                raise ValueError("a turned raster is not supported")
            scale, left, top = (matrix[0], -matrix[5]), matrix[3], matrix[7]
        else:
            scale, tie = scale or (1.0, 1.0, 0.0), tie or (0.0,) * 6
            left, top = tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]
        keys = self.values(GEO_KEYS)
        given = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
        if given.get(RASTER_TYPE) == POINT:  # coordinates name the middle of a pixel
            left, top = left - scale[0] / 2, top + scale[1] / 2
        if abs(scale[0] - scale[1]) > 1e-9 * abs(scale[0]):
            raise ValueError("pixels that are not square are not supported")
        crs = given.get(PROJECTED) or given.get(GEOGRAPHIC)
        nodata = self.text(NODATA) if NODATA in self.tags else ""
        return {
            "left": float(left), "top": float(top), "res": float(scale[0]), "width": int(self.width), "height": int(self.height), "bands": int(self.bands),
            "dtype": self.dtype.name, "crs": f"EPSG:{crs}" if crs else None, "nodata": float(nodata) if nodata else None,
            "block_width": int(self.block_width), "block_height": int(self.block_height),
        }

    def _stored(self, k: int) -> np.ndarray:
        """(height, width, samples) of the block that is stored as the k-th."""
        at, n = (self.values(c, first=k, count=1)[0] for c in ((TILE_AT, TILE_SIZE) if self.tiled else (STRIP_AT, STRIP_SIZE)))
        samples = 1 if self.apart else self.bands
        rows = self.block_height if self.tiled else min(self.block_height, self.height - k % self.blocks * self.block_height)
        shape = rows, self.block_width, samples
        if not n:  # a block that was never written
            nodata = self.text(NODATA) if NODATA in self.tags else ""
            return np.full(shape, float(nodata) if nodata else 0, self.dtype)
        data = UNPACK[self.compression](self.read(at, n))
        size = rows * self.block_width * samples * self.dtype.itemsize
        if len(data) < size:
            raise ValueError(f"block {k} holds {len(data)} of {size} bytes")
        if self.predictor == 3:  # differences of bytes, the high bytes of a row first
            x = np.cumsum(np.frombuffer(data, np.uint8, size).reshape(rows, -1), axis=1, dtype=np.uint8) if samples == 1 else self._by_sample(data, size, rows, samples)
            x = x.reshape(rows, self.dtype.itemsize, -1).transpose(0, 2, 1)
            return np.ascontiguousarray(x).view(self.dtype.newbyteorder(">")).reshape(shape).astype(self.dtype)
        x = np.frombuffer(data, self.dtype.newbyteorder(self.order), rows * self.block_width * samples).reshape(shape).astype(self.dtype)
        if self.predictor == 2:  # differences to the left neighbour, as whole numbers
            whole = x.view(f"u{self.dtype.itemsize}")
            x = np.cumsum(whole, axis=1, dtype=whole.dtype).view(self.dtype)
        return x

    @staticmethod
    def _by_sample(data: bytes, size: int, rows: int, samples: int) -> np.ndarray:
        """Each byte is the difference to the one ``samples`` before it."""
        x = np.frombuffer(data, np.uint8, size).reshape(rows, -1, samples)
        return np.cumsum(x, axis=1, dtype=np.uint8).reshape(rows, -1)

    def block(self, k: int) -> np.ndarray:
        """(bands, height, width) of the k-th block, cut at the raster's edges."""
        if self.apart:
            x = np.concatenate([self._stored(b * self.blocks + k) for b in range(self.bands)], axis=2)
        else:
            x = self._stored(k)
        rows = min(self.block_height, self.height - k // self.across * self.block_height)
        columns = min(self.block_width, self.width - k % self.across * self.block_width)
        return x[:rows, :columns].transpose(2, 0, 1)


# ------------------------------------------------------------------- data source

#: Pixels that one partition of a full scan reads, in whole blocks.
PIXELS = 1 << 22
SCHEMA = f"path string, row long, col long, {', '.join(f'{b} int' for b in BANDS_OUT)}"
ARROW = pa.schema([("path", pa.string()), ("row", pa.int64()), ("col", pa.int64()), *((b, pa.int32()) for b in BANDS_OUT)])


@dataclass
class Blocks(InputPartition):
    """Some blocks in a row of one file."""

    path: str
    first: int
    last: int


class TiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.pixels = options["path"], int(options.get("pixels", PIXELS))

    def files(self) -> list[str]:
        store, name = file_system(self.folder)
        found = store.get_file_info(pa.fs.FileSelector(name))
        head = self.folder[: -len(name)] if self.folder.endswith(name) and not self.folder.startswith("/") else ""
        return sorted(plain_path(head + f.path) for f in found if f.is_file and re.search(r"\.tiff?$", f.path, re.I))

    def partitions(self) -> list[Blocks]:
        """Headers alone are read here."""
        out = []
        for path in self.files():
            t = Tiff(opened(path))
            if t.bands < len(BANDS_OUT):
                raise ValueError(f"{path} has {t.bands} bands")
            step = max(1, self.pixels // (t.block_width * t.block_height))
            out += [Blocks(path, k, min(k + step, t.blocks)) for k in range(0, t.blocks, step)]
        return out or [Blocks("", 0, 0)]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.last:
            return
        t = Tiff(opened(partition.path))
        for k in range(partition.first, partition.last):
            x = t.block(k)
            rows, columns = np.indices(x.shape[1:])
            row, col = rows.ravel() + k // t.across * t.block_height, columns.ravel() + k % t.across * t.block_width
            bands = [x[b].ravel().astype(np.int32) for b in range(len(BANDS_OUT))]
            yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(row)), pa.array(row), pa.array(col), *map(pa.array, bands)], schema=ARROW)


class TiffSource(DataSource):
    """``spark.read.format("tideline_tiff").load(folder)``: path, row, col and four bands of
    every pixel; a partition holds about ``pixels`` (an option) in whole blocks."""

    @classmethod
    def name(cls) -> str:
        return "tideline_tiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TiffReader:
        return TiffReader(dict(self.options))
