"""RGB(A) GeoTIFF scenes as tile rows, read by window.

Read are classic and big TIFF of 8 bits a band, in strips or tiles, bands side by side or in planes, uncompressed, LZW,
deflate or PackBits, with or without differencing; JPEG is not. Paths may be URIs that Arrow opens.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geometry as geo
from geoloom.operators import tiles as grid
from geoloom.sources import store

_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d", 16: "Q"}
META = "path string, width_px long, height_px long, bands int, dtype string, transform array<double>, epsg int"
#: Compressions by their number in the file (fixed values).
PLAIN, LZW, DEFLATE, ADOBE_DEFLATE, PACKBITS = 1, 5, 32946, 8, 32773


def unpack_lzw(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant first; 256 clears the table, 257 ends."""
    out, table, width = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9
    last, held, bits = b"", 0, 0
    for byte in raw:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        word = table[code] if code < len(table) else last + last[:1]
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def unpack_bits(raw: bytes) -> bytes:
    """Runs of literal and of repeated bytes."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += raw[at + 1 : at + 2] * (257 - n)
            at += 2
        else:  # says nothing
            at += 1
    return bytes(out)


UNPACK = {PLAIN: lambda raw: raw, LZW: unpack_lzw, DEFLATE: zlib.decompress, ADOBE_DEFLATE: zlib.decompress, PACKBITS: unpack_bits}


class Tiff:
    """First image of a TIFF."""

    def __init__(self, path: str):
        self.file = store.opened(path)
        order = self.file.read(2)
        self.end = "<" if order == b"II" else ">"
        (magic,) = self._read("H")
        if magic not in (42, 43):
            raise ValueError(f"{path} is not a TIFF")
        big = magic == 43
        if big:
            self._read("HH")
        (at,) = self._read("Q" if big else "I")
        self.file.seek(at)
        (n,) = self._read("Q" if big else "H")
        size, room, entry = (20, 8, "HHQ") if big else (12, 4, "HHI")
        self.tags: dict[int, tuple] = {}
        for raw in [self.file.read(size) for _ in range(n)]:
            tag, kind, count = struct.unpack_from(self.end + entry, raw)
            if kind not in _TYPES:
                continue
            form = self.end + (f"{count}s" if kind == 2 else _TYPES[kind] * count)
            data = raw[size - room :]
            if struct.calcsize(form) > room:
                self.file.seek(struct.unpack(self.end + ("Q" if big else "I"), data)[0])
                data = self.file.read(struct.calcsize(form))
            self.tags[tag] = struct.unpack_from(form, data)
        self.width, self.height = self.tags[256][0], self.tags[257][0]
        self.bands = self.tags.get(277, (1,))[0]
        self.planes = self.tags.get(284, (1,))[0] == 2
        self.packing = self.tags.get(259, (1,))[0]
        self.bits = self.tags.get(258, (8,))
        if set(self.bits) != {8} or self.packing not in UNPACK:
            raise ValueError(f"{path}: only 8-bit images without compression or by LZW, deflate or PackBits are read")

    def _read(self, form: str) -> tuple:
        return struct.unpack(self.end + form, self.file.read(struct.calcsize("=" + form)))

    @property
    def transform(self) -> list[float]:
        """x = t0*col + t1*row + t2, y = t3*col + t4*row + t5, from pixel scale and tie point."""
        sx, sy = self.tags.get(33550, (1.0, 1.0, 0.0))[:2]
        i, j, _, x, y, _ = self.tags.get(33922, (0.0,) * 6)[:6]
        return [sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy]

    @property
    def epsg(self) -> int | None:
        """The projected, else the geographic, coordinate system of the geo keys."""
        keys = self.tags.get(34735, ())
        found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        return found.get(3072) or found.get(2048)

    def window(self, col: int, row: int, width: int, height: int) -> np.ndarray:
        """height x width x bands; only the strips or tiles that meet the window are read."""
        tiled = 322 in self.tags
        tw, th = (self.tags[322][0], self.tags[323][0]) if tiled else (self.width, self.tags.get(278, (self.height,))[0])
        offsets, sizes = (self.tags[324], self.tags[325]) if tiled else (self.tags[273], self.tags[279])
        across, down = -(-self.width // tw), -(-self.height // th)
        depth = 1 if self.planes else self.bands
        out = np.zeros((height, width, self.bands), np.uint8)
        for band in range(self.bands if self.planes else 1):
            into = out[..., band : band + 1] if self.planes else out
            for r in range(row // th, -(-(row + height) // th)):
                for c in range(col // tw, -(-(col + width) // tw)):
                    k = (band * down + r) * across + c
                    self.file.seek(offsets[k])
                    rows = th if tiled else min(th, self.height - r * th)
                    block = np.frombuffer(UNPACK[self.packing](self.file.read(sizes[k])), np.uint8)[: rows * tw * depth].reshape(rows, tw, depth)
                    if self.tags.get(317, (1,))[0] == 2:
                        block = np.cumsum(block, axis=1, dtype=np.uint8)
                    y0, y1 = max(row, r * th), min(row + height, r * th + rows)
                    x0, x1 = max(col, c * tw), min(col + width, (c + 1) * tw, self.width)
                    into[y0 - row : y1 - row, x0 - col : x1 - col] = block[y0 - r * th : y1 - r * th, x0 - c * tw : x1 - c * tw]
        return out


def geotiff(pixels: np.ndarray, transform: list[float], epsg: int = 4326, rows_per_strip: int = 256) -> bytes:
    """A deflated TIFF of height x width x bands bytes, with a north-up transform."""
    h, w, n = pixels.shape
    strips = [zlib.compress(pixels[r : r + rows_per_strip].tobytes()) for r in range(0, h, rows_per_strip)]
    geographic = epsg < 10_000
    keys = (1, 1, 0, 2, 1024, 0, 1, 2 if geographic else 1, 2048 if geographic else 3072, 0, 1, epsg)
    entries = [(256, "I", (w,)), (257, "I", (h,)), (258, "H", (8,) * n), (259, "H", (8,)), (262, "H", (2,)), (273, "I", None), (277, "H", (n,)), (278, "I", (rows_per_strip,)), (279, "I", tuple(map(len, strips))), (284, "H", (1,)),
               (33550, "d", (transform[0], -transform[4], 0.0)), (33922, "d", (0.0, 0.0, 0.0, transform[2], transform[5], 0.0)), (34735, "H", keys)]
    kinds = {"H": 3, "I": 4, "d": 12}
    body = 8 + 2 + 12 * len(entries) + 4
    offsets, at = [], body
    for s in strips:
        offsets.append(at)
        at += len(s)
    head, tail = b"II" + struct.pack("<HIH", 42, 8, len(entries)), b""
    for tag, form, values in entries:
        values = tuple(offsets) if values is None else values
        raw = struct.pack(f"<{len(values)}{form}", *values)
        if len(raw) > 4:
            place, tail = at + len(tail), tail + raw
            raw = struct.pack("<I", place)
        head += struct.pack("<HHI", tag, kinds[form], len(values)) + raw.ljust(4, b"\0")
    return head + struct.pack("<I", 0) + b"".join(strips) + tail


def metadata(paths: DataFrame) -> DataFrame:
    """`paths` (path, further columns dropped) to size, bands, dtype, transform, EPSG number, bounds and the UTM zone's EPSG
    number at the centre of geographic scenes; only headers are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            t = []
            for p in pdf["path"]:  # a batch may have more files than a process may hold open
                t.append(Tiff(p))
                t[-1].file.close()
            yield pd.DataFrame({"path": pdf["path"], "width_px": [x.width for x in t], "height_px": [x.height for x in t], "bands": [x.bands for x in t], "dtype": ["uint8" for _ in t], "transform": [x.transform for x in t], "epsg": pd.array([x.epsg for x in t], "Int32")})

    out = paths.select("path").mapInPandas(run, META)
    b = geo.window_bounds(F.lit(0), F.lit(0), F.col("width_px"), F.col("height_px"), [F.col("transform")[i] for i in range(6)])
    out = out.withColumns({c: b[c] for c in ("x0", "y0", "x1", "y1")})
    return out.withColumn("utm_epsg", F.when(F.col("epsg") == 4326, geo.utm_epsg((F.col("x0") + F.col("x1")) / 2)))


def read_tiles(paths: DataFrame, tile: int = 1024, overlap: int = 128) -> DataFrame:
    """One row for each tile: path, tile_idx, offsets, size, rgb (bytes, row by row) and valid (a byte a pixel:
    alpha above 0, or any band above 0 without alpha). Tiles are dealt over tasks before pixels are read."""
    cells = grid.tiles(metadata(paths).select("path", "width_px", "height_px", "transform"), tile, overlap).repartition("path", "tile_idx").sortWithinPartitions("path", "tile_idx")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, scene = None, None  # tiles come by path, and one file is open at a time
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.path != path:
                    if scene:
                        scene.file.close()
                    path, scene = r.path, Tiff(r.path)
                px = scene.window(r.col_off, r.row_off, r.width, r.height)
                rgb = px[..., :3] if px.shape[-1] >= 3 else np.repeat(px[..., :1], 3, -1)
                valid = px[..., 3] > 0 if px.shape[-1] >= 4 else (rgb > 0).any(-1)
                yield pd.DataFrame({"path": [r.path], "tile_idx": [r.tile_idx], "col_off": [r.col_off], "row_off": [r.row_off], "width": [r.width], "height": [r.height], "transform": [r.transform], "rgb": [rgb.tobytes()], "valid": [valid.tobytes()]})

    return cells.mapInPandas(run, "path string, tile_idx long, col_off long, row_off long, width long, height long, transform array<double>, rgb binary, valid binary")


def pixels(tiles: DataFrame) -> DataFrame:
    """Tile rows to pixel rows: prow, pcol, r, g, b, valid."""
    i = F.col("i")
    band = lambda k: F.conv(F.hex(F.substring("rgb", (3 * i + k + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    cells = tiles.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") * F.col("height") - 1)))
    return cells.select("path", "tile_idx", F.floor(i / F.col("width")).alias("prow"), (i % F.col("width")).alias("pcol"), band(0).alias("r"), band(1).alias("g"), band(2).alias("b"), (F.substring("valid", (i + 1).cast("int"), F.lit(1)) == F.lit(b"\x01")).alias("valid"))


def write_scenes(tiles: DataFrame) -> DataFrame:
    """A GeoTIFF for each row (path, width, height, transform, rgb and valid as `read_tiles` gives them), valid as alpha;
    returns path and bytes written. Workers write; the paths must be on storage that all share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = []
            for r in pdf.itertuples(index=False):
                rgb = np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3)
                alpha = (np.frombuffer(r.valid, np.uint8).reshape(r.height, r.width, 1) > 0).astype(np.uint8) * 255
                data = geotiff(np.concatenate((rgb, alpha), -1), list(r.transform))
                with store.created(r.path) as f:
                    f.write(data)
                done.append(len(data))
            yield pd.DataFrame({"path": pdf["path"], "bytes": done})

    return tiles.select("path", "width", "height", "transform", "rgb", "valid").mapInPandas(run, "path string, bytes long")
