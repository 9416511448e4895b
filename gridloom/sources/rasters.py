"""Elevation rasters: a GeoTIFF source that plans row ranges (strips or tiles, LZW or deflated, several bands, BigTIFF), GeoTIFF tiles as a sink, and endpoints from JSON."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom import crs as reference
from gridloom.grid import Grid
from gridloom.sources.sink import write_files

_TYPES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 16): "f2", (3, 32): "f4", (3, 64): "f8"}
_PLAIN, _LZW = 1, 5
_FIELDS = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}


def header(file: pa.NativeFile) -> dict:
    """Size, sample type, bands, blocks (strips or tiles), no-data value, reference system (None if not named) and georeference of the first image of a TIFF or BigTIFF, uncompressed, deflated or LZW."""
    head = file.read(16)
    order = {b"II": "<", b"MM": ">"}[head[:2]]
    big = struct.unpack(order + "H", head[2:4])[0] == 43
    number, entry, inline = ("Q", "HHQ8s", 8) if big else ("I", "HHI4s", 4)
    file.seek(struct.unpack_from(order + number, head, 8 if big else 4)[0])
    n = struct.unpack(order + ("Q" if big else "H"), file.read(8 if big else 2))[0]
    entries = [struct.unpack(order + entry, file.read(struct.calcsize(order + entry))) for _ in range(n)]
    tags = {}
    for tag, kind, count, raw in entries:
        if kind not in _FIELDS:
            continue
        form = order + _FIELDS[kind] * count
        need = struct.calcsize(form)
        if need > inline:
            file.seek(struct.unpack(order + number, raw)[0])
            raw = file.read(need)
        tags[tag] = struct.unpack(form, raw[:need])
    packing, predictor, sample = tags.get(259, (_PLAIN,))[0], tags.get(317, (1,))[0], (tags.get(339, (1,))[0], tags.get(258, (1,))[0])
    if packing not in (_PLAIN, _LZW, 8, 32946) or predictor not in (1, 2, 3) or sample not in _TYPES or (predictor == 3 and sample[0] != 3):
        raise ValueError(f"a TIFF with compression {packing}, predictor {predictor} and samples of kind {sample[0]} with {sample[1]} bits is not read")
    scale, tie = tags.get(33550, (1.0, 1.0, 0.0)), tags.get(33922, (0, 0, 0, 0.0, 0.0, 0.0))
    width, height, tiled = tags[256][0], tags[257][0], 322 in tags
    geo = tags.get(34735, (1, 1, 0, 0))
    keys = {geo[k]: geo[k + 3] for k in range(4, len(geo) - 3, 4) if geo[k + 1] == 0}
    code = keys.get(3072 if keys.get(1024) == 1 else 2048, 0)
    # a value that stands for the point at a cell's middle, not for its area
    middle = 0.5 if keys.get(1025) == 2 else 0.0
    return {
        "width": width, "height": height, "type": order + _TYPES[sample], "packing": packing, "predictor": predictor,
        "bands": tags.get(277, (1,))[0], "planes": tags.get(284, (1,))[0] == 2, "no_data": _number(b"".join(tags.get(42113, ()))), "crs": f"EPSG:{code}" if 1024 <= code < 32767 else None,
        "offsets": tags[324 if tiled else 273], "counts": tags.get(325 if tiled else 279), "across": tags[322][0] if tiled else width, "down": tags[323][0] if tiled else min(height, tags.get(278, (height,))[0]), "tiled": tiled,
        "west": tie[3] - (tie[0] + middle) * scale[0], "north": tie[4] + (tie[1] + middle) * scale[1], "dx": scale[0], "dy": scale[1],
    }


def _number(text: bytes) -> float | None:
    try:
        return float(text.rstrip(b"\0 "))
    except ValueError:
        return None


def lzw(data: bytes) -> bytes:
    """Unpacks TIFF's LZW: codes of 9 to 12 bits, high bits first, a bit longer from one entry before the table is full."""
    words = [bytes([k]) for k in range(256)] + [b"", b""]
    out: list[bytes] = []
    held = bits = 0
    width, last = 9, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 256:
            del words[258:]
            width, last = 9, b""
            continue
        if code == 257:
            break
        if code > len(words) or (code == len(words) and not last):
            raise ValueError("damaged LZW data")
        word = words[code] if code < len(words) else last + last[:1]
        if last:
            words.append(last + word[:1])
        out.append(word)
        last = word
        if len(words) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def block_at(file: pa.NativeFile, h: dict, down: int, across: int, band: int = 0) -> np.ndarray:
    """A band of a strip or tile by its place among the blocks, as rows of samples."""
    kind, k = np.dtype(h["type"]), down * -(-h["width"] // h["across"]) + across
    if h["planes"]:
        k += band * -(-h["width"] // h["across"]) * -(-h["height"] // h["down"])
    rows = h["down"] if h["tiled"] else min(h["down"], h["height"] - down * h["down"])
    each = 1 if h["planes"] else h["bands"]
    size = rows * h["across"] * each
    file.seek(h["offsets"][k])
    data = file.read(h["counts"][k] if h["counts"] else size * kind.itemsize)
    if h["packing"] != _PLAIN:
        data = lzw(data) if h["packing"] == _LZW else zlib.decompress(data)
    if h["predictor"] == 3:
        # differences of bytes, those of a row's samples parted by significance, the highest first
        parted = np.cumsum(np.frombuffer(data, "u1", size * kind.itemsize).reshape(rows, -1, each), axis=1, dtype="u1").reshape(rows, kind.itemsize, -1)
        out = np.ascontiguousarray(parted.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, h["across"], each)
    else:
        out = np.frombuffer(data, kind, size).reshape(rows, h["across"], each)
        if h["predictor"] == 2:
            out = np.cumsum(out, axis=1, dtype=kind)
    return out[:, :, 0 if h["planes"] else band]


class Rows(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


class GeoTiffReader(DataSourceReader):
    """Options: path; west, south, east, north (only the window is read); rows (of one partition); bands (numbers from 1 with commas, each a column)."""

    def __init__(self, options: dict) -> None:
        self.store, self.path = fs.FileSystem.from_uri(options["path"])
        self.uri, self.step = options["path"], int(options.get("rows", 512))
        with self.store.open_input_file(self.path) as file:
            self.h = h = header(file)
        self.bands_option = options.get("bands")
        self.bands = [k - 1 for k in _bands(self.bands_option)]
        if not all(0 <= k < h["bands"] for k in self.bands):
            raise ValueError(f"{self.path} has {h['bands']} bands")
        inf = float("inf")
        west, south, east, north = (float(options.get(k, d)) for k, d in (("west", -inf), ("south", -inf), ("east", inf), ("north", inf)))
        clamp = lambda x, n: int(min(max(x + 1e-9, 0), n))
        self.r0, self.r1 = clamp((h["north"] - north) / h["dy"], h["height"]), clamp(np.ceil((h["north"] - south) / h["dy"] - 1e-9) if np.isfinite(south) else inf, h["height"])
        self.c0, self.c1 = clamp((west - h["west"]) / h["dx"], h["width"]), clamp(np.ceil((east - h["west"]) / h["dx"] - 1e-9) if np.isfinite(east) else inf, h["width"])
        del self.store

    def partitions(self) -> list[Rows]:
        return [Rows(i, min(i + self.step, self.r1)) for i in range(self.r0, self.r1, self.step)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(self.uri)
        h, down = self.h, self.h["down"]
        if self.c0 >= self.c1:
            return
        with store.open_input_file(path) as file:
            for k in range(partition.start // down, -(-partition.end // down)):
                first = self.c0 // h["across"] * h["across"]
                across = range(self.c0 // h["across"], -(-self.c1 // h["across"]))
                wide = [np.hstack([block_at(file, h, k, j, band) for j in across])[:, self.c0 - first : self.c1 - first] for band in self.bands]
                n = self.c1 - self.c0
                for row in range(max(partition.start, k * down), min(partition.end, (k + 1) * down)):
                    values = [band[row - k * down].astype(float) for band in wide]
                    columns = [pa.array(z, mask=~np.isfinite(z) | (z <= -9999) | (z > 9000) | (z == h["no_data"])) for z in values]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row - self.r0, np.int32)), pa.array(np.arange(n, dtype=np.int32)), *columns], ["row", "col", *_layers(self.bands_option)])


def _bands(option: str | None) -> list[int]:
    return [int(k) for k in option.split(",")] if option else [1]


def _layers(option: str | None) -> list[str]:
    return [f"band_{k}" for k in _bands(option)] if option else ["z"]


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "row int, col int, " + ", ".join(f"{c} double" for c in _layers(self.options.get("bands")))

    def reader(self, schema: object) -> GeoTiffReader:
        return GeoTiffReader(self.options)


def read_elevation(spark: SparkSession, path: str, crs: str | reference.System | None = None, bands: list[int] | None = None, **window: float) -> DataFrame:
    """row, col, z of the window, or band_k for each of bands (numbers from 1); no-data (the file's own value, at most -9999, over 9000, not finite) is null. crs: the file's reference system, into which a window of degrees (west, south, east, north) is turned; the one that the file names, or else degrees, if not given."""
    spark.dataSource.register(GeoTiff)
    sides = ("west", "south", "east", "north")
    if all(k in window for k in sides):
        window |= reference.bounds(crs or system_of(path) or "EPSG:4326", *(window[k] for k in sides))
    named = {"bands": ",".join(map(str, bands))} if bands else {}
    return spark.read.format("geotiff").options(**window, **named).load(path)


def system_of(path: str) -> str | None:
    """The reference system that a GeoTIFF names, like EPSG:4326."""
    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_file(inner) as file:
        return header(file)["crs"]


def write_raster(df: DataFrame, path: str, tile: int = 1024) -> None:
    """Parquet by tile, so that windows prune."""
    df.withColumn("tile_row", (F.col("row") / tile).cast("int")).withColumn("tile_col", (F.col("col") / tile).cast("int")).write.mode("overwrite").partitionBy("tile_row", "tile_col").parquet(path)


def read_raster(spark: SparkSession, path: str, rows: tuple[int, int], cols: tuple[int, int], tile: int = 1024) -> DataFrame:
    """The cells of write_raster()'s tables within rows and columns (first, and after the last): only the folders of tiles that the window touches are read."""
    within = lambda c, at: F.col(c).between(at[0], at[1] - 1)
    of = lambda c, at: F.col(c).between(at[0] // tile, (at[1] - 1) // tile)
    return spark.read.parquet(path).filter(of("tile_row", rows) & of("tile_col", cols) & within("row", rows) & within("col", cols)).drop("tile_row", "tile_col")


NO_DATA = -9999.0


def tiff(z: np.ndarray, west: float, north: float, step: float) -> bytes:
    """A deflated GeoTIFF of 32-bit samples in one strip; NaN becomes NO_DATA, which a tag names."""
    data = zlib.compress(np.where(np.isfinite(z), z, NO_DATA).astype("<f4").tobytes(), 6)
    no_data = f"{NO_DATA:g}".encode() + b"\0"
    values = {
        256: ("I", (z.shape[1],)), 257: ("I", (z.shape[0],)), 258: ("H", (32,)), 259: ("H", (8,)), 262: ("H", (1,)), 273: ("I", (0,)), 277: ("H", (1,)), 278: ("I", (z.shape[0],)),
        279: ("I", (len(data),)), 339: ("H", (3,)), 33550: ("d", (step, step, 0.0)), 33922: ("d", (0.0, 0.0, 0.0, west, north, 0.0)), 34735: ("H", (1, 1, 0, 2, 1024, 0, 1, 2, 2048, 0, 1, 4326)), 42113: ("c", no_data),
    }
    codes, at = {"c": 2, "H": 3, "I": 4, "d": 12}, 8 + 2 + 12 * len(values) + 4
    entries, more = b"", b""
    ends = at + sum(struct.calcsize("<" + f * len(v)) for f, v in values.values() if struct.calcsize("<" + f * len(v)) > 4)
    values[273] = ("I", (ends,))
    for tag, (form, value) in values.items():
        raw = value if form == "c" else struct.pack("<" + form * len(value), *value)
        place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", at + len(more))
        entries += struct.pack("<HHI", tag, codes[form], len(value)) + place
        more += raw if len(raw) > 4 else b""
    return b"II*\0" + struct.pack("<IH", 8, len(values)) + entries + b"\0\0\0\0" + more + data


def write_geotiff(grid: Grid, layer: str, folder: str, tile: int = 1024) -> None:
    """A GeoTIFF of the layer for each tile of the grid, null as NO_DATA, all or none of them. A tile is one task's group."""
    west, north, step = grid.west, grid.north, grid.step

    def image(cells: pa.Table) -> pa.Table:
        row, col, z = (cells[c].to_numpy() for c in ("row", "col", layer))
        r0, c0 = int(row.min()) // tile * tile, int(col.min()) // tile * tile
        found = np.full((int(row.max()) - r0 + 1, int(col.max()) - c0 + 1), np.nan)
        found[row - r0, col - c0] = z
        return pa.table({"name": [f"{layer}_{r0:07d}_{c0:07d}.tif"], "data": pa.array([tiff(found, west + c0 * step, north - r0 * step, step)], pa.binary())})

    of = lambda c: F.floor(F.col(c) / tile)
    write_files(grid.df.select("row", "col", F.col(layer).cast("double").alias(layer), of("row").alias("tr"), of("col").alias("tc")).groupBy("tr", "tc").applyInArrow(image, "name string, data binary"), folder)


def read_endpoints(spark: SparkSession, path: str, default: dict[str, float]) -> DataFrame:
    """start_lat, start_lon, end_lat, end_lon of a JSON file; an absent field has its default."""
    rows = spark.read.schema("start_lat double, start_lon double, end_lat double, end_lon double").option("multiLine", "true").json(path)
    return rows.select(*(F.coalesce(c, F.lit(default[c])).alias(c) for c in rows.columns))
