"""Shapefiles as a Spark data source: the index plans ranges of records, tasks read theirs from the shapes and the attributes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.sources.sink import write_files

#: The codes of the shapes that are read, in the plane and with heights or measures.
KINDS = {1: "point", 3: "line", 5: "polygon", 11: "point", 13: "line", 15: "polygon", 21: "point", 23: "line", 25: "polygon"}
FIELDS = "feature_id long, geom_type string, parts array<int>, coords array<struct<lon: double, lat: double>>, attributes map<string, string>"
_POINT = pa.struct([("lon", pa.float64()), ("lat", pa.float64())])
_ARROW = pa.schema([("feature_id", pa.int64()), ("geom_type", pa.string()), ("parts", pa.list_(pa.int32())), ("coords", pa.list_(_POINT)), ("attributes", pa.map_(pa.string(), pa.string()))])


def shape(record: bytes) -> tuple[str, list[int], np.ndarray] | None:
    """Kind, where each part starts, and the points of a record's content; None for an empty or unknown shape."""
    (code,) = struct.unpack("<i", record[:4])
    kind = KINDS.get(code)
    if kind == "point":
        return kind, [0], np.frombuffer(record, "<f8", 2, 4).reshape(1, 2)
    if kind is None:
        return None
    n, m = struct.unpack("<ii", record[36:44])
    return kind, list(struct.unpack(f"<{n}i", record[44 : 44 + 4 * n])), np.frombuffer(record, "<f8", 2 * m, 44 + 4 * n).reshape(m, 2)


def columns(head: bytes) -> list[tuple[str, int, int]]:
    """Name, place in a record and width of each attribute, of a table's header."""
    out, at = [], 1
    for k in range(32, struct.unpack("<H", head[8:10])[0] - 32, 32):
        if head[k] == 0x0D:
            break
        out.append((head[k : k + 11].split(b"\0")[0].decode("ascii", "replace"), at, head[k + 16]))
        at += head[k + 16]
    return out


class Records(InputPartition):
    def __init__(self, base: str, start: int, end: int) -> None:
        self.base, self.start, self.end = base, start, end


class ShapeReader(DataSourceReader):
    """Options: path (of the .shp, or of a folder that has some), records (of one partition), encoding (of the attributes)."""

    def __init__(self, options: dict) -> None:
        self.base, self.step, self.encoding = options["path"].removesuffix(".shp"), int(options.get("records", 50_000)), options.get("encoding", "utf-8")

    @staticmethod
    def _open(base: str, kind: str) -> pa.NativeFile | None:
        store, at = fs.FileSystem.from_uri(f"{base}.{kind}")
        return store.open_input_file(at) if store.get_file_info(at).type == fs.FileType.File else None

    def _bases(self) -> list[str]:
        store, at = fs.FileSystem.from_uri(self.base)
        if store.get_file_info(at).type != fs.FileType.Directory:
            return [self.base]
        names = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(at)))
        return [f"{self.base}/{x.removesuffix('.shp')}" for x in names if x.endswith(".shp")]

    def partitions(self) -> list[Records]:
        out = []
        for base in self._bases():
            with self._open(base, "shx") as index:
                n = (index.size() - 100) // 8
            out += [Records(base, i, min(i + self.step, n)) for i in range(0, n, self.step)]
        return out or [Records(self.base, 0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        n, rows = partition.end - partition.start, []
        if not n:
            return
        with self._open(partition.base, "shx") as index, self._open(partition.base, "shp") as shapes:
            index.seek(100 + 8 * partition.start)
            places = np.frombuffer(index.read(8 * n), ">i4").reshape(n, 2).astype(int) * 2  # counted in pairs of bytes
            texts = self._attributes(partition.base, partition.start, n)
            for k, (at, size) in enumerate(places):
                shapes.seek(int(at) + 8)
                if (found := shape(shapes.read(int(size)))) is not None:
                    kind, parts, points = found
                    rows.append({"feature_id": partition.start + k, "geom_type": kind, "parts": parts, "coords": [{"lon": x, "lat": y} for x, y in points.tolist()], "attributes": texts[k]})
                if len(rows) == 1_000:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    def _attributes(self, base: str, start: int, n: int) -> list[list[tuple[str, str]]]:
        table = self._open(base, "dbf")
        if table is None:
            return [[]] * n
        with table:
            head = table.read(32)
            first, width = struct.unpack("<HH", head[8:12])
            names = columns(head + table.read(first - 32))
            table.seek(first + start * width)
            data = table.read(n * width)
        return [[(name, data[k * width + at : k * width + at + size].decode(self.encoding, "replace").strip()) for name, at, size in names] for k in range(n)]


class Shapefile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapes"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema: object) -> ShapeReader:
        return ShapeReader(self.options)


def read_shapefile(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """feature_id, geom_type, parts, coords, attributes of a .shp with its .shx and, if there is one, .dbf. parts: where each part of coords begins."""
    spark.dataSource.register(Shapefile)
    return spark.read.format("shapes").options(**options).load(path)


# --- writing ----------------------------------------------------------------------------------------------------------


def _header(size: int, kind: int, box: list[float]) -> bytes:
    """The first hundred bytes of a .shp or .shx of so many bytes."""
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", 1000, kind, *box, 0, 0, 0, 0)


def shapefile(lines: list[np.ndarray], attributes: dict[str, list[str]]) -> dict[str, bytes]:
    """The bytes of shp, shx and dbf for lines (n x 2 points each) and their attributes, as texts of at most 254 bytes."""
    shp, shx, at = [], [], 100
    low, high = np.full(2, np.inf), np.full(2, -np.inf)
    for k, points in enumerate(lines):
        a, b = points.min(axis=0), points.max(axis=0)
        low, high = np.minimum(low, a), np.maximum(high, b)
        record = struct.pack("<i4d3i", 3, *a, *b, 1, len(points), 0) + points.astype("<f8").tobytes()
        shp.append(struct.pack(">2i", k + 1, len(record) // 2) + record)
        shx.append(struct.pack(">2i", at // 2, len(record) // 2))
        at += len(shp[-1])
    box = [*low, *high] if lines else [0.0] * 4
    texts = {name: [v.encode() for v in values] for name, values in attributes.items()}
    width = {name: max([1, *map(len, values)]) for name, values in texts.items()}
    if too := [n for n, w in width.items() if w > 254 or len(n.encode()) > 10]:
        raise ValueError(f"attributes with names over 10 bytes or values over 254: {too}")
    fields = b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, w in width.items()) + b"\r"
    rows = b"".join(b" " + b"".join(texts[n][k].ljust(w) for n, w in width.items()) for k in range(len(lines)))
    dbf = struct.pack("<4BIHH", 3, 100, 1, 1, len(lines), 32 + len(fields), 1 + sum(width.values())) + b"\0" * 20 + fields + rows + b"\x1a"
    return {"shp": _header(at, 3, box) + b"".join(shp), "shx": _header(100 + 8 * len(shx), 3, box) + b"".join(shx), "dbf": dbf, "prj": WGS84.encode()}


#: Fixed value: how a shapefile names geographic degrees.
WGS84 = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'


def write_shapefiles(points: DataFrame, folder: str, attributes: list[str] | None = None, files: int = 1, name: str = "routes") -> None:
    """points (path_id, seq, lon, lat, attributes...) as lines, one feature for each path, in so many shapefiles of folder, all or none of them. Attributes are those of a path's first point. A path of one point stands twice; a shapefile is built in one task."""
    attributes = attributes or []
    order = F.array_sort(F.collect_list(F.struct("seq", "lon", "lat")))
    first = [F.min_by(F.col(a).cast("string"), "seq").alias(a) for a in attributes]
    lines = points.filter("lon is not null and lat is not null").groupBy("path_id").agg(F.transform(order, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("coords"), *first)
    names = ["path_id", *attributes]
    dealt = lines.withColumn("file", F.pmod(F.xxhash64("path_id"), F.lit(files)))

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("path_id")
        xy = [np.array([(p["lon"], p["lat"]) for p in (line if len(line) > 1 else line * 2)]) for line in rows["coords"].to_pylist()]
        found = shapefile(xy, {n: ["" if v is None else str(v) for v in rows[n].to_pylist()] for n in names})
        base = f"{name}-{rows['file'][0].as_py():05d}"
        return pa.table({"name": [f"{base}.{k}" for k in found], "data": pa.array(list(found.values()), pa.binary())})

    write_files(dealt.groupBy("file").applyInArrow(build, "name string, data binary"), folder)
