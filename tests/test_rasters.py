"""TIFFs of other writers' kinds, made here from the published format, against the arrays they hold."""

import struct
import zlib

import numpy as np
import pytest

from gridloom.operators import vector
from gridloom.sources import rasters


def packed(codes):
    """LZW codes with their widths as bytes, high bits first."""
    bits = "".join(f"{code:0{width}b}" for code, width in codes)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8))


def lzw(data):
    """The writer's side: codes grow a bit when entry 511, 1023 or 2047 has been added, and the table is cleared at 4094."""
    codes, table, width, word = [(256, 9)], {bytes([k]): k for k in range(256)}, 9, b""
    n = 258
    for k in range(len(data)):
        one = data[k : k + 1]
        if word + one in table:
            word += one
            continue
        codes.append((table[word], width))
        table[word + one], word = n, one
        n += 1
        if n - 1 in (511, 1023, 2047):
            width += 1
        if n - 1 == 4094:
            codes.append((256, width))
            table, width, n = {bytes([k]): k for k in range(256)}, 9, 258
    if word:
        codes.append((table[word], width))
        n += 1
        if n - 1 in (511, 1023, 2047):
            width += 1
    return packed([*codes, (257, width)])


def tiff(z, order="<", big=False, packing=5, predictor=1, planes=False, tile=None, keys=(), no_data=None, tie=(0, 0, 0, 500000.0, 2600000.0, 0)):
    """A TIFF of z (bands x rows x columns) in strips of 7 rows, or tiles."""
    bands, height, width = z.shape
    kind = z.dtype.newbyteorder(order)
    across, down = tile or (width, 7)
    blocks = []
    for part in z[:, None] if planes else [z]:
        for r in range(0, height, down):
            for c in range(0, width, across):
                block = np.moveaxis(part[:, r : r + down, c : c + across], 0, 2)
                if tile:
                    block = np.pad(block, ((0, down - block.shape[0]), (0, across - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
                raw = block.astype(kind).tobytes()
                if predictor == 3:
                    rows, each = block.shape[0], block.shape[2]
                    parted = np.frombuffer(block.astype(kind.newbyteorder(">")).tobytes(), "u1").reshape(rows, -1, kind.itemsize).transpose(0, 2, 1).reshape(rows, -1, each)
                    raw = np.diff(parted, axis=1, prepend=np.zeros_like(parted[:, :1])).tobytes()
                blocks.append({1: bytes, 5: lzw, 8: zlib.compress}[packing](raw))
    number = "Q" if big else "I"
    starts = np.cumsum([16, *map(len, blocks)])[:-1].tolist()
    at = 16 + sum(map(len, blocks))
    tags = {
        256: ("H", [width]), 257: ("H", [height]), 258: ("H", [8 * kind.itemsize] * bands), 259: ("H", [packing]), 277: ("H", [bands]), 284: ("H", [1 + planes]), 317: ("H", [predictor]),
        339: ("H", [{"u": 1, "i": 2, "f": 3}[kind.kind]] * bands), 33550: ("d", [90.0, 90.0, 0.0]), 33922: ("d", tie), 34735: ("H", [1, 1, 0, len(keys), *(x for k, v in keys for x in (k, 0, 1, v))]),
    }
    tags |= {322: ("H", [across]), 323: ("H", [down]), 324: (number, starts), 325: (number, list(map(len, blocks)))} if tile else {278: ("H", [down]), 273: (number, starts), 279: (number, list(map(len, blocks)))}
    if no_data is not None:
        tags[42113] = ("c", [bytes([b]) for b in no_data.encode() + b"\0"])
    codes, room = {"c": 2, "H": 3, "I": 4, "d": 12, "Q": 16}, 8 if big else 4
    after = at + (8 + 20 * len(tags) + 8 if big else 2 + 12 * len(tags) + 4)
    entries, more = b"", b""
    for tag, (form, values) in sorted(tags.items()):
        raw = struct.pack(order + form * len(values), *values)
        entries += struct.pack(order + "HH" + number, tag, codes[form], len(values)) + (raw.ljust(room, b"\0") if len(raw) <= room else struct.pack(order + number, after + len(more)))
        more += raw if len(raw) > room else b""
    head = {"<": b"II", ">": b"MM"}[order] + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at) + b"\0" * 8)
    return head + b"".join(blocks) + struct.pack(order + ("Q" if big else "H"), len(tags)) + entries + struct.pack(order + number, 0) + more


def test_lzw():
    assert rasters.lzw(packed([(c, 9) for c in (256, 7, 258, 8, 8, 258, 6, 6, 257)])) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])  # the format's own example
    rng = np.random.default_rng(0)
    for data in (b"", b"\0" * 40_000, rng.integers(0, 256, 30_000, "u1").tobytes(), rng.integers(0, 3, 50_000, "u1").tobytes(), bytes(range(256)) * 40):
        assert rasters.lzw(lzw(data)) == data
    with pytest.raises(ValueError):
        rasters.lzw(packed([(256, 9), (300, 9)]))


@pytest.mark.parametrize(
    ("kind", "options"),
    [
        ("f4", {}), ("f4", {"order": ">", "predictor": 3}), ("i2", {"predictor": 2, "big": True, "tile": (16, 16)}), ("f8", {"predictor": 3, "packing": 8, "tile": (32, 16), "planes": True}),
        ("u1", {"order": ">", "big": True, "planes": True, "predictor": 2}), ("u2", {"packing": 1, "tile": (16, 32)}), ("i4", {"order": ">", "predictor": 2}),
    ],
)
def test_bands_of_many_kinds(spark, tmp_path, kind, options):
    z = np.random.default_rng(1).uniform(0, 250, (3, 33, 41)).astype(kind)
    (tmp_path / "x.tif").write_bytes(tiff(z, **options))
    got = rasters.read_elevation(spark, f"{tmp_path}/x.tif", bands=[3, 1], rows=10).collect()
    assert len(got) == 33 * 41 and list(got[0].asDict()) == ["row", "col", "band_3", "band_1"]
    assert all(x.band_3 == z[2, x.row, x.col] and x.band_1 == z[0, x.row, x.col] for x in got)
    assert all(x.z == z[0, x.row, x.col] for x in rasters.read_elevation(spark, f"{tmp_path}/x.tif").collect())


def test_a_file_names_its_system_and_no_data(spark, tmp_path):
    z = np.arange(20 * 30, dtype="f4").reshape(1, 20, 30)
    (tmp_path / "x.tif").write_bytes(tiff(z, keys=((1024, 1), (1025, 2), (3072, 3826)), no_data="77", tie=(2, 1, 0, 250000.0, 2600000.0, 0)))
    path = f"{tmp_path}/x.tif"
    assert rasters.system_of(path) == "EPSG:3826"
    with open(path, "rb") as file:
        h = rasters.header(file)
    # the tie's place is a cell's middle, two columns and one row inside
    assert (h["west"], h["north"], h["no_data"]) == (250000 - 2.5 * 90, 2600000 + 1.5 * 90, 77)
    cells = {(x.row, x.col): x.z for x in rasters.read_elevation(spark, path).collect()}
    assert cells[2, 17] is None and sum(v is None for v in cells.values()) == 1
    some = rasters.read_elevation(spark, path, west=121.005, south=23.495, east=121.015, north=23.499)
    assert 0 < some.count() < 600 and some.subtract(rasters.read_elevation(spark, path, crs="EPSG:3826", west=121.005, south=23.495, east=121.015, north=23.499)).count() == 0
    (tmp_path / "bad.tif").write_bytes(tiff(z, packing=1).replace(struct.pack("<HHIH", 259, 3, 1, 1), struct.pack("<HHIH", 259, 3, 1, 7)))
    with open(f"{tmp_path}/bad.tif", "rb") as file, pytest.raises(ValueError, match="compression 7"):
        rasters.header(file)


def test_the_lower_envelope_at_any_size():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 64, 65, 300):
        for top in (1, 30, 10**6):
            own = rng.integers(0, top, n)
            x = np.arange(n)
            assert (vector.lower_envelope(own) == (own + (x[:, None] - x) ** 2).min(axis=1)).all()


def test_a_distance_field_goes_through_a_column_once(spark):
    from gridloom.grid import Grid

    g = Grid(spark.range(90).selectExpr("cast(id / 3 as int) as row", "cast(id % 3 as int) as col"), 30, 3)
    found = vector.distance_field(g, g.df.filter("row = 4 and col = 1 or row = 20"), 1000.0)
    # a frame up to a column's end costs its length for each of its rows
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    got = {(r.row, r.col): r.dist for r in found.collect()}
    want = {(r, c): min(900 * ((r - a) ** 2 + (c - b) ** 2) for a, b in [(4, 1), (20, 0), (20, 1), (20, 2)]) ** 0.5 for r in range(30) for c in range(3)}
    assert got == pytest.approx({k: min(v, 1000.0) for k, v in want.items()})
