"""Every layout of a TIFF gives the pixels that were written, by reading no more than asked."""

import itertools
import struct
import zlib

import numpy as np
import pytest

from tideline.operators import geometry as G
from tideline.sources import readers, tiff
from tideline.sources.tiff import Tiff, TiffReader, held


def lzw_encoded(data):
    """Codes as TIFF wants them; the table is cleared when full."""
    out, bits, have = bytearray(), 0, 0

    def put(code):
        nonlocal bits, have
        bits, have = bits << width | code, have + width
        while have >= 8:
            out.append(bits >> have - 8)
            have -= 8
            bits &= (1 << have) - 1

    table, width = {bytes([k]): k for k in range(256)}, 9
    put(256)
    held_bytes, n = b"", 258
    for k in range(len(data)):
        more = held_bytes + data[k : k + 1]
        if more in table:
            held_bytes = more
            continue
        put(table[held_bytes])
        table[more], n = n, n + 1
        if n == 4094:
            put(256)
            table, n, width = {bytes([k]): k for k in range(256)}, 258, 9
        elif n == 1 << width:
            width += 1
        held_bytes = data[k : k + 1]
    if held_bytes:
        put(table[held_bytes])
    n += 1
    if n >= 1 << width and width < 12:
        width += 1
    put(257)
    if have:
        out.append(bits << 8 - have & 0xFF)
    return bytes(out)


def packbits_encoded(data):
    out = b""
    for k in range(0, len(data), 100):
        part = data[k : k + 100]
        out += bytes([257 - len(part)]) + part[:1] if len(set(part)) == 1 and len(part) > 1 else bytes([len(part) - 1]) + part
    return out


PACK = {1: lambda b: b, 5: lzw_encoded, 8: zlib.compress, 32773: packbits_encoded}


def written(pixels, order="<", big=False, tile=None, strip=3, compression=1, predictor=1, apart=False, epsg=32629, nodata=None, left=0.0, top=0.0, res=1.0, point=False):
    """The bytes of a TIFF of (bands, height, width)."""
    bands, height, width = pixels.shape
    kind = pixels.dtype
    bw, bh = tile or (width, strip)
    blocks = []
    for part in [pixels[b : b + 1] for b in range(bands)] if apart else [pixels]:
        for r, c in itertools.product(range(0, height, bh), range(0, width, bw)):
            x = part[:, r : r + bh, c : c + bw].transpose(1, 2, 0)
            if tile:
                x = np.pad(x, ((0, bh - x.shape[0]), (0, bw - x.shape[1]), (0, 0)))
            if predictor == 2:
                whole = np.ascontiguousarray(x).view(f"u{kind.itemsize}")
                x = np.diff(whole, axis=1, prepend=np.zeros_like(whole[:, :1])).astype(whole.dtype).view(kind)
            if predictor == 3:
                flat = np.ascontiguousarray(x.astype(kind.newbyteorder(">"))).view(np.uint8).reshape(x.shape[0], -1, kind.itemsize)
                flat = np.ascontiguousarray(flat.transpose(0, 2, 1)).reshape(x.shape[0], -1, x.shape[2])
                raw = np.diff(flat, axis=1, prepend=np.zeros_like(flat[:, :1])).astype(np.uint8).tobytes()
            else:
                raw = np.ascontiguousarray(x).astype(kind.newbyteorder(order)).tobytes()
            blocks.append(PACK[compression](raw))
    head = 16 if big else 8
    at = np.cumsum([head] + [len(b) for b in blocks]).tolist()
    keys = (1, 1, 0, 2, 3072, 0, 1, epsg, 1025, 0, 1, 2 if point else 1)
    long = ("Q", 16) if big else ("I", 4)
    tags = [
        (256, "I", 4, [width]), (257, "I", 4, [height]), (258, "H", 3, [kind.itemsize * 8] * bands), (259, "H", 3, [compression]), (277, "H", 3, [bands]),
        (284, "H", 3, [2 if apart else 1]), (317, "H", 3, [predictor]), (339, "H", 3, [{"u": 1, "i": 2, "f": 3}[kind.kind]] * bands),
        (33550, "d", 12, [res, res, 0.0]), (33922, "d", 12, [0.0, 0.0, 0.0, left, top, 0.0]), (34735, "H", 3, list(keys)),
    ]
    tags += [(322, "I", 4, [bw]), (323, "I", 4, [bh]), (324, *long, at[:-1]), (325, *long, [len(b) for b in blocks])] if tile else [(278, "I", 4, [bh]), (273, *long, at[:-1]), (279, *long, [len(b) for b in blocks])]
    if nodata is not None:
        tags.append((42113, "s", 2, [f"{nodata}\0".encode()]))
    off, count, room, size = ("Q", "Q", 8, 20) if big else ("I", "H", 4, 12)
    where = at[-1]
    entries, extra = b"", b""
    for code, letter, field, values in sorted(tags):
        data = values[0] if letter == "s" else struct.pack(f"{order}{len(values)}{letter}", *values)
        n = len(data) if letter == "s" else len(values)
        entries += struct.pack(f"{order}HH{off}", code, field, n)
        if len(data) <= room:
            entries += data.ljust(room, b"\0")
        else:
            entries += struct.pack(order + off, where + (8 if big else 2) + len(tags) * size + room + len(extra))
            extra += data
    ifd = struct.pack(order + count, len(tags)) + entries + b"\0" * room + extra
    start = {"<": b"II", ">": b"MM"}[order] + (struct.pack(order + "HHHQ", 43, 8, 0, where) if big else struct.pack(order + "HI", 42, where))
    return start + b"".join(blocks) + ifd


def pixels(kind, bands=4, height=37, width=41, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 200, (bands, height, width)) + np.arange(width) * 3
    return (x * 1.37 if np.dtype(kind).kind == "f" else x).astype(kind)


def image(raw):
    t = Tiff(held(raw))
    out = np.zeros((t.bands, t.height, t.width), t.dtype)
    for k in range(t.blocks):
        x = t.block(k)
        r, c = k // t.across * t.block_height, k % t.across * t.block_width
        out[:, r : r + x.shape[1], c : c + x.shape[2]] = x
    return out


LAYOUTS = [dict(order=o, big=b, tile=t, apart=a) for o in "<>" for b in (False, True) for t in (None, (16, 16), (48, 32)) for a in (False, True)]


@pytest.mark.parametrize("layout", LAYOUTS, ids=str)
def test_layouts(layout):
    x = pixels("u2")
    for compression in PACK:
        for predictor in (1, 2):
            assert (image(written(x, compression=compression, predictor=predictor, **layout)) == x).all()


@pytest.mark.parametrize("kind", ["u1", "i2", "u4", "f4", "f8"])
@pytest.mark.parametrize("predictor", [1, 2, 3])
def test_kinds_and_predictors(kind, predictor):
    x = pixels(kind)
    if predictor == 3 and x.dtype.kind != "f":
        with pytest.raises(ValueError, match="predictor 3"):
            Tiff(held(written(x.astype("u1"), predictor=3)))
        return
    for layout in LAYOUTS[::3]:
        assert (image(written(x, compression=5, predictor=predictor, **layout)) == x).all()


def test_lzw_clears_its_table():
    rng = np.random.default_rng(5)
    for data in (b"", b"a", b"a" * 70_000, rng.integers(0, 256, 60_000).astype(np.uint8).tobytes(), rng.integers(0, 3, 60_000).astype(np.uint8).tobytes()):
        assert tiff.lzw(lzw_encoded(data)) == data


def test_what_cannot_be_read_is_said():
    good = written(pixels("u2"), compression=8)
    for raw in (b"", b"II*\0" + b"\0" * 4, b"PNG" + good[3:]):
        with pytest.raises((ValueError, struct.error)):
            Tiff(held(raw))
    t = Tiff(held(good[:20] + b"\0" * 60 + good[80:]))
    with pytest.raises(zlib.error):
        t.block(0)


def test_place_of_a_raster():
    x = pixels("u2")
    at = Tiff(held(written(x, left=500.0, top=900.0, res=2.0, nodata=-1))).meta()
    assert (at["left"], at["top"], at["res"], at["nodata"], at["crs"]) == (500.0, 900.0, 2.0, -1.0, "EPSG:32629")
    middle = Tiff(held(written(x, left=500.0, top=900.0, res=2.0, point=True))).meta()
    assert (middle["left"], middle["top"]) == (499.0, 901.0)


class Counted:
    def __init__(self, raw):
        self.raw, self.bytes = raw, 0

    def __call__(self, at, n):
        self.bytes += n
        return self.raw[at : at + n]


@pytest.mark.parametrize("big", [False, True])
def test_only_what_is_asked_for_is_read(big):
    """The header of a large raster is a few hundred bytes, a pixel one block more."""
    raw = written(pixels("u2", height=700, width=900), tile=(64, 64), big=big)
    source = Counted(raw)
    t = Tiff(source)
    t.meta()
    assert source.bytes < 1200 and len(raw) > 5_000_000
    before = source.bytes
    t.block(77)
    assert source.bytes - before <= 64 * 64 * 8 + 16
    assert t.values(tiff.TILE_AT, first=77, count=1)[0] > 0


def test_data_source_and_samples(spark, tmp_path, monkeypatch):
    a, b = pixels("u2", seed=1), pixels("u2", seed=2)
    (tmp_path / "a.tif").write_bytes(written(a, tile=(16, 16), compression=5, predictor=2, big=True, top=37.0, nodata=0))
    (tmp_path / "b.TIFF").write_bytes(written(b, order=">", compression=8, left=41.0, top=37.0, nodata=0))
    (tmp_path / "notes.txt").write_text("no raster")
    meta = readers.check_rasters(readers.raster_meta(spark, str(tmp_path)))
    assert [(r["raster_id"], r["block_width"], r["block_height"]) for r in meta.orderBy("raster_id").collect()] == [(0, 16, 16), (1, 41, 3)]
    got = readers.raster_pixels(spark, str(tmp_path), meta)
    assert got.count() == 2 * 37 * 41
    for rid, x in ((0, a), (1, b)):
        rows = {(r["row"], r["col"]): [r[c] for c in tiff.BANDS_OUT] for r in got.where(f"raster_id = {rid}").collect()}
        assert all(rows[r, c] == x[:, r, c].tolist() for r, c in itertools.product(range(37), range(41)))
    wanted = got.where("(row * 41 + col) % 11 = 0").select("raster_id", "row", "col")
    few = readers.pixels_of(spark, str(tmp_path), meta)(wanted)
    assert few.where("problem is not null").count() == 0
    assert sorted(tuple(r) for r in few.drop("problem").collect()) == sorted(tuple(r) for r in got.where("(row * 41 + col) % 11 = 0").collect())
    monkeypatch.setattr(readers, "by_ranges", lambda p: False)  # a store that Python can't read in part
    meta = readers.raster_meta(spark, str(tmp_path))
    again = readers.pixels_of(spark, str(tmp_path), meta)(wanted)
    assert sorted(tuple(r) for r in again.collect()) == sorted(tuple(r) for r in few.collect())


def test_partitions_are_ranges_of_blocks(tmp_path, monkeypatch):
    (tmp_path / "a.tif").write_bytes(written(pixels("u2", height=64, width=64), tile=(16, 16)))
    read = []
    monkeypatch.setattr(tiff, "opened", lambda path: read.append(path) or Counted(open(path, "rb").read()))
    reader = TiffReader({"path": str(tmp_path), "pixels": 16 * 16 * 3})
    parts = reader.partitions()
    assert [(p.first, p.last) for p in parts] == [(0, 3), (3, 6), (6, 9), (9, 12), (12, 15), (15, 16)]
    assert sum(batch.num_rows for p in parts for batch in reader.read(p)) == 64 * 64
    assert [b for p in TiffReader({"path": str(tmp_path / "..")}).partitions() for b in reader.read(p)] == []


def test_an_unreadable_block_costs_its_pixels_alone(spark, tmp_path):
    x = pixels("u2")
    raw = bytearray(written(x, compression=8))
    raw[8:30] = b"\0" * 22
    (tmp_path / "a.tif").write_bytes(bytes(raw))
    (tmp_path / "b.tif").write_bytes(b"II no raster")
    index = readers.raster_index(spark, str(tmp_path))
    assert {r["path"][-5:]: r["problem"] is None for r in index.collect()} == {"a.tif": True, "b.tif": False}
    with pytest.raises(Exception, match="b.tif"):
        readers.raster_meta(spark, str(tmp_path)).collect()
    meta = index.where("problem is null")
    wanted = spark.range(37).selectExpr("0 raster_id", "id row", "5 col")
    got = {r["row"]: r for r in readers.pixels_of(spark, str(tmp_path), meta)(wanted).collect()}
    assert all(got[r]["problem"] is not None and got[r]["red"] is None for r in range(3))
    assert all(got[r]["red"] == x[0, r, 5] for r in range(3, 37))
