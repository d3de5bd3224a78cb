"""GeoTIFF as a Spark data source, read and written with numpy and zlib.

``spark.dataSource.register(GeoTiffSource)`` once; then ``spark.read.format("geotiff").load(path)`` gives (x, y, v), or
(x, y, bands ARRAY<DOUBLE>) with option ``bands=all``; NoData is NULL. One input partition per group of strips or tiles,
so a large raster is read by many tasks. ``write_geotiff(df, path, grid)`` writes a folder of horizontal strips of whole
rows, one or K bands, which reads back as one raster. Classic TIFF, strips or tiles, no compression or deflate, predictors 1 and 2.
"""

from __future__ import annotations

import dataclasses
import json
import os
import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..grid import Grid, GridError

#: TIFF tags and field sizes.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_W, TILE_H, TILES, TILE_BYTES, FORMAT, SCALE, TIE, MATRIX, KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42113
_SIZES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
_DTYPES = {("u", 8): "Byte", ("u", 16): "UInt16", ("u", 32): "UInt32", ("i", 16): "Int16", ("i", 32): "Int32", ("f", 32): "Float32", ("f", 64): "Float64"}
NUMPY = {"Byte": "u1", "UInt16": "u2", "UInt32": "u4", "Int16": "i2", "Int32": "i4", "Float32": "f4", "Float64": "f8"}


@dataclass
class Header:
    order: str
    tags: dict[int, tuple]
    grid: Grid

    def get(self, tag: int, default=None):
        return self.tags.get(tag, default)

    @property
    def tiled(self) -> bool:
        return TILES in self.tags


def parse_header(read) -> Header:
    """``read(offset, size)`` -> bytes."""
    start = read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    if order is None or struct.unpack(order + "H", start[2:4])[0] != 42:
        raise GridError("not a classic TIFF")
    at = struct.unpack(order + "I", start[4:8])[0]
    n = struct.unpack(order + "H", read(at, 2))[0]
    table = read(at + 2, 12 * n)
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack(order + "HHI", table[12 * k : 12 * k + 8])
        code = _SIZES.get(kind)
        if code is None:
            continue
        size = struct.calcsize("=" + code) * count
        raw = table[12 * k + 8 : 12 * k + 8 + size] if size <= 4 else read(struct.unpack(order + "I", table[12 * k + 8 : 12 * k + 12])[0], size)
        tags[tag] = (raw,) if kind == 2 else struct.unpack(order + code[0] * (count * len(code)), raw)
    bits, fmt = tags.get(BITS, (8,))[0], tags.get(FORMAT, (1,))[0]
    dtype = _DTYPES.get(({1: "u", 2: "i", 3: "f"}.get(fmt, "?"), bits))
    if dtype is None:
        raise GridError(f"unsupported samples of {bits} bits, format {fmt}")
    t = (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)
    if SCALE in tags and TIE in tags:
        sx, sy, tie = tags[SCALE][0], tags[SCALE][1], tags[TIE]
        t = (tie[3] - tie[0] * sx, sx, 0.0, tie[4] + tie[1] * sy, 0.0, -sy)
    elif MATRIX in tags:
        m = tags[MATRIX]
        t = (m[3], m[0], m[1], m[7], m[4], m[5])
    keys = tags.get(KEYS, ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4)}
    epsg = codes.get(3072) or codes.get(2048)
    nodata = None
    if NODATA in tags:
        try:
            nodata = float(tags[NODATA][0].split(b"\0")[0])
        except ValueError:
            nodata = None
    grid = Grid(tags[WIDTH][0], tags[HEIGHT][0], t, f"EPSG:{epsg}" if epsg else "", nodata, dtype, tags.get(SAMPLES, (1,))[0])
    return Header(order, tags, grid)


def _opened(path: str):
    f = open(path.removeprefix("file://").removeprefix("file:"), "rb")

    def read(at, size):
        f.seek(at)
        return f.read(size)

    return f, read


def header_of(path: str) -> Header:
    f, read = _opened(path)
    with f:
        return parse_header(read)


def _block(h: Header, read, k: int) -> tuple[int, int, np.ndarray]:
    """(x, y, rows x columns x samples) of the k-th strip or tile."""
    g = h.grid
    offsets, sizes = (h.get(TILES), h.get(TILE_BYTES)) if h.tiled else (h.get(STRIPS), h.get(STRIP_BYTES))
    planar = h.get(PLANAR, (1,))[0] == 2 and g.bands > 1
    if planar:
        raise GridError("separate planes are read by band")
    raw = read(offsets[k], sizes[k])
    kind = h.get(COMPRESSION, (1,))[0]
    if kind in (8, 32946):
        raw = zlib.decompress(raw)
    elif kind != 1:
        raise GridError(f"unsupported compression {kind}")
    if h.tiled:
        w, rows = h.get(TILE_W)[0], h.get(TILE_H)[0]
        across = -(-g.width // w)
        x, y = k % across * w, k // across * rows
    else:
        w, rows = g.width, h.get(ROWS, (g.height,))[0]
        x, y = 0, k * rows
        rows = min(rows, g.height - y)
    a = np.frombuffer(raw, h.order + NUMPY[g.dtype], rows * w * g.bands).reshape(rows, w, g.bands)
    if h.get(PREDICTOR, (1,))[0] == 2:
        a = np.cumsum(a, axis=1, dtype=a.dtype)
    return x, y, a[: g.height - y, : g.width - x]


@dataclass
class _Blocks(InputPartition):
    path: str
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, every: bool, per_task: int):
        self.path, self.every, self.per_task = path, every, per_task

    def partitions(self):
        out = []
        for p in _files(self.path):
            n = len((lambda h: h.get(TILES) if h.tiled else h.get(STRIPS))(header_of(p)))
            out += [_Blocks(p, k, min(k + self.per_task, n)) for k in range(0, n, self.per_task)]
        return out

    def read(self, partition):
        import pyarrow as pa

        f, read = _opened(partition.path)
        with f:
            h = parse_header(read)
            g = h.grid
            for k in range(partition.first, partition.last):
                x, y, a = _block(h, read, k)
                y += first_row(partition.path)
                ys, xs = np.mgrid[y : y + a.shape[0], x : x + a.shape[1]]
                values = a.reshape(-1, g.bands)
                bad = np.zeros(values.shape, bool)
                if g.nodata is not None:
                    bad = values == np.array(g.nodata).astype(values.dtype) if g.dtype[:5] != "Float" else np.abs(values - g.nodata) < 1e-10
                columns = [pa.array(xs.ravel().astype("i4")), pa.array(ys.ravel().astype("i4"))]
                if self.every:
                    flat = pa.array(values.ravel().astype("f8"), mask=bad.ravel())
                    columns.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, g.bands, dtype="i4")), flat))
                else:
                    columns.append(pa.array(values[:, 0].astype("f8"), mask=bad[:, 0]))
                yield pa.RecordBatch.from_arrays(columns, ["x", "y", "bands" if self.every else "v"])


def _files(path: str) -> list[str]:
    local = path.removeprefix("file://").removeprefix("file:")
    if os.path.isdir(local):
        return sorted(os.path.join(local, f) for f in os.listdir(local) if f.lower().endswith((".tif", ".tiff")))
    return [local]


#: Name of a strip of a raster folder, with its first row; cells of about so many stand in one strip.
_STRIP = "strip-{:09d}.tif"
STRIP_CELLS = 1 << 22


def first_row(path: str) -> int:
    name = os.path.basename(path)
    return int(name[6:15]) if name.startswith("strip-") else 0


def strip_rows(grid: Grid) -> int:
    return max(1, min(grid.height, STRIP_CELLS // max(1, grid.width * grid.bands)))


def write_geotiff(df: DataFrame, path: str, grid: Grid) -> None:
    """Write cells (x, y, v), or (x, y, bands) with an array of K values, as a folder of strips of one raster.

    Cells are dealt by strip first, whatever their order: every strip is written whole by one task, in one file with its own
    place in the name, and reads back at its own rows. Cells that the frame lacks are NoData. The grid goes beside the strips.
    """
    df.sparkSession.dataSource.register(GeoTiffSource)
    rows = strip_rows(grid)
    strip = F.floor(F.col("y") / rows)
    values = F.col("bands").cast("array<double>").alias("bands") if "bands" in df.columns else F.col("v").cast("double").alias("v")
    dealt = df.select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), values)
    dealt = dealt.repartition(max(1, -(-grid.height // rows)), strip).sortWithinPartitions(strip)
    options = {"width": grid.width, "height": grid.height, "transform": ",".join(map(repr, grid.transform)), "crs": grid.crs, "dtype": grid.dtype, "bands": grid.bands}
    if grid.nodata is not None:
        options["nodata"] = grid.nodata
    dealt.write.format("geotiff").options(**options).mode("overwrite").save(path)


@dataclass
class _Done(WriterCommitMessage):
    paths: list  # (final, temporary)


class _Writer(DataSourceArrowWriter):
    """Strips of one raster. A strip that two tasks hold cells of is refused at commit: ``write_geotiff`` deals cells so."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].removeprefix("file://").removeprefix("file:")
        self.grid = Grid(
            int(options["width"]),
            int(options["height"]),
            tuple(float(x) for x in options.get("transform", "0,1,0,0,0,-1").split(",")),
            options.get("crs", ""),
            float(options["nodata"]) if "nodata" in options else None,
            options.get("dtype", "Byte"),
            int(options.get("bands", 1)),
        )
        self.overwrite = overwrite

    def _strip(self, k: int, parts: list) -> tuple[str, str]:
        g, rows = self.grid, strip_rows(self.grid)
        y0 = k * rows
        fill = g.nodata if g.nodata is not None else 0
        a = np.full((min(rows, g.height - y0), g.width, g.bands), fill).astype(NUMPY[g.dtype])
        for x, y, v in parts:
            a[y - y0, x] = np.where(np.isnan(v), fill, v).astype(NUMPY[g.dtype])
        t = list(g.transform)
        t[0], t[3] = t[0] + y0 * t[2], t[3] + y0 * t[5]
        name = os.path.join(self.path, _STRIP.format(y0))
        temporary = f"{name}.{TaskContext.get().taskAttemptId()}.tmp"
        with open(temporary, "wb") as f:  # renamed at commit, so an abandoned attempt leaves no raster
            f.write(encode(a, Grid(g.width, a.shape[0], tuple(t), g.crs, g.nodata, g.dtype, g.bands)))
        return name, temporary

    def write(self, iterator):
        os.makedirs(self.path, exist_ok=True)
        rows, held, done = strip_rows(self.grid), {}, []
        for batch in iterator:
            x, y = (batch.column(k).to_numpy(zero_copy_only=False).astype(int) for k in (0, 1))
            if batch.schema.field(2).name == "bands":
                v = np.array([[np.nan if e is None else e for e in b or [None] * self.grid.bands] for b in batch.column(2).to_pylist()], float).reshape(len(x), self.grid.bands)
            else:
                v = batch.column(2).to_numpy(zero_copy_only=False).astype(float)[:, None]
            if len(x) and (x.min() < 0 or y.min() < 0 or x.max() >= self.grid.width or y.max() >= self.grid.height):
                raise GridError("cells outside the grid")
            strips = y // rows
            for k in np.unique(strips).tolist():
                own = strips == k
                held.setdefault(k, []).append((x[own], y[own], v[own]))
            if len(strips) and (np.diff(strips) >= 0).all():  # sorted by strip: those before the last are whole
                for k in [k for k in held if k < strips[-1]]:
                    done.append(self._strip(k, held.pop(k)))
        done += [self._strip(k, parts) for k, parts in held.items()]
        return _Done(done)

    def commit(self, messages):
        mine = [p for m in messages if m for p in m.paths]
        if len({final for final, _ in mine}) < len(mine):
            self.abort(messages)
            raise GridError("cells of one strip came from several tasks: write with write_geotiff, or deal them by row")
        os.makedirs(self.path, exist_ok=True)
        if self.overwrite:
            for p in _files(self.path):
                os.remove(p)
        for final, temporary in mine:
            os.rename(temporary, final)
        with open(os.path.join(self.path, "_grid.json"), "w") as f:
            json.dump(dataclasses.asdict(self.grid), f)

    def abort(self, messages):
        for m in messages:
            for _, temporary in m.paths if m else []:
                if os.path.exists(temporary):
                    os.remove(temporary)


def grid_of(path: str) -> Grid:
    """The grid of a raster file, or of a folder that the sink wrote."""
    local = path.removeprefix("file://").removeprefix("file:")
    if os.path.isdir(local):
        with open(os.path.join(local, "_grid.json")) as f:
            kept = json.load(f)
        return Grid(**kept | {"transform": tuple(kept["transform"])})
    return header_of(local).grid


class GeoTiffSource(DataSource):
    @classmethod
    def name(cls):
        return "geotiff"

    def schema(self):
        return "x int, y int, bands array<double>" if self.options.get("bands") == "all" else "x int, y int, v double"

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("bands") == "all", int(self.options.get("blocks", 64)))

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options), overwrite)


def encode(a: np.ndarray, grid: Grid, level: int = 9) -> bytes:
    """A deflated TIFF of rows x columns (or rows x columns x bands), predictor 2 for whole numbers."""
    a = a if a.ndim == 3 else a[:, :, None]
    h, w, bands = a.shape
    whole = a.dtype.kind in "ui"
    rows = max(1, (1 << 20) // (w * bands * a.itemsize))
    strips = []
    for y in range(0, h, rows):
        s = a[y : y + rows]
        if whole:
            s = np.concatenate((s[:, :1], np.diff(s, axis=1)), axis=1).astype(a.dtype)
        strips.append(zlib.compress(np.ascontiguousarray(s).astype(a.dtype.newbyteorder("<")).tobytes(), level))
    t = grid.transform
    epsg = int(grid.crs.rsplit(":", 1)[-1]) if grid.crs.rsplit(":", 1)[-1].isdigit() else 0
    fields: list[tuple[int, str, tuple]] = [
        (WIDTH, "I", (w,)), (HEIGHT, "I", (h,)), (BITS, "H", (8 * a.itemsize,) * bands), (COMPRESSION, "H", (8,)), (262, "H", (1,)), (STRIPS, "I", (0,) * len(strips)),
        (SAMPLES, "H", (bands,)), (ROWS, "I", (rows,)), (STRIP_BYTES, "I", tuple(map(len, strips))), (PLANAR, "H", (1,)), (PREDICTOR, "H", (2 if whole else 1,)),
        (FORMAT, "H", ({"u": 1, "i": 2, "f": 3}[a.dtype.kind],) * bands), (SCALE, "d", (t[1], -t[5], 0.0)), (TIE, "d", (0.0, 0.0, 0.0, t[0], t[3], 0.0)),
    ]
    if epsg:
        fields.append((KEYS, "H", (1, 1, 0, 1, 2048 if grid.geographic else 3072, 0, 1, epsg)))
    if grid.nodata is not None:
        fields.append((NODATA, "s", (f"{grid.nodata:g}\0".encode(),)))
    fields.sort(key=lambda x: x[0])
    start = 8 + 2 + 12 * len(fields) + 4
    extra, table, strip_field = b"", [], None
    for tag, code, values in fields:
        raw = values[0] if code == "s" else struct.pack("<" + code * len(values), *values)
        count = len(raw) if code == "s" else len(values)
        place = None
        if len(raw) > 4:
            place = start + len(extra)
            extra += raw + b"\0" * (len(raw) % 2)
        if tag == STRIPS:
            strip_field = (len(table), place)
        table.append([tag, {"I": 4, "H": 3, "d": 12, "s": 2}[code], count, raw if place is None else struct.pack("<I", place)])
    at, offsets = start + len(extra), []
    for s in strips:
        offsets.append(at)
        at += len(s)
    packed = struct.pack("<" + "I" * len(offsets), *offsets)
    k, place = strip_field
    if place is None:
        table[k][3] = packed
    else:
        extra = extra[: place - start] + packed + extra[place - start + len(packed) :]
    head = b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", len(table))
    head += b"".join(struct.pack("<HHI", tag, kind, count) + raw.ljust(4, b"\0") for tag, kind, count, raw in table) + struct.pack("<I", 0)
    return head + extra + b"".join(strips)


def describe_files(files: DataFrame) -> DataFrame:
    """binaryFile rows -> one row of metadata per file; unreadable ones have an error."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content, size in zip(pdf["path"], pdf["content"], pdf["length"], strict=True):
                row = {"path": path, "size_mb": round(size / 1e6, 2), "width": None, "height": None, "bands": None, "dtype": None, "epsg": None, "res": None, "nodata": None, "error": None}
                try:
                    g = parse_header(lambda at, n, c=content: bytes(c[at : at + n])).grid
                    row |= {"width": g.width, "height": g.height, "bands": g.bands, "dtype": g.dtype, "epsg": g.crs or None, "res": round(abs(g.transform[1]), 6), "nodata": g.nodata}
                except (GridError, struct.error, KeyError) as e:
                    row["error"] = str(e) or type(e).__name__
                rows.append(row)
            yield pd.DataFrame(rows, columns=["path", "size_mb", "width", "height", "bands", "dtype", "epsg", "res", "nodata", "error"])

    return files.select("path", "content", "length").mapInPandas(run, "path string, size_mb double, width int, height int, bands int, dtype string, epsg string, res double, nodata double, error string")
