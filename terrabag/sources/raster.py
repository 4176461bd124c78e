"""Rasters as grid tables: single-band TIFF and ESRI ASCII files in, tiled Parquet and ASCII files out."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrabag.operators.grid import valid_cell, with_tiles


@dataclass(frozen=True)
class Signature:
    """Size and place of a raster: rasters that are stacked must have equal ones."""

    width: int
    height: int
    x0: float
    y0: float
    dx: float
    dy: float


# TIFF field sizes by type, and the numbers of the tags used.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8}
_CODES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _OFFSETS, _SAMPLES, _ROWS, _COUNTS, _FORMAT, _SCALE, _TIE, _NODATA = 256, 257, 258, 259, 273, 277, 278, 279, 339, 33550, 33922, 42113


def parse_tiff(raw: bytes) -> tuple[np.ndarray, Signature, float | None]:
    """(bands x rows x columns, signature, nodata) of a baseline TIFF with strips, uncompressed or deflated, with pixel-interleaved bands."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise ValueError("not a baseline TIFF")
    (at,) = struct.unpack_from(order + "I", raw, 4)
    tags: dict[int, tuple] = {}
    for i in range(struct.unpack_from(order + "H", raw, at)[0]):
        tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
        place = at + 10 + 12 * i
        if _SIZES.get(kind, 0) * count > 4:
            (place,) = struct.unpack_from(order + "I", raw, place)
        if kind in _CODES:
            got = struct.unpack_from(f"{order}{count}{_CODES[kind]}", raw, place)
            tags[tag] = (b"".join(got).rstrip(b"\0").decode(),) if kind == 2 else got
    w, h, n = tags[_WIDTH][0], tags[_HEIGHT][0], tags.get(_SAMPLES, (1,))[0]
    packed = tags.get(_COMPRESSION, (1,))[0]
    if packed not in (1, 8, 32946):
        raise ValueError(f"TIFF compression {packed} isn't supported")
    kind = {1: "u", 2: "i", 3: "f"}[tags.get(_FORMAT, (1,))[0]]
    dtype = np.dtype(f"{order}{kind}{tags[_BITS][0] // 8}")
    body = b"".join((lambda s: s if packed == 1 else zlib.decompress(s))(raw[o : o + c]) for o, c in zip(tags[_OFFSETS], tags[_COUNTS], strict=True))
    data = np.frombuffer(body, dtype, w * h * n).reshape(h, w, n).transpose(2, 0, 1).astype(float)
    sx, sy = tags.get(_SCALE, (1.0, 1.0))[:2]
    tie = tags.get(_TIE, (0.0, 0.0, 0.0, 0.0, float(h) * sy, 0.0))
    nodata = tags.get(_NODATA)
    return data, Signature(w, h, tie[3] - tie[0] * sx, tie[4] + tie[1] * sy, sx, sy), float(nodata[0]) if nodata and nodata[0].strip() else None


def parse_ascii(raw: bytes) -> tuple[np.ndarray, Signature, float | None]:
    """(1 x rows x columns, signature, nodata) of an ESRI ASCII grid."""
    words = raw.decode().split()
    head, i = {}, 0
    while words[i][0].isalpha():
        head[words[i].lower()] = float(words[i + 1])
        i += 2
    w, h, size = int(head["ncols"]), int(head["nrows"]), head["cellsize"]
    data = np.array(words[i:], float).reshape(1, h, w)
    return data, Signature(w, h, head.get("xllcorner", 0.0), head.get("yllcorner", 0.0) + h * size, size, size), head.get("nodata_value")


def read_raster(spark: SparkSession, path: str) -> tuple[DataFrame, Signature]:
    """(row, col, values) of one file or a glob of one-file rasters, decoded on the executors, and the signature.

    A file is decoded in one task; large areas are kept as many tiles or written once as tiled Parquet.
    """
    files = spark.read.format("binaryFile").load(path)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, raw in zip(b["path"], b["content"], strict=True):
                data, s, nodata = (parse_ascii if name.lower().endswith((".asc", ".txt")) else parse_tiff)(bytes(raw))
                if nodata is not None:
                    data = np.where(data == nodata, np.nan, data)
                row, col = np.divmod(np.arange(s.width * s.height), s.width)
                yield pd.DataFrame({"name": name, "row": row.astype("int32"), "col": col.astype("int32"), "bands": list(data.reshape(len(data), -1).T), **{k: getattr(s, k) for k in ("width", "height", "x0", "y0", "dx", "dy")}})

    cells = files.select("path", "content").mapInPandas(decode, "name string, row int, col int, bands array<double>, width int, height int, x0 double, y0 double, dx double, dy double")
    found = cells.select("width", "height", "x0", "y0", "dx", "dy").distinct().take(2)
    if len(found) != 1:
        raise ValueError("rasters are not aligned")
    return cells.select("name", "row", "col", "bands"), Signature(**found[0].asDict())


def stack(spark: SparkSession, paths: Sequence[str], names: Sequence[str] | None = None) -> tuple[DataFrame, Signature]:
    """The grid of several single-band rasters; raises unless their signatures and names are fit."""
    if names and len(set(names)) != len(paths):
        raise ValueError("band names must be unique, one a raster")
    grid, first = None, None
    for i, p in enumerate(paths):
        cells, s = read_raster(spark, p)
        if first is not None and s != first:
            raise ValueError(f"{p} is not aligned with {paths[0]}")
        first = s
        one = cells.select("row", "col", F.col("bands").alias(f"b{i}"))
        grid = one if grid is None else grid.join(one, ["row", "col"])
    return as_grid(grid.select("row", "col", F.concat(*[F.col(f"b{i}") for i in range(len(paths))]).alias("bands")), first), first


def as_grid(cells: DataFrame, s: Signature, nodata: float | None = None) -> DataFrame:
    """Grid schema of (row, col, bands)."""
    return cells.select("row", "col", (F.lit(s.x0) + (F.col("col") + 0.5) * s.dx).alias("x"), (F.lit(s.y0) - (F.col("row") + 0.5) * s.dy).alias("y"), "bands", valid_cell("bands", nodata).alias("valid"))


def write_tiles(grid: DataFrame, path: str, block: int = 512) -> None:
    """Parquet partitioned by tile, so that reading a window opens its tiles only."""
    with_tiles(grid, block).repartition("tile_row", "tile_col").write.mode("overwrite").partitionBy("tile_row", "tile_col").parquet(path)


def write_surface(surface: DataFrame, path: str, value: str = "suitability") -> None:
    """row, col, x, y and the value as Parquet."""
    if not {"row", "col", "x", "y", value} <= set(surface.columns):
        raise ValueError("a surface needs row, col, x, y and its value: join it with its reference grid")
    surface.select("row", "col", "x", "y", value).write.mode("overwrite").parquet(path)


def to_ascii(data: np.ndarray, s: Signature, nodata: float = -9999.0) -> str:
    """An ESRI ASCII grid of a small raster."""
    head = f"ncols {s.width}\nnrows {s.height}\nxllcorner {s.x0}\nyllcorner {s.y0 - s.height * s.dy}\ncellsize {s.dx}\nNODATA_value {nodata}\n"
    return head + "\n".join(" ".join(repr(float(v)) if np.isfinite(v) else str(nodata) for v in row) for row in data) + "\n"


def to_tiff(data: np.ndarray, s: Signature, nodata: float | None = None) -> bytes:
    """A deflated float64 TIFF of bands x rows x columns."""
    bands = data if data.ndim == 3 else data[None]
    body = zlib.compress(np.ascontiguousarray(bands.transpose(1, 2, 0)).astype("<f8").tobytes())
    n = len(bands)
    fields = [(_WIDTH, 4, [s.width]), (_HEIGHT, 4, [s.height]), (_BITS, 3, [64] * n), (_COMPRESSION, 3, [8]), (262, 3, [1]), (_OFFSETS, 4, [0]), (_SAMPLES, 3, [n]), (_ROWS, 4, [s.height]), (_COUNTS, 4, [len(body)]), (284, 3, [1]), (_FORMAT, 3, [3] * n), (_SCALE, 12, [s.dx, s.dy, 0.0]), (_TIE, 12, [0.0, 0.0, 0.0, s.x0, s.y0, 0.0])]
    if nodata is not None:
        fields.append((_NODATA, 2, list(f"{nodata}\0".encode())))
    start, extra = 8 + 2 + 12 * len(fields) + 4, b""
    packed = [struct.pack(f"<{len(v)}{'B' if k == 2 else _CODES[k]}", *v) for _, k, v in fields]
    place = start + sum(len(p) for p in packed if len(p) > 4)
    entries = b""
    for (tag, kind, values), p in zip(fields, packed, strict=True):
        if tag == _OFFSETS:
            p = struct.pack("<I", place)
        if len(p) > 4:
            entries += struct.pack("<HHII", tag, kind, len(values), start + len(extra))
            extra += p
        else:
            entries += struct.pack("<HHI", tag, kind, len(values)) + p.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(fields)) + entries + b"\0\0\0\0" + extra + body
