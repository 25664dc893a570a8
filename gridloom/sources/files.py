"""Readers and writers of the file formats around the engine; all become or come from plain tables."""

from __future__ import annotations

import html
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.operators.features import require_columns
from gridloom.sources.shared import staged


def read_csv(spark: SparkSession, path: str, required: list[str] = (), schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header; without a schema all columns are text. Required columns are checked before data is read."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader).csv(path)
    require_columns(df, list(required))
    return df


def read_geojson(spark: SparkSession, path: str, properties: str = "map<string,string>") -> DataFrame:
    """A row for each feature: id, geometry_type, coordinates (JSON text), properties."""
    feature = f"struct<id:string,geometry:struct<type:string,coordinates:string>,properties:{properties}>"
    raw = spark.read.schema(f"features array<{feature}>").option("multiLine", True).json(path)
    return raw.select(F.explode("features").alias("f")).select(F.col("f.id").alias("id"), F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def read_geojson_lines(spark: SparkSession, path: str, properties: str = "map<string,string>") -> DataFrame:
    """A row for each line, a feature: geometry_type, coordinates (JSON text), properties; read by many tasks."""
    f = F.from_json("value", f"struct<geometry:struct<type:string,coordinates:string>,properties:{properties}>")
    raw = spark.read.text(path).select(f.alias("f"))
    return raw.select(F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def read_rdb(spark: SparkSession, path: str) -> DataFrame:
    """Tab text with # comments, a header and a line of column types: columns of text, empty as null.

    The header is the first line that is no comment; every file of the path must have the same one.
    """
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    header = lines.limit(1).first()
    if header is None:
        return spark.createDataFrame([], "value string").drop("value")
    names = header[0].split("\t")
    parts = F.split("value", "\t", -1)
    rows = lines.filter((F.col("value") != header[0]) & ~F.col("value").rlike(r"^\d+[snd](\t\d+[snd])*$"))
    return rows.select(*[F.when(F.get(parts, F.lit(i)) != "", F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(names)])


def daily_values(rdb: DataFrame, parameter: str, statistic: str = "00003") -> DataFrame:
    """site_no, date, value of a parameter's daily statistic; codes such as Ice become null, and rows without a value go."""
    column = next((c for c in rdb.columns if parameter in c and f"_{statistic}" in c and not c.endswith("_cd")), None)
    if column is None:
        raise ValueError(f"no column for {parameter} with statistic {statistic}")
    return rdb.select("site_no", F.try_to_date(F.col("datetime")).alias("date"), F.col(column).try_cast("double").alias("value")).dropna(subset=["value"])


def paged(spark: SparkSession, fetch, total: int | None, page: int, schema: str, wave: int = 64, skip_failed: bool = False) -> DataFrame:
    """Rows of a paged service: fetch(offset, limit) gives a list of dicts; pages are read by tasks.

    With a total its pages are read. Without one, waves of pages are read until a page comes short: the first
    of `wave` pages, each of as many as all before it together, so there are few waves however many pages there
    are. A wave has `wave` tasks at most, which read their pages one after another. Each wave is staged, so no
    page is fetched twice. A page that fails fails the job, after Spark's own attempts, or is left out if skip_failed.
    """

    named = StructType.fromDDL(f"__page string, {schema}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for offset in batch["id"]:
                try:
                    rows = fetch(int(offset), page)
                except Exception:
                    if not skip_failed:
                        raise
                    rows, state = [], "failed"
                else:
                    state = "full" if len(rows) >= page else "short"
                for part, mark in ((rows, None), ([{}], state)):
                    if part:
                        frame = pd.DataFrame(part, dtype=object).reindex(columns=named.names)
                        yield frame.assign(__page=mark)

    def pages(first: int, stop: int, most: int) -> DataFrame:
        count = min(max(1, -(-(stop - first) // page)), most)
        return spark.range(first, stop, page).repartition(count).mapInPandas(run, named)

    if total is not None:
        return pages(0, total, max(wave, 1024)).filter("__page is null").drop("__page")
    out, at = None, 0
    while True:
        stop = max(2 * at, wave * page)
        part = staged(pages(at, stop, wave), "pages")
        at = stop
        rows = part.filter("__page is null").drop("__page")
        out = rows if out is None else out.unionByName(rows)
        if not part.filter("__page = 'short'").isEmpty():
            return out


# TIFF rasters. Sample kinds by (format, bits), struct letters of field types, tags.
_KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
_FIELD = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, SCALE, TIEPOINT, GEO_KEYS, ITEMS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42112, 42113
GEOGRAPHIC, PROJECTED = 2048, 3072


@dataclass(frozen=True)
class Raster:
    """Bands x rows x columns, and where they lie: the upper left corner, the size of a cell (north up), the EPSG code, and named items."""

    cube: np.ndarray
    nodata: float | None = None
    west: float | None = None
    north: float | None = None
    dx: float | None = None
    dy: float | None = None
    epsg: int | None = None
    items: dict[str, str] = field(default_factory=dict)


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; the width grows one code early."""
    out, held, bits, at, width = bytearray(), 0, 0, 0, 9
    table: list[bytes] = []
    before = b""
    while True:
        while bits < width:
            if at >= len(data):
                return bytes(out)
            held, bits, at = held << 8 | data[at], bits + 8, at + 1
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            return bytes(out)
        if code == 256:
            table, before, width = [bytes([i]) for i in range(256)] + [b"", b""], b"", 9
            continue
        if not table or code > len(table) or (code == len(table) and not before):
            raise ValueError("damaged LZW data")
        entry = table[code] if code < len(table) else before + before[:1]
        out += entry
        if before:
            table.append(before + entry[:1])
        before = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12


def lzw_encode(data: bytes) -> bytes:
    out, held, bits, width = bytearray(), 0, 0, 9
    table: dict[bytes, int] = {}
    codes: list[tuple[int, int]] = [(256, 9)]
    size, prefix = 258, b""
    for i in range(len(data)):
        one = data[i : i + 1]
        if len(prefix) == 0 or prefix + one in table:
            prefix += one
            continue
        codes.append((table[prefix] if len(prefix) > 1 else prefix[0], width))
        table[prefix + one] = size
        size += 1
        prefix = one
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4094:
            codes.append((prefix[0], width))
            codes.append((256, width))
            table, size, width, prefix = {}, 258, 9, b""
    if prefix:
        codes.append((table[prefix] if len(prefix) > 1 else prefix[0], width))
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    for code, wide in [*codes, (257, width)]:
        held, bits = held << wide | code, bits + wide
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
            held &= (1 << bits) - 1
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def _unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


_DECODERS = {NONE: bytes, LZW: lzw_decode, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: _unpack_bits}


def _tags(data: bytes) -> tuple[str, dict[int, list]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(order + "I", data, 4)[0]
    tags: dict[int, list] = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        form = _FIELD.get(kind, "B") * count
        where = at + 10 + 12 * i
        if struct.calcsize(order + form) > 4:
            where = struct.unpack_from(order + "I", data, where)[0]
        tags[tag] = list(struct.unpack_from(order + form, data, where))
    return order, tags


def _unpredict(block: np.ndarray, predictor: int) -> np.ndarray:
    """Rows x columns x samples from differences along the row (2), or from differences of the bytes in order of weight (3)."""
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype)
    if predictor == 3:
        rows, columns, samples = block.shape
        flat = np.cumsum(block.view(np.uint8).reshape(rows, columns * samples * block.itemsize // samples, samples), axis=1, dtype=np.uint8).reshape(rows, block.itemsize, columns * samples)
        return np.ascontiguousarray(flat.transpose(0, 2, 1)).view(block.dtype.newbyteorder(">")).reshape(block.shape)
    return block


def decode_geotiff(data: bytes) -> Raster:
    """A TIFF in strips or tiles: plain, LZW, deflated or packed, with or without predictors, bands side by side or apart; ValueError for others."""
    order, tags = _tags(data)
    one = lambda t, default=None: tags.get(t, [default])[0]
    width, height, samples, compression, predictor = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if compression not in _DECODERS or predictor not in (1, 2, 3) or (one(FORMAT, 1), one(BITS, 1)) not in _KINDS:
        raise ValueError(f"TIFF files of compression {compression}, predictor {predictor} and {one(BITS, 1)} bits are not read")
    dtype = np.dtype(order + _KINDS[one(FORMAT, 1), one(BITS, 1)])
    apart = one(PLANAR, 1) == 2
    tall, wide = (one(TILE_HEIGHT), one(TILE_WIDTH)) if TILES in tags else (min(one(STRIP_ROWS, height), height), width)
    offsets, sizes = (tags[TILES], tags[TILE_BYTES]) if TILES in tags else (tags[STRIPS], tags[STRIP_BYTES])
    down, across = -(-height // tall), -(-width // wide)
    cube = np.zeros((samples, height, width), dtype.newbyteorder("="))
    for i, (at, size) in enumerate(zip(offsets, sizes, strict=True)):
        band, spot = divmod(i, down * across) if apart else (0, i)
        r, c = spot // across * tall, spot % across * wide
        depth = 1 if apart else samples
        rows = tall if TILES in tags else min(tall, height - r)
        raw = _DECODERS[compression](data[at : at + size])[: rows * wide * depth * dtype.itemsize]
        block = _unpredict(np.frombuffer(raw, dtype).reshape(rows, wide, depth), predictor)[: height - r, : width - c]
        target = cube[band : band + 1] if apart else cube
        target[:, r : r + block.shape[0], c : c + block.shape[1]] = block.transpose(2, 0, 1)
    text = lambda t: b"".join(tags.get(t, [])).split(b"\0")[0].decode("utf-8", "replace").strip()
    keys = {tags[GEO_KEYS][i]: tags[GEO_KEYS][i + 3] for i in range(4, len(tags.get(GEO_KEYS, [])) - 3, 4) if tags[GEO_KEYS][i + 1] == 0}
    place: dict[str, float] = {}
    if SCALE in tags and len(tags.get(TIEPOINT, [])) >= 6:
        (dx, dy), (col, row, _, x, y) = tags[SCALE][:2], tags[TIEPOINT][:5]
        place = {"west": x - col * dx, "north": y + row * dy, "dx": dx, "dy": dy}
    items = dict(re.findall(r'<Item name="([^"]*)"[^>]*>([^<]*)</Item>', text(ITEMS)))
    nodata = text(NODATA)
    return Raster(cube, float(nodata) if nodata else None, **place, epsg=keys.get(PROJECTED) or keys.get(GEOGRAPHIC), items={html.unescape(k): html.unescape(v) for k, v in items.items()})


def decode_tiff(data: bytes) -> tuple[np.ndarray, float | None]:
    """Bands x rows x columns and the nodata value of a TIFF; ValueError for what is not read."""
    raster = decode_geotiff(data)
    return raster.cube, raster.nodata


def encode_geotiff(raster: Raster, compression: str = "deflate", tile: int | None = None) -> bytes:
    """A TIFF of the cube's bands, one after another: compression none, lzw or deflate, in one strip a band or in square tiles (a multiple of 16); NaN becomes nodata unless that is NaN."""
    cube = raster.cube
    if cube.dtype.kind == "f" and raster.nodata is not None:
        cube = np.where(np.isnan(cube), cube.dtype.type(raster.nodata), cube)
    cube = np.ascontiguousarray(cube.astype(cube.dtype.newbyteorder("<")))
    bands, height, width = cube.shape
    if tile and tile % 16:
        raise ValueError("the side of a tile is a multiple of 16")
    pack = {"none": bytes, "lzw": lzw_encode, "deflate": zlib.compress}[compression]
    blocks = []
    for grid in cube:
        if not tile:
            blocks.append(pack(grid.tobytes()))
            continue
        padded = np.pad(grid, ((0, -height % tile), (0, -width % tile)), mode="edge")
        blocks += [pack(np.ascontiguousarray(padded[r : r + tile, c : c + tile]).tobytes()) for r in range(0, height, tile) for c in range(0, width, tile)]
    kind = {"u": 1, "i": 2, "f": 3}[cube.dtype.kind]
    places = np.cumsum([8, *[len(b) for b in blocks]])
    entries: list[tuple[int, str, list]] = [
        (WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [8 * cube.itemsize] * bands), (COMPRESSION, "H", [{"none": NONE, "lzw": LZW, "deflate": DEFLATE}[compression]]),
        (PHOTOMETRIC, "H", [1]), (SAMPLES, "H", [bands]), (PLANAR, "H", [2]), (FORMAT, "H", [kind] * bands),
    ]
    where, sizes = places[:-1].tolist(), [len(b) for b in blocks]
    entries += [(TILE_WIDTH, "I", [tile]), (TILE_HEIGHT, "I", [tile]), (TILES, "I", where), (TILE_BYTES, "I", sizes)] if tile else [(STRIPS, "I", where), (STRIP_ROWS, "I", [height]), (STRIP_BYTES, "I", sizes)]
    if raster.west is not None:
        entries += [(SCALE, "d", [raster.dx, raster.dy, 0.0]), (TIEPOINT, "d", [0.0, 0.0, 0.0, raster.west, raster.north, 0.0])]
    if raster.epsg is not None:
        geographic = 4000 <= raster.epsg < 5000
        entries.append((GEO_KEYS, "H", [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, GEOGRAPHIC if geographic else PROJECTED, 0, 1, raster.epsg]))
    if raster.items:
        body = "".join(f'<Item name="{html.escape(k)}">{html.escape(v)}</Item>' for k, v in raster.items.items())
        entries.append((ITEMS, "s", [f"<GDALMetadata>{body}</GDALMetadata>".encode() + b"\0"]))
    if raster.nodata is not None:
        entries.append((NODATA, "s", [f"{raster.nodata:g}".encode() + b"\0"]))
    code = {"H": 3, "I": 4, "d": 12, "s": 2}
    start = int(places[-1]) + int(places[-1]) % 2
    beyond, body, head = start + 2 + 12 * len(entries) + 4, b"", b""
    for tag, form, values in sorted(entries):
        packed = values[0] if form == "s" else struct.pack(f"<{len(values)}{form}", *values)
        count = len(packed) if form == "s" else len(values)
        head += struct.pack("<HHI", tag, code[form], count) + (packed.ljust(4, b"\0") if len(packed) <= 4 else struct.pack("<I", beyond + len(body)))
        body += packed + b"\0" * (len(packed) % 2) if len(packed) > 4 else b""
    return struct.pack("<2sHI", b"II", 42, start) + b"".join(blocks).ljust(start - 8, b"\0") + struct.pack("<H", len(entries)) + head + struct.pack("<I", 0) + body


def encode_tiff(grid: np.ndarray, nodata: float | None = -9999.0) -> bytes:
    """A deflated float32 TIFF of one band; NaN becomes nodata."""
    return encode_geotiff(Raster(grid[None].astype("f4"), nodata))


def encode_rasters(cells: DataFrame, place: Raster, compression: str = "lzw", tile: int | None = None, dtype: str = "f4") -> DataFrame:
    """name, content: a TIFF of each raster from its cells (name, band from 1, row, col, value), a task for each; missing cells become nodata.

    place gives nodata, corner, cell size, EPSG code and items; its cube is not read.
    """
    rest = {f.name: getattr(place, f.name) for f in fields(Raster) if f.name != "cube"}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        missing = np.nan if dtype[0] == "f" else rest["nodata"] or 0
        cube = np.full((group["band"].max(), group["row"].max() + 1, group["col"].max() + 1), missing)
        cube[group["band"] - 1, group["row"], group["col"]] = group["value"].astype(float).fillna(missing)
        return pd.DataFrame({"name": group["name"].iloc[:1], "content": [encode_geotiff(Raster(cube.astype(dtype), **rest), compression, tile)]})

    return cells.select("name", "band", "row", "col", "value").groupBy("name").applyInPandas(run, "name string, content binary")


def save_files(contents: DataFrame, folder: str) -> int:
    """Write each content under its name in a folder of any file system that Spark knows; the driver holds one partition of them at a time. Gives their number."""
    spark, count = contents.sparkSession, 0
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for row in contents.select("name", "content").toLocalIterator():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{row.name}")
        out = path.getFileSystem(hadoop).create(path, True)
        out.write(bytearray(row.content))
        out.close()
        count += 1
    return count


def raster_info(spark: SparkSession, path: str) -> DataFrame:
    """path, bands, rows, cols, nodata, west, north, dx, dy, epsg, items of raster files."""
    names = ["nodata", "west", "north", "dx", "dy"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                r = decode_geotiff(data)
                yield pd.DataFrame([[name, *r.cube.shape, *[getattr(r, n) for n in names], r.epsg, r.items]], columns=["path", "bands", "rows", "cols", *names, "epsg", "items"], dtype=object)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"path string, bands int, rows int, cols int, {', '.join(f'{n} double' for n in names)}, epsg int, items map<string,string>")


def read_tiff(spark: SparkSession, path: str, bands: list[int] | None = None) -> DataFrame:
    """path, band (from 1), row, col, value of raster files, nodata as null; a file is decoded by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                cube, nodata = decode_tiff(data)
                for band in range(1, len(cube) + 1):
                    if bands is None or band in bands:
                        grid = cube[band - 1].astype(float)
                        rows, cols = np.indices(grid.shape)
                        values = np.where(np.isnan(grid) | (grid == nodata if nodata is not None else False), None, grid)
                        yield pd.DataFrame({"path": name, "band": band, "row": rows.ravel(), "col": cols.ravel(), "value": values.ravel()})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, band int, row int, col int, value double")


def write_geojson_lines(features: DataFrame, path: str) -> None:
    """GeoJSON text sequences, a feature on a line, in parallel; features as to_geojson() makes them."""
    features.select("feature").write.mode("overwrite").text(path)


def feature_collection(features: DataFrame, most: int) -> str:
    """One FeatureCollection document of at most `most` features, an export for viewers; ValueError if there are more."""
    rows = features.select("feature").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} features; write GeoJSON lines instead")
    return '{"type":"FeatureCollection","features":[' + ",".join(r.feature for r in rows) + "]}"


def health_markdown(report: DataFrame, title: str) -> str:
    """A health report, a few rows, as Markdown."""
    rows = report.collect()
    return "\n".join([f"# {title}", "", "| Check | Status | Affected |", "|---|---|---|", *[f"| {r.check_name} | {r.status} | {r.n_affected} |" for r in rows], ""])


def health_html(report: DataFrame, title: str) -> str:
    rows = "".join(f"<tr><td>{html.escape(r.check_name)}</td><td>{html.escape(r.status)}</td><td>{r.n_affected}</td></tr>" for r in report.collect())
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table>{rows}</table></body></html>"
