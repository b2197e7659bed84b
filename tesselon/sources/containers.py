"""Tile containers: directory, tar, MBTiles (SQLite) and PMTiles 3, as Spark sources and sinks.

Directories are read and written by all executors. The archives are single files: their index is read
once, in bounded parts, and blobs are fetched by the tasks that need them; writing streams ordered
partitions through one writer, one partition at a time.
"""

from __future__ import annotations

import bisect
import gzip
import io
import json
import os
import re
import sqlite3
import struct
import tarfile
import tempfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tesselon.functions.coords import hilbert_id
from tesselon.functions.mvt import read_varint, varint
from tesselon.operators.general import first_of_each

TILES = "z bigint, x bigint, y bigint, data binary"
WORLD_BOUNDS = (-180.0, -85.05112877980659, 180.0, 85.05112877980659)
#: What blobs of image formats begin with, and from which byte on.
_MAGIC = ((0, b"\x89PNG", "png"), (0, b"\xff\xd8\xff", "jpg"), (8, b"WEBP", "webp"), (4, b"ftypavif", "avif"))
_NAME = re.compile(r"(?:^|/)(\d+)/(\d+)/(\d+)\.([a-z]+)(?:\.(gz|zst))?$")


def compress(data: bytes, kind: str) -> bytes:
    if kind == "none":
        return data
    if kind == "gzip":
        return gzip.compress(data, mtime=0)
    if kind == "zstd":
        return zstandard.ZstdCompressor().compress(data)
    raise ValueError(f"no codec for {kind}")


def decompress(data: bytes, kind: str) -> bytes:
    if kind == "none":
        return data
    if kind == "gzip":
        return gzip.decompress(data)
    if kind == "zstd":
        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise ValueError(f"no codec for {kind}")


def recompress(tiles: DataFrame, before: str, after: str) -> DataFrame:
    if before == after:
        return tiles

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(data=[compress(decompress(bytes(d), before), after) for d in batch["data"]])

    return tiles.mapInPandas(run, tiles.schema)


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


# --- directory -----------------------------------------------------------------------------------


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """Tiles of {z}/{x}/{y}.{format}[.{compression}]; the names are parsed by Spark. Mixed formats are an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    part = lambda i: F.regexp_extract("path", _NAME.pattern, i)
    tiles = files.where(part(1) != "").select(*[part(i + 1).cast("bigint").alias(c) for i, c in enumerate("zxy")], F.col("content").alias("data"), part(4).alias("format"), part(5).alias("packed"))
    kinds = [tuple(r) for r in tiles.select("format", "packed").distinct().limit(2).collect()]
    if len(kinds) > 1:
        raise ValueError(f"{path} mixes formats or compressions: {kinds}")
    return tiles.select("z", "x", "y", "data")


def write_directory(tiles: DataFrame, path: str, extension: str, metadata: dict | None = None) -> None:
    """Writes files from all tasks; of repeated keys the smallest content is kept, so that reruns agree."""
    once = first_of_each(tiles.select("z", "x", "y", "data"), "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_path(path)
        n = 0
        for batch in batches:
            for z, x, y, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs.create_dir(f"{root}/{z}/{x}", recursive=True)
                with fs.open_output_stream(f"{root}/{z}/{x}/{y}.{extension}") as out:
                    out.write(data)
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    once.mapInArrow(run, "n long").agg(F.sum("n")).collect()
    if metadata:
        fs, root = open_path(path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/tiles.json") as out:
            out.write(json.dumps(metadata).encode())


# --- tar -----------------------------------------------------------------------------------------


class _Blobs(InputPartition):
    def __init__(self, entries: list[tuple]):
        self.entries = entries


class _ByteRanges(DataSourceReader):
    """Reads blobs by (z, x, y, offset, length), some thousand to a task, ordered by offset."""

    PER_TASK = 4096

    def __init__(self, path: str):
        self.path = path

    def entries(self) -> Iterator[tuple[int, int, int, int, int]]:
        raise NotImplementedError

    def partitions(self) -> list[InputPartition]:
        rows = sorted(self.entries(), key=lambda e: e[3])
        return [_Blobs(rows[i : i + self.PER_TASK]) for i in range(0, len(rows), self.PER_TASK)] or [_Blobs([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, name = open_path(self.path)
        with fs.open_input_file(name) as source:
            for z, x, y, offset, length in partition.entries:
                yield (z, x, y, source.read_at(length, offset))


class _Tar(_ByteRanges):
    def entries(self):
        fs, name = open_path(self.path)
        with fs.open_input_file(name) as source, tarfile.open(fileobj=io.BufferedReader(_Raw(source))) as tar:
            for member in tar:
                if member.isfile() and (m := _NAME.search(member.name)):
                    yield int(m[1]), int(m[2]), int(m[3]), member.offset_data, member.size


class _Raw(io.RawIOBase):
    """A pyarrow file for modules that want a Python one."""

    def __init__(self, source):
        self.source = source

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        self.source.seek(offset, whence)
        return self.source.tell()

    def tell(self) -> int:
        return self.source.tell()

    def readinto(self, buffer) -> int:
        data = self.source.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


class TarSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiles_tar"

    def schema(self) -> str:
        return TILES

    def reader(self, schema) -> DataSourceReader:
        return _Tar(self.options["path"])


def _ordered(tiles: DataFrame) -> Iterator:
    """Distinct tiles in Hilbert order, one partition at a time."""
    once = first_of_each(tiles.select("z", "x", "y", "data"), "data").withColumn("id", hilbert_id("z", "x", "y"))
    return once.orderBy("id").toLocalIterator(prefetchPartitions=True)


def write_tar(tiles: DataFrame, path: str, extension: str, metadata: dict | None = None) -> None:
    fs, name = open_path(path)
    with fs.open_output_stream(name) as out, tarfile.open(fileobj=out, mode="w|") as tar:
        if metadata:
            info, text = tarfile.TarInfo("tiles.json"), json.dumps(metadata).encode()
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text))
        for r in _ordered(tiles):
            info = tarfile.TarInfo(f"{r.z}/{r.x}/{r.y}.{extension}")
            info.size = len(r.data)
            tar.addfile(info, io.BytesIO(bytes(r.data)))


# --- MBTiles -------------------------------------------------------------------------------------


class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _MBTiles(DataSourceReader):
    """Partitions by row id. The file must be on a path that the executors can open."""

    PER_TASK = 20_000

    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute("SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM tiles").fetchone()
        return [_Rows(a, min(high, a + self.PER_TASK - 1)) for a in range(low, high + 1, self.PER_TASK)] or [_Rows(0, -1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            rows = db.execute("SELECT zoom_level, tile_column, tile_row, tile_data FROM tiles WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high))
            for z, x, row, data in rows:
                yield (z, x, (1 << z) - 1 - row, bytes(data))


class MBTilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiles_mbtiles"

    def schema(self) -> str:
        return TILES

    def reader(self, schema) -> DataSourceReader:
        return _MBTiles(self.options["path"])


def mbtiles_metadata(kind: str, known: dict) -> dict[str, str]:
    """The metadata table's rows: lists with commas, layers as JSON, everything as text."""
    rows = {k: ",".join(map(str, v)) if k in ("bounds", "center") else v for k, v in known.items() if k not in ("tilejson", "vector_layers", "format")}
    if known.get("vector_layers"):
        rows["json"] = json.dumps({"vector_layers": known["vector_layers"]})
    return {"format": "pbf" if kind == "mvt" else kind, **{k: v if isinstance(v, str) else json.dumps(v) for k, v in rows.items()}}


def write_mbtiles(tiles: DataFrame, path: str, metadata: dict[str, str]) -> None:
    """Rows count from the south, as the format has it."""
    fs, name = open_path(path)
    with tempfile.TemporaryDirectory() as folder:
        local = os.path.join(folder, "tiles.sqlite")
        db = sqlite3.connect(local)
        db.execute("CREATE TABLE metadata (name TEXT, value TEXT, UNIQUE (name))")
        db.execute("CREATE TABLE tiles (zoom_level INTEGER, tile_column INTEGER, tile_row INTEGER, tile_data BLOB)")
        db.execute("CREATE UNIQUE INDEX tile_index ON tiles (zoom_level, tile_column, tile_row)")
        db.executemany("INSERT INTO metadata VALUES (?, ?)", metadata.items())
        db.executemany("INSERT INTO tiles VALUES (?, ?, ?, ?)", ((r.z, r.x, (1 << r.z) - 1 - r.y, bytes(r.data)) for r in _ordered(tiles)))
        db.commit()
        db.close()
        with open(local, "rb") as source, fs.open_output_stream(name) as out:
            while part := source.read(1 << 20):
                out.write(part)


# --- PMTiles 3 -----------------------------------------------------------------------------------

#: Codes of the format's header.
PM_COMPRESSION = {"unknown": 0, "none": 1, "gzip": 2, "brotli": 3, "zstd": 4}
PM_TYPE = {"unknown": 0, "mvt": 1, "png": 2, "jpg": 3, "webp": 4, "avif": 5}
_ROOT_ROOM = 16_384 - 127
_LEAF = 4096


def tile_key(tile_id: int) -> tuple[int, int, int]:
    """(z, x, y) of a Hilbert id: the inverse of ``hilbert_id``."""
    z = 0
    while tile_id >= 4**z:
        tile_id -= 4**z
        z += 1
    x = y = 0
    for i in range(z):
        side, digit = 1 << i, tile_id >> (2 * i) & 3
        right = digit >> 1
        low = (digit ^ right) & 1
        if not low:
            if right:
                x, y = side - 1 - x, side - 1 - y
            x, y = y, x
        x, y = x + side * right, y + side * low
    return z, x, y


def hilbert_number(z: int, x: int, y: int) -> int:
    """Hilbert id of one tile: the inverse of ``tile_key``."""
    out, side = 0, 1 << z
    for i in range(z - 1, -1, -1):
        right, low = x >> i & 1, y >> i & 1
        out += (3 * right ^ low) << 2 * i
        if not low:
            if right:
                x, y = side - 1 - x, side - 1 - y
            x, y = y, x
    return out + (4**z - 1) // 3


def encode_directory(entries: list[tuple[int, int, int, int]]) -> bytes:
    """entries: (id, offset, length, run), sorted by id."""
    out = bytearray(varint(len(entries)))
    last = 0
    for e in entries:
        out += varint(e[0] - last)
        last = e[0]
    for e in entries:
        out += varint(e[3])
    for e in entries:
        out += varint(e[2])
    for i, e in enumerate(entries):
        follows = i > 0 and e[1] == entries[i - 1][1] + entries[i - 1][2]
        out += varint(0 if follows else e[1] + 1)
    return bytes(out)


def decode_directory(data: bytes) -> list[tuple[int, int, int, int]]:
    n, at = read_varint(data, 0)
    columns = []
    for _ in range(4):
        column = []
        for _ in range(n):
            value, at = read_varint(data, at)
            column.append(value)
        columns.append(column)
    out, tile_id, follows = [], 0, 0
    for step, run, length, place in zip(*columns, strict=True):
        tile_id += step
        offset = follows if place == 0 and out else place - 1
        out.append((tile_id, offset, length, run))
        follows = offset + length
    return out


def read_header(head: bytes) -> dict:
    if head[:8] != b"PMTiles\x03":
        raise ValueError("not a PMTiles 3 archive")
    names = ("root_offset", "root_length", "metadata_offset", "metadata_length", "leaf_offset", "leaf_length", "data_offset", "data_length", "addressed", "entries", "contents")
    header = dict(zip(names, struct.unpack("<11Q", head[8:96]), strict=True))
    code = lambda table, v: next((k for k, c in table.items() if c == v), "unknown")
    header |= {"clustered": bool(head[96]), "internal": code(PM_COMPRESSION, head[97]), "compression": code(PM_COMPRESSION, head[98]), "type": code(PM_TYPE, head[99]), "minzoom": head[100], "maxzoom": head[101]}
    header["bounds"] = [v / 1e7 for v in struct.unpack("<4i", head[102:118])]
    return header


class _PMTiles(_ByteRanges):
    def entries(self):
        fs, name = open_path(self.path)
        with fs.open_input_file(name) as source:
            header = read_header(source.read_at(127, 0))
            todo = [(header["root_offset"], header["root_length"])]
            while todo:
                offset, length = todo.pop()
                for tile_id, place, size, run in decode_directory(decompress(source.read_at(length, offset), header["internal"])):
                    if run == 0:
                        todo.append((header["leaf_offset"] + place, size))
                    for i in range(run):
                        yield (*tile_key(tile_id + i), header["data_offset"] + place, size)


def pmtiles_tile(path: str, z: int, x: int, y: int) -> bytes | None:
    """One tile of an archive as it is stored: the root and at most a few leaf directories are read, nothing else."""
    wanted = hilbert_number(z, x, y)
    fs, name = open_path(path)
    with fs.open_input_file(name) as source:
        header = read_header(source.read_at(127, 0))
        offset, length = header["root_offset"], header["root_length"]
        for _ in range(4):
            entries = decode_directory(decompress(source.read_at(length, offset), header["internal"]))
            at = bisect.bisect_right(entries, wanted, key=lambda e: e[0]) - 1
            if at < 0:
                return None
            first, place, size, run = entries[at]
            if run:
                return source.read_at(size, header["data_offset"] + place) if wanted < first + run else None
            offset, length = header["leaf_offset"] + place, size
    return None


class PMTilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiles_pmtiles"

    def schema(self) -> str:
        return TILES

    def reader(self, schema) -> DataSourceReader:
        return _PMTiles(self.options["path"])


def write_pmtiles(tiles: DataFrame, path: str, kind: str, compression: str = "none", metadata: dict | None = None, bounds=WORLD_BOUNDS) -> None:
    """Clustered by Hilbert id; equal contents are stored once, consecutive equal tiles are one run."""
    import xxhash

    fs, name = open_path(path)
    entries: list[list[int]] = []
    known: dict[bytes, tuple[int, int]] = {}
    levels, addressed, at = [30, 0], 0, 0
    with tempfile.TemporaryFile() as blobs:
        for r in _ordered(tiles):
            data = bytes(r.data)
            mark = xxhash.xxh3_128_digest(data)
            if mark not in known:
                known[mark] = (at, len(data))
                blobs.write(data)
                at += len(data)
            offset, length = known[mark]
            if entries and entries[-1][1] == offset and entries[-1][0] + entries[-1][3] == r.id:
                entries[-1][3] += 1
            else:
                entries.append([r.id, offset, length, 1])
            levels = [min(levels[0], r.z), max(levels[1], r.z)]
            addressed += 1
        pack = lambda rows: gzip.compress(encode_directory(rows), mtime=0)
        root, leaves, size = pack(entries), b"", _LEAF
        while len(root) > _ROOT_ROOM:
            leaves, index = b"", []
            for i in range(0, len(entries), size):
                leaf = pack(entries[i : i + size])
                index.append((entries[i][0], len(leaves), len(leaf), 0))
                leaves += leaf
            root, size = pack(index), size * 2
        extra = gzip.compress(json.dumps(metadata or {}).encode(), mtime=0)
        start = 127
        layout = [start, len(root), start + len(root), len(extra), start + len(root) + len(extra), len(leaves), start + len(root) + len(extra) + len(leaves), at, addressed, len(entries), len(known)]
        box = [round(v * 1e7) for v in bounds]
        center = [(box[0] + box[2]) // 2, (box[1] + box[3]) // 2]
        head = b"PMTiles\x03" + struct.pack("<11Q", *layout) + bytes([1, PM_COMPRESSION["gzip"], PM_COMPRESSION[compression], PM_TYPE[kind], *levels]) + struct.pack("<4i", *box) + bytes([levels[0]]) + struct.pack("<2i", *center)
        with fs.open_output_stream(name) as out:
            out.write(head + root + extra + leaves)
            blobs.seek(0)
            while part := blobs.read(1 << 20):
                out.write(part)


def register(spark: SparkSession) -> None:
    for source in (TarSource, MBTilesSource, PMTilesSource):
        spark.dataSource.register(source)


def sniff(data: bytes) -> tuple[str, str]:
    """(format, compression) of a blob: an image by its first bytes, else a vector tile."""
    if data[:2] == b"\x1f\x8b":
        return sniff(gzip.decompress(data))[0], "gzip"
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return sniff(decompress(data, "zstd"))[0], "zstd"
    return next((kind for at, magic, kind in _MAGIC if data[at : at + len(magic)] == magic), "mvt"), "none"


def describe(path: str) -> dict:
    """What an archive says of itself, in the JSON form of a TileJSON; format as the archive names it."""
    lower = path.lower()
    if lower.endswith(".mbtiles"):
        with sqlite3.connect(f"file:{path.removeprefix('file://')}?mode=ro", uri=True) as db:
            rows = dict(db.execute("SELECT name, value FROM metadata"))
        known = {**rows, **json.loads(rows.pop("json", "{}"))}
        known.pop("json", None)
        for key, kind in (("bounds", float), ("center", float)):
            if key in known:
                known[key] = [kind(v) for v in known[key].split(",")]
        return known | {k: int(known[k]) for k in ("minzoom", "maxzoom") if k in known}
    fs, name = open_path(path)
    if lower.endswith(".pmtiles"):
        with fs.open_input_file(name) as source:
            header = read_header(source.read_at(127, 0))
            known = json.loads(decompress(source.read_at(header["metadata_length"], header["metadata_offset"]), header["internal"]) or b"{}")
        return known | {"bounds": header["bounds"], "minzoom": header["minzoom"], "maxzoom": header["maxzoom"], "format": header["type"]}
    if lower.endswith(".tar"):
        with fs.open_input_file(name) as source, tarfile.open(fileobj=io.BufferedReader(_Raw(source))) as tar:
            for member in tar:
                if member.isfile() and os.path.basename(member.name) in ("tiles.json", "metadata.json"):
                    return json.loads(tar.extractfile(member).read())
                if _NAME.search(member.name):  # descriptions come first
                    break
        return {}
    if not lower.endswith(".parquet"):
        for own in ("tiles.json", "metadata.json"):
            if fs.get_file_info(f"{name}/{own}").type == pafs.FileType.File:
                with fs.open_input_stream(f"{name}/{own}") as source:
                    return json.loads(source.read())
    return {}


def read_container(spark: SparkSession, path: str) -> DataFrame:
    """Tiles of a container, by the path's extension; a path without one is a directory."""
    register(spark)
    for end in ("tar", "mbtiles", "pmtiles"):
        if path.lower().endswith("." + end):
            return spark.read.format(f"tiles_{end}").option("path", path).load()
    return spark.read.parquet(path) if path.lower().endswith(".parquet") else read_directory(spark, path)


def write_container(tiles: DataFrame, path: str, kind: str, compression: str = "none", metadata: dict | None = None) -> None:
    suffix = {"none": "", "gzip": ".gz", "zstd": ".zst"}[compression]
    if path.lower().endswith(".pmtiles"):
        known = metadata or {}
        write_pmtiles(tiles, path, kind, compression, {k: v for k, v in known.items() if k not in ("bounds", "center", "tilejson", "minzoom", "maxzoom")}, tuple(known.get("bounds") or WORLD_BOUNDS))
    elif path.lower().endswith(".mbtiles"):
        write_mbtiles(tiles, path, mbtiles_metadata(kind, metadata or {}))
    elif path.lower().endswith(".tar"):
        write_tar(tiles, path, kind + suffix, metadata)
    elif path.lower().endswith(".parquet"):
        once = first_of_each(tiles.select("z", "x", "y", "data"), "data").withColumn("_id", hilbert_id("z", "x", "y"))
        once.repartitionByRange("_id").sortWithinPartitions("_id").drop("_id").write.mode("overwrite").parquet(path)
    else:
        write_directory(tiles, path, kind + suffix, metadata)
