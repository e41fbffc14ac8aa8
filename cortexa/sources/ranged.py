"""A data source for files of arrays, whose partitions are byte ranges, so that a file may be larger than a task.

``node_arrays`` has the rows of arrays in .npy and .npz files and uncompressed
NIfTI-1 images (a row for each voxel, its values over time); headers are read
once, when partitions are planned. It is written, too: a task writes .npz files
under names of its own, which the commit makes visible.

Files are reached through pyarrow's file systems: local and shared folders, and
the stores that pyarrow knows by their URI.
"""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes of a partition, and of rows that a task holds as numbers at a time.
RANGE_BYTES, HELD_BYTES = 64 << 20, 8 << 20


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def found(path: str, endings: tuple[str, ...] = ("",)) -> list[tuple[str, int]]:
    """Path and size of a file, or of the files below a folder that end so and do not start with a dot or an underscore, by name."""
    files, name = _place(path)
    info = files.get_file_info(name)
    infos = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(name, recursive=True))
    kept = [x for x in infos if x.type == fs.FileType.File and x.base_name[:1] not in "._" and x.base_name.endswith(endings)]
    return sorted((x.path, x.size) for x in kept)


def _open(base: str, path: str) -> pa.NativeFile:
    return _place(base)[0].open_input_file(path)


@dataclass
class Rows(InputPartition):
    """Rows ``start`` to ``stop`` of an array that lies at ``offset``: ``shape`` is of all rows and of one, ``first`` says whether rows vary fastest."""

    path: str
    name: str
    offset: int
    kind: str
    rows: int
    width: int
    first: bool
    start: int
    stop: int
    slope: float = 1.0
    inter: float = 0.0
    member: str = ""  # of a compressed archive, which is read from its start
    ids: Rows | None = None


def _npy_header(file, path: str) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = npy.read_magic(file)
    shape, fortran, kind = (npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0)(file)
    if kind.hasobject or kind.kind not in "biuf":
        raise ValueError(f"{path}: arrays of {kind} are not numbers")
    return shape, fortran, kind


def _array(path: str, name: str, file, offset: int, member: str = "") -> Rows:
    shape, fortran, kind = _npy_header(file, path)
    rows, width = (shape[0], prod(shape[1:])) if shape else (1, 1)
    return Rows(path, name, offset + file.tell() if not member else file.tell(), kind.str, rows, width, fortran and len(shape) > 1, 0, rows, member=member)


def _archived(path: str, file: pa.NativeFile) -> list[Rows]:
    """The arrays of an .npz file; those that are stored as they are have a place in it."""
    out = []
    with zipfile.ZipFile(file) as archive:
        for info in archive.infolist():
            name = info.filename.removesuffix(".npy")
            if info.compress_type == zipfile.ZIP_STORED:
                file.seek(info.header_offset + 26)
                lengths = struct.unpack("<HH", file.read(4))
                offset = info.header_offset + 30 + sum(lengths)
                file.seek(offset)
                head = io.BytesIO(file.read(min(info.file_size, 1 << 16)))
                out.append(_array(path, name, head, offset))
            else:
                with archive.open(info) as member:
                    head = io.BytesIO(member.read(1 << 16))
                out.append(_array(path, name, head, 0, info.filename))
    return out


#: Data types of NIfTI-1 images by their codes.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


def _image(path: str, head: bytes) -> Rows:
    """An uncompressed single-file NIfTI-1 image: voxels (first axis fastest) are rows, volumes their values."""
    order = "<" if struct.unpack("<i", head[:4])[0] == 348 else ">"
    if struct.unpack(f"{order}i", head[:4])[0] != 348 or head[344:348] != b"n+1\0":
        raise ValueError(f"{path} is no single-file NIfTI-1 image")
    dim = struct.unpack(f"{order}8h", head[40:56])
    code = struct.unpack(f"{order}h", head[70:72])[0]
    offset, slope, inter = struct.unpack(f"{order}3f", head[108:120])
    if code not in NIFTI_TYPES:
        raise ValueError(f"{path}: data type {code} is not supported")
    voxels, volumes = prod(dim[1:4][: dim[0]]), prod(dim[4 : dim[0] + 1])
    scaled = (slope, inter) if slope not in (0.0, 1.0) or inter else (1.0, 0.0)
    return Rows(path, "", int(offset), order + NIFTI_TYPES[code], voxels, volumes, True, 0, voxels, *scaled)


class ArraySource(DataSource):
    """path, name (of an array in an archive), row, node and x; option ``index`` names the array with the nodes of the rows (else they are null)."""

    @classmethod
    def name(cls) -> str:
        return "node_arrays"

    def schema(self) -> str:
        return "path string, name string, row long, node long, x array<double>"

    def reader(self, schema) -> DataSourceReader:
        return ArrayReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ArrayWriter(self.options, overwrite)


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.base, self.size, self.index = options["path"], int(options.get("rangebytes", RANGE_BYTES)), options.get("index", "")

    def partitions(self) -> list[Rows]:
        out = []
        for path, _ in found(self.base, (".npy", ".npz", ".nii")):
            with _open(self.base, path) as file:
                if path.endswith(".nii"):
                    arrays = [_image(path, file.read(352))]
                elif path.endswith(".npy"):
                    arrays = [_array(path, "", file, 0)]
                else:
                    arrays = _archived(path, file)
            ids = next((a for a in arrays if a.name == self.index), None) if self.index else None
            for a in arrays:
                if a is ids:
                    continue
                if ids and ids.rows != a.rows:
                    raise ValueError(f"{path}: {a.name} has {a.rows} rows, {ids.name} has {ids.rows}")
                step = a.rows if a.member else max(1, self.size // max(1, a.width * np.dtype(a.kind).itemsize))
                out += [Rows(**{**vars(a), "start": r, "stop": min(a.rows, r + step), "ids": ids}) for r in range(0, a.rows, max(1, step))]
        return out or [Rows("", "", 0, "f8", 0, 0, False, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        p = partition
        if p.start == p.stop:
            return
        with _open(self.base, p.path) as file:
            step = max(1, HELD_BYTES // max(1, 8 * p.width))
            whole = self._member(file, p) if p.member else None
            ids = self._member(file, p.ids) if p.ids and p.ids.member else None
            for r in range(p.start, p.stop, step):
                stop = min(p.stop, r + step)
                x = self._values(file, p, r, stop) if whole is None else self._next(whole, p, r, stop)
                node = None if not p.ids else (self._values(file, p.ids, r, stop) if ids is None else self._next(ids, p.ids, r, stop)).ravel().astype(np.int64)
                n = stop - r
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * p.width), pa.array(x.astype(float).ravel()))
                nodes = pa.nulls(n, pa.int64()) if node is None else pa.array(node)
                yield pa.RecordBatch.from_arrays([pa.array([p.path] * n), pa.array([p.name] * n), pa.array(np.arange(r, stop)), nodes, lists], ["path", "name", "row", "node", "x"])

    @staticmethod
    def _values(file: pa.NativeFile, p: Rows, start: int, stop: int) -> np.ndarray:
        kind, n = np.dtype(p.kind), stop - start
        if p.first:  # a stretch of each column
            parts = []
            for c in range(p.width):
                file.seek(p.offset + (c * p.rows + start) * kind.itemsize)
                parts.append(np.frombuffer(file.read(n * kind.itemsize), kind))
            x = np.stack(parts, axis=1)
        else:
            file.seek(p.offset + start * p.width * kind.itemsize)
            x = np.frombuffer(file.read(n * p.width * kind.itemsize), kind).reshape(n, p.width)
        return x if (p.slope, p.inter) == (1.0, 0.0) else x * p.slope + p.inter

    @staticmethod
    def _member(file: pa.NativeFile, p: Rows):
        """A compressed array, behind its header; one whose rows vary fastest is held whole."""
        member = zipfile.ZipFile(file).open(p.member)
        member.read(p.offset)
        if p.first:
            kind = np.dtype(p.kind)
            return np.frombuffer(member.read(p.rows * p.width * kind.itemsize), kind).reshape(p.width, p.rows).T
        return member

    @staticmethod
    def _next(member, p: Rows, start: int, stop: int) -> np.ndarray:
        kind = np.dtype(p.kind)
        return member[start:stop] if p.first else np.frombuffer(member.read((stop - start) * p.width * kind.itemsize), kind).reshape(stop - start, p.width)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class ArrayWriter(DataSourceWriter):
    """Rows (node, x) as .npz files with arrays ``node`` and ``x``, each of some megabytes; option ``compressed``."""

    def __init__(self, options: dict, overwrite: bool):
        self.base, self.overwrite = options["path"], overwrite
        self.compressed, self.size = options.get("compressed", "false") == "true", int(options.get("rangebytes", RANGE_BYTES))
        files, name = _place(self.base)
        if not overwrite and files.get_file_info(f"{name}/_SUCCESS").type == fs.FileType.File:
            raise ValueError(f"{self.base} has been written already")

    def write(self, iterator) -> Written:
        files, name = _place(self.base)
        files.create_dir(name, recursive=True)
        out, nodes, rows, held = [], [], [], 0

        def flush() -> None:
            part = uuid.uuid4().hex
            shown, hidden = f"{name}/part-{part}.npz", f"{name}/_part-{part}.npz"
            save = np.savez_compressed if self.compressed else np.savez
            save(buffer := io.BytesIO(), node=np.array(nodes, np.int64), x=np.array(rows, float))
            with files.open_output_stream(hidden) as sink:
                sink.write(buffer.getbuffer())
            out.append((hidden, shown))

        for row in iterator:
            if rows and (held + 8 * len(row.x) > self.size or len(row.x) != len(rows[0])):
                flush()
                nodes, rows, held = [], [], 0
            nodes.append(row.node)
            rows.append(row.x)
            held += 8 * len(row.x)
        if rows:
            flush()
        return Written(out)

    def commit(self, messages: list[Written | None]) -> None:
        files, name = _place(self.base)
        new = [pair for m in messages if m for pair in m.files]
        if self.overwrite:
            for path, _ in found(self.base, (".npz",)):
                files.delete_file(path)
        for hidden, shown in new:
            files.move(hidden, shown)
        files.create_dir(name, recursive=True)
        with files.open_output_stream(f"{name}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = _place(self.base)
        for hidden, _ in (pair for m in messages if m for pair in m.files):
            files.delete_file(hidden)


def read_rows(spark: SparkSession, path: str, index: str = "", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, name, row, node, x: the rows of all arrays and images below a path."""
    spark.dataSource.register(ArraySource)
    return spark.read.format("node_arrays").option("index", index).option("rangebytes", range_bytes).load(path)


def write_rows(rows: DataFrame, path: str, compressed: bool = False, overwrite: bool = False, range_bytes: int = RANGE_BYTES) -> None:
    """Nodes and their arrays as .npz files below a path, all of them or none."""
    rows.sparkSession.dataSource.register(ArraySource)
    plain = rows.select(F.col("node").cast("long").alias("node"), F.transform("x", lambda v: v.cast("double")).alias("x"))
    writer = plain.write.format("node_arrays").option("compressed", str(compressed).lower()).option("rangebytes", range_bytes)
    writer.mode("overwrite" if overwrite else "append").save(path)
