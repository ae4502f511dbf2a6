"""Volume files as a Spark data source: read by byte offset, a bar of bricks at a time, and written back brick by brick.

    spark.dataSource.register(VolumeSource)
    bricks = spark.read.format("volume").option("edge", 64).load("file:///scans/*.npy").where("bz between 3 and 5")
    bricks.write.format("volume").option("edge", 64).option("shape", "900,512,512").mode("append").save("file:///out/crop.npy")

A partition is a run of bars (one brick high and deep, as wide as the volume), so a task holds one bar whatever the
file's size. Comparisons of bz, by, bx and path are taken over by the source: bars outside are never read. The formats
are those whose voxels lie uncompressed in the file: .npy, .nrrd (raw), .nii and .raw (with shape and dtype given).
"""

from __future__ import annotations

import ast
import fnmatch
import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from .volumes import BRICKS

SUFFIXES = (".npy", ".nrrd", ".nii", ".raw")
#: Bytes of voxels that one partition reads, about.
PARTITION = 64 << 20
#: NIfTI-1 datatype codes and NRRD type names (fixed values of the formats).
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
NRRD_TYPES = {"uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "double": "f8"}


@dataclass(frozen=True)
class Layout:
    """Where a file's voxels lie: type, first byte, and the axes with their lengths from the slowest to the fastest."""

    dtype: str
    offset: int
    axes: str
    lengths: tuple[int, int, int]

    @property
    def shape(self) -> tuple[int, int, int]:
        return tuple(self.lengths[self.axes.index(a)] for a in "zyx")


def _three(lengths: tuple[int, ...]) -> tuple[int, int, int]:
    """Three axes from slow to fast: single ones of more are dropped, a plane gets one."""
    kept = tuple(int(n) for n in lengths)
    if len(kept) > 3:
        kept = tuple(n for n in kept if n != 1)
    kept = (1,) * (3 - len(kept)) + kept if len(kept) >= 2 else kept
    if len(kept) != 3:
        raise ValueError(f"a volume has three axes, not {tuple(lengths)}")
    return kept


def _npy(f) -> tuple[str, int, tuple[int, ...], bool]:
    start = f.read(8)
    wide = start[6] > 1
    size = struct.unpack("<I" if wide else "<H", f.read(4 if wide else 2))[0]
    head = ast.literal_eval(f.read(size).decode("utf-8" if start[6] > 2 else "latin1"))
    return head["descr"], len(start) + (4 if wide else 2) + size, head["shape"], head["fortran_order"]


def _nii(f) -> tuple[str, int, tuple[int, ...], bool]:
    head = f.read(348)
    order = "<" if struct.unpack("<i", head[:4])[0] == 348 else ">"
    dim = struct.unpack(f"{order}8h", head[40:56])
    code, offset = struct.unpack(f"{order}h", head[70:72])[0], struct.unpack(f"{order}f", head[108:112])[0]
    return order + NIFTI_TYPES[code], int(offset), dim[1 : dim[0] + 1][::-1], False


def _nrrd(f) -> tuple[str, int, tuple[int, ...], bool]:
    raw, at = b"", -1
    while at < 0:
        more = f.read(4096)
        if not more:
            raise ValueError("the header of an NRRD file has no end")
        raw += more
        at = raw.find(b"\n\n")
    said = dict(x.split(": ", 1) for x in raw[:at].decode("ascii", "replace").split("\n") if ": " in x and not x.startswith("#"))
    if said.get("encoding", "raw") != "raw" or "data file" in said:
        raise ValueError("only NRRD files that hold their voxels uncompressed can be read by offset")
    order = ">" if said.get("endian") == "big" else "<"
    return order + NRRD_TYPES[said["type"]], at + 2, tuple(map(int, said["sizes"].split()))[::-1], False


def layout(path: str, transposed: bool = False, shape: str | None = None, dtype: str = "<f4") -> Layout:
    """A file's layout from its header alone; `transposed` files hold x, y, z instead of z, y, x."""
    system, place = fs.FileSystem.from_uri(path)
    suffix = posixpath.splitext(place)[1].lower()
    if suffix == ".raw":
        if not shape:
            raise ValueError(f"{path}: a raw file needs its shape")
        kind, offset, lengths, reverse = dtype, 0, tuple(map(int, shape.split(","))), False
    elif suffix in SUFFIXES:
        with system.open_input_file(place) as f:
            kind, offset, lengths, reverse = {".npy": _npy, ".nii": _nii, ".nrrd": _nrrd}[suffix](f)
    else:
        raise ValueError(f"unknown volume format {suffix!r} ({path})")
    axes = "xyz" if transposed else "zyx"
    lengths = _three(tuple(lengths))
    found = Layout(np.dtype(kind).str, offset, axes[::-1] if reverse else axes, lengths[::-1] if reverse else lengths)
    have = fs.FileSystem.from_uri(path)[0].get_file_info(place).size
    if have < offset + np.dtype(kind).itemsize * int(np.prod(lengths, dtype=np.int64)):
        raise ValueError(f"{path}: the file is shorter than its header says")
    return found


def volume_paths(path: str) -> list[str]:
    """The files of a path, a folder (its volumes) or a pattern in the last part, sorted by name."""
    uri = path if "://" in path else f"file://{path}"
    head, _, name = uri.rpartition("/")
    many = any(c in name for c in "*?[")
    system, place = fs.FileSystem.from_uri(head if many else uri)
    info = system.get_file_info(place)
    if not many and info.type == fs.FileType.File:
        return [uri]
    if info.type != fs.FileType.Directory:
        raise FileNotFoundError(f"no volume at {path}")
    top = head if many else uri.rstrip("/")
    names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(place)) if f.type == fs.FileType.File)
    found = [f"{top}/{n}" for n in names if (fnmatch.fnmatch(n, name) if many else posixpath.splitext(n)[1].lower() in SUFFIXES)]
    if not found:
        raise FileNotFoundError(f"no volume at {path}")
    return found


@dataclass
class Bars(InputPartition):
    """Bars `first` to `last` of a file: bar k is block (k // blocks of the middle axis, k % those) of the two slow axes."""

    path: str
    layout: Layout
    first: int
    last: int
    ranges: dict[str, tuple[int, int]] = field(default_factory=dict)


_SCHEMA = pa.schema([("path", pa.string()), *[(c, pa.int32()) for c in ("bz", "by", "bx", "nz", "ny", "nx")], ("data", pa.binary())])


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}
        self.edge = int(self.options.get("edge", "64"))
        self.ranges: dict[str, tuple[int, int]] = {}
        self.paths: set[str] | None = None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name, value = f.attribute[0], getattr(f, "value", None)
            if name in ("bz", "by", "bx") and isinstance(value, int) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                low = value if isinstance(f, (EqualTo, GreaterThanOrEqual)) else value + 1 if isinstance(f, GreaterThan) else 0
                high = value if isinstance(f, (EqualTo, LessThanOrEqual)) else value - 1 if isinstance(f, LessThan) else 1 << 31
                a, b = self.ranges.get(name, (0, 1 << 31))
                self.ranges[name] = max(a, low), min(b, high)
            elif name == "path" and isinstance(f, (EqualTo, In)):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = named if self.paths is None else self.paths & named
            else:
                yield f

    def _range(self, axis: str, blocks: int) -> range:
        a, b = self.ranges.get(f"b{axis}", (0, blocks))
        return range(max(a, 0), min(b + 1, blocks))

    def partitions(self):
        out = []
        for path in volume_paths(self.options["path"]):
            if self.paths is not None and path not in self.paths:
                continue
            lay = layout(path, self.options.get("transposed", "false") == "true", self.options.get("shape"), self.options.get("dtype", "<f4"))
            slow, middle = (-(-n // self.edge) for n in lay.lengths[:2])
            bar = np.dtype(lay.dtype).itemsize * min(self.edge, lay.lengths[0]) * min(self.edge, lay.lengths[1]) * lay.lengths[2]
            each = max(1, int(self.options.get("partitionbytes", PARTITION)) // max(1, bar))
            wanted = [s * middle + m for s in self._range(lay.axes[0], slow) for m in self._range(lay.axes[1], middle)]
            while wanted:
                run = 1
                while run < min(each, len(wanted)) and wanted[run] == wanted[0] + run:
                    run += 1
                out.append(Bars(path, lay, wanted[0], wanted[run - 1], self.ranges))
                wanted = wanted[run:]
        return out or [Bars("", Layout("<f4", 0, "zyx", (0, 0, 0)), 0, -1)]

    def read(self, partition: Bars) -> Iterator[pa.RecordBatch]:
        if partition.last < partition.first:
            return
        lay, edge = partition.layout, self.edge
        _, m_all, f_all = lay.lengths
        kind = np.dtype(lay.dtype)
        middle = -(-m_all // edge)
        across = self._range(lay.axes[2], -(-f_all // edge))
        system, place = fs.FileSystem.from_uri(partition.path)
        with system.open_input_file(place) as f:
            for bar in range(partition.first, partition.last + 1):
                s, m = divmod(bar, middle)
                planes = range(s * edge, min((s + 1) * edge, lay.lengths[0]))
                rows = min((m + 1) * edge, m_all) - m * edge
                held = np.empty((len(planes), rows, f_all), "<f4")
                for k, p in enumerate(planes):
                    f.seek(lay.offset + kind.itemsize * (p * m_all + m * edge) * f_all)
                    held[k] = np.frombuffer(f.read(kind.itemsize * rows * f_all), kind).reshape(rows, f_all)
                out = {n: [] for n in _SCHEMA.names}
                for b in across:
                    part = held[:, :, b * edge : (b + 1) * edge].transpose([lay.axes.index(a) for a in "zyx"])
                    at = dict(zip(lay.axes, (s, m, b)))
                    for n, v in zip(_SCHEMA.names, (partition.path, at["z"], at["y"], at["x"], *part.shape, np.ascontiguousarray(part).tobytes())):
                        out[n].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=_SCHEMA)


@dataclass
class Written(WriterCommitMessage):
    voxels: int


def _header(suffix: str, kind: np.dtype, shape: tuple[int, int, int]) -> bytes:
    if suffix == ".npy":
        said = repr({"descr": kind.str, "fortran_order": False, "shape": shape})
        said += " " * (-(len(said) + 11) % 64) + "\n"
        return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(said)) + said.encode("latin1")
    if suffix == ".nrrd":
        name = next(k for k, v in NRRD_TYPES.items() if v == kind.str[1:])
        return f"NRRD0004\ntype: {name}\ndimension: 3\nsizes: {shape[2]} {shape[1]} {shape[0]}\nendian: little\nencoding: raw\n\n".encode()
    if suffix == ".nii":
        head = bytearray(352)
        code = next(k for k, v in NIFTI_TYPES.items() if v == kind.str[1:])
        struct.pack_into("<i", head, 0, 348)
        struct.pack_into("<8h", head, 40, 3, shape[2], shape[1], shape[0], 1, 1, 1, 1)
        struct.pack_into("<hh", head, 70, code, 8 * kind.itemsize)
        struct.pack_into("<8f", head, 76, 1, 1, 1, 1, 0, 0, 0, 0)
        struct.pack_into("<f", head, 108, 352.0)
        head[344:348] = b"n+1\0"
        return bytes(head)
    if suffix == ".raw":
        return b""
    raise ValueError(f"a volume can't be written as {suffix!r}; choose one of {', '.join(SUFFIXES)}")


class VolumeWriter(DataSourceWriter):
    """Bricks go to their places in a hidden file beside the target, which takes its name once every voxel is there.

    A brick written twice (a task that ran again) leaves the same bytes. Tasks write into one file, so the target must lie
    on a file system that driver and executors share and that allows writes at an offset.
    """

    def __init__(self, options: dict[str, str], overwrite: bool):
        uri = options["path"] if "://" in options["path"] else f"file://{options['path']}"
        if not uri.startswith("file://"):
            raise ValueError("volumes are written in place, which needs a shared file system (file://)")
        self.target, self.edge = uri.removeprefix("file://"), int(options.get("edge", "64"))
        if not options.get("shape"):
            raise ValueError("say the volume's shape: option('shape', 'nz,ny,nx')")
        self.shape = tuple(int(n) for n in options["shape"].split(","))
        self.kind = np.dtype(options.get("dtype", "<f4")).newbyteorder("<")
        self.fill = float(options["fill"]) if "fill" in options else None
        self.head = _header(posixpath.splitext(self.target)[1].lower(), self.kind, self.shape)
        self.overwrite = overwrite
        self.hidden = posixpath.join(posixpath.dirname(self.target), f".{posixpath.basename(self.target)}-{uuid.uuid4().hex}")
        system = fs.LocalFileSystem()
        if not overwrite and system.get_file_info(self.target).type != fs.FileType.NotFound:
            raise FileExistsError(f"{self.target} exists")
        system.create_dir(posixpath.dirname(self.target), recursive=True)
        with open(self.hidden, "wb") as f:
            f.write(self.head)
            f.truncate(len(self.head) + self.kind.itemsize * int(np.prod(self.shape, dtype=np.int64)))
        if self.fill:  # 0 is what a new file holds
            held = self._open()
            for plane in held:
                plane[:] = self.fill
            held.flush()

    def _open(self) -> np.memmap:
        return np.memmap(self.hidden, self.kind, "r+", len(self.head), self.shape)

    def write(self, iterator) -> Written:
        held, n, seen = self._open(), 0, set()
        for r in iterator:
            at = tuple(slice(b * self.edge, b * self.edge + k) for b, k in zip((r.bz, r.by, r.bx), (r.nz, r.ny, r.nx)))
            if any(a.stop > n_ or min(self.edge, n_ - a.start) != k for a, n_, k in zip(at, self.shape, (r.nz, r.ny, r.nx))):
                raise ValueError(f"brick {r.bz}, {r.by}, {r.bx} of {r.nz} x {r.ny} x {r.nx} voxels doesn't fit a volume of {self.shape}")
            values = np.frombuffer(r.data, "<f4").reshape(r.nz, r.ny, r.nx)
            held[at] = values if self.kind.kind == "f" else np.rint(values)
            n += 0 if (r.bz, r.by, r.bx) in seen else values.size
            seen.add((r.bz, r.by, r.bx))
        held.flush()
        return Written(n)

    def commit(self, messages) -> None:
        n, whole = sum(m.voxels for m in messages if m), int(np.prod(self.shape, dtype=np.int64))
        if n > whole or n < whole and self.fill is None:
            self.abort(messages)
            raise ValueError(f"{n} voxels came for a volume of {whole}; option('fill', ...) allows missing ones")
        fs.LocalFileSystem().move(self.hidden, self.target)

    def abort(self, messages) -> None:
        system = fs.LocalFileSystem()
        if system.get_file_info(self.hidden).type != fs.FileType.NotFound:
            system.delete_file(self.hidden)


class VolumeSource(DataSource):
    """Options: path, edge, transposed, shape and dtype (raw files and writing), fill (writing), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "volume"

    def schema(self) -> str:
        return BRICKS

    def reader(self, schema) -> VolumeReader:
        return VolumeReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> VolumeWriter:
        return VolumeWriter(dict(self.options), overwrite)


def open_volumes(spark: SparkSession, path: str, edge: int = 64, **options: str) -> DataFrame:
    """Bricks (path, bz, by, bx, nz, ny, nx, data) of volume files; filters on brick positions decide what is read."""
    spark.dataSource.register(VolumeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("volume").options(edge=str(edge), **options).load(path)


def save_volume(bricks: DataFrame, path: str, shape: tuple[int, int, int], edge: int = 64, overwrite: bool = False, **options: str) -> None:
    """Write a volume's bricks as one file; the suffix says the format."""
    bricks.sparkSession.dataSource.register(VolumeSource)
    w = bricks.select(*[c.split()[0] for c in BRICKS.split(", ")]).write.format("volume").options(edge=str(edge), shape=",".join(map(str, shape)), **options)
    w.mode("overwrite" if overwrite else "append").save(path)
