"""Spark data sources for zip archives of arrays: mask shards and centroid tracks.

``mask_archive`` and ``centroid_archive`` read and write ``.npz`` files member by member; ``named_text``
writes text files whose names matter, and ``text_bundle`` writes and reads such files as members of zip
archives, so that a million small texts need not be a million files. A reader's
partition is a byte range of a file, as with other splittable formats: the driver lists files and
sizes only, and the task that holds a range reads the archive's directory and takes the members that
begin inside it. No archive is ever one row, and a member that a filter on frame or object excludes is
not read. With ``keys_only`` nothing but directories is read.

A writer's task streams rows that are grouped by archive into files below a temporary folder of the
target; they are moved to their places when all tasks have succeeded, and removed if one has not.
Folders may be local, or any file system Arrow can open by its address.
"""

from __future__ import annotations

import contextlib
import fnmatch
import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

# Member names of mask and centroid archives.
MASK_KEY = re.compile(r"^frame(\d+)_obj(\d+)_mask_(packed|shape|gap)$")
CENTROID_KEY = re.compile(r"^centroids_obj(\d+)$")
MASK_MEMBER = "frame{frame:07d}_obj{obj}_mask_{part}"
CENTROID_MEMBER = "centroids_obj{obj}"

#: Bytes of archive one task reads, and archives one task lists.
SPLIT_BYTES = 64 << 20
FILES_PER_TASK = 256
#: Characters of text in a batch, about.
BATCH_CHARS = 16 << 20
TEMPORARY = "_temporary-"

KEYS = pa.schema([("path", pa.string()), ("frame_id", pa.int64()), ("obj_id", pa.int32())])
MASKS = pa.schema([*KEYS, ("h", pa.int32()), ("w", pa.int32()), ("packed", pa.binary()), ("is_gap", pa.bool_())])
CENTROIDS = pa.schema([("path", pa.string()), ("obj_id", pa.int32()), ("frame_id", pa.int64()), ("x", pa.float64()), ("y", pa.float64())])
TEXTS = pa.schema([("path", pa.string()), ("value", pa.string())])
_TYPES = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.binary(): "binary", pa.bool_(): "boolean"}


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*:/", path):
        return arrow_fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return arrow_fs.LocalFileSystem(), path


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_TYPES[f.type]}" for f in schema)


@dataclass
class Slices(InputPartition):
    """(file, first byte, byte after) of the members a task reads."""

    parts: list[tuple[str, int, int]]


class Wanted:
    """Bounds on whole-number columns, from options or pushed filters; every condition is checked exactly."""

    def __init__(self):
        self.least: dict[str, int] = {}
        self.most: dict[str, int] = {}
        self.among: dict[str, set] = {}

    def take(self, column: str, kind: type, value) -> bool:
        values = value if kind is In else [value]
        if not all(isinstance(v, int) and not isinstance(v, bool) for v in values):
            return False
        if kind in (EqualTo, In):
            self.among[column] = self.among.get(column, set(values)) & set(values)
        elif kind in (GreaterThan, GreaterThanOrEqual):
            self.least[column] = max(self.least.get(column, value), value + (kind is GreaterThan))
        else:
            self.most[column] = min(self.most.get(column, value), value - (kind is LessThan))
        return True

    def __call__(self, column: str, value: int) -> bool:
        return (
            value >= self.least.get(column, value)
            and value <= self.most.get(column, value)
            and (column not in self.among or value in self.among[column])
        )


class ArchiveReader(DataSourceReader):
    """Members of archives by byte range; subclasses say what a member's rows are."""

    pattern, numbers = "*.npz", ("frame_id", "obj_id")

    def __init__(self, options):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.keys_only = str(options.get("keysOnly", "false")).lower() == "true"
        self.wanted = Wanted()

    def pushFilters(self, filters):
        for one in filters:
            kind = type(one)
            known = kind in (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
            if not (known and one.attribute in [(c,) for c in self.numbers] and self.wanted.take(one.attribute[0], kind, one.value)):
                yield one

    def partitions(self) -> Sequence[Slices]:
        out, size = [Slices([])], 0
        limit = FILES_PER_TASK if self.keys_only else self.split
        for root in self.paths:
            system, place = opened(root)
            info = system.get_file_info(place)
            found = [info] if info.is_file else system.get_file_info(arrow_fs.FileSelector(place, recursive=True))
            for file in sorted(found, key=lambda f: f.path):
                if not file.is_file or TEMPORARY in file.path or not fnmatch.fnmatch(file.base_name, self.pattern):
                    continue
                name = file.path if isinstance(system, arrow_fs.LocalFileSystem) else f"{root.rstrip('/')}{file.path.removeprefix(place.rstrip('/'))}"
                pieces = 1 if self.keys_only else max(1, -(-file.size // self.split))
                for k in range(pieces):
                    weight = 1 if self.keys_only else file.size // pieces
                    if out[-1].parts and size + weight > limit:
                        out.append(Slices([]))
                        size = 0
                    out[-1].parts.append((name, file.size * k // pieces, file.size * (k + 1) // pieces))
                    size += weight
        return out

    def read(self, partition: Slices) -> Iterator[pa.RecordBatch]:
        for name, begin, end in partition.parts:
            system, place = opened(name)
            with system.open_input_file(place) as file, zipfile.ZipFile(file) as archive:
                inside = [m for m in archive.infolist() if begin <= m.header_offset < end]
                yield from self.rows(name, archive, inside)

    def rows(self, name: str, archive: zipfile.ZipFile, members: list[zipfile.ZipInfo]) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


def _array(archive: zipfile.ZipFile, member: str) -> np.ndarray:
    with archive.open(member) as stream:
        return np.lib.format.read_array(stream)


class MaskReader(ArchiveReader):
    pattern = "shard_*.npz"

    def rows(self, name, archive, members):
        hits = [(m, MASK_KEY.match(m.filename.removesuffix(".npy"))) for m in members]
        keys = [(m, int(k[1]), int(k[2])) for m, k in hits if k and k[3] == "packed"]
        keys = [(m, f, o) for m, f, o in keys if self.wanted("frame_id", f) and self.wanted("obj_id", o)]
        if self.keys_only:
            for a in range(0, len(keys), 10_000):
                part = keys[a : a + 10_000]
                yield pa.record_batch([pa.array([name] * len(part)), pa.array([k[1] for k in part]), pa.array([k[2] for k in part], pa.int32())], schema=KEYS)
            return
        present = set(archive.namelist())
        for a in range(0, len(keys), 64):  # masks are large: small batches
            rows = []
            for member, frame, obj in keys[a : a + 64]:
                stem = member.filename.removesuffix("packed.npy")
                h, w = (int(v) for v in _array(archive, f"{stem}shape.npy"))
                gap = f"{stem}gap.npy" in present and bool(_array(archive, f"{stem}gap.npy").ravel()[0])
                rows.append((name, frame, obj, h, w, _array(archive, member.filename).tobytes(), gap))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), MASKS, strict=True)], schema=MASKS)


class CentroidReader(ArchiveReader):
    pattern, block = "centroids.npz", 100_000

    def rows(self, name, archive, members):
        for member in members:
            key = CENTROID_KEY.match(member.filename.removesuffix(".npy"))
            if not key or not self.wanted("obj_id", int(key[1])):
                continue
            with archive.open(member) as stream:
                for part in self._blocks(stream):
                    frame = np.rint(part[:, 0]).astype(np.int64)
                    take = np.array([self.wanted("frame_id", int(f)) for f in frame], bool) if self.wanted.__dict__ != Wanted().__dict__ else np.ones(len(frame), bool)
                    part, frame = part[take], frame[take]
                    if len(part):
                        yield pa.record_batch([pa.array([name] * len(part)), pa.array(np.full(len(part), int(key[1]), np.int32)), frame, part[:, 1], part[:, 2]], schema=CENTROIDS)

    def _blocks(self, stream) -> Iterator[np.ndarray]:
        """A (frames, 3) array in blocks of rows; one stored by columns comes whole."""
        version = np.lib.format.read_magic(stream)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, by_column, kind = read(stream)
        if len(shape) != 2 or not shape[0]:
            return
        if by_column:
            raw = np.frombuffer(stream.read(), kind)
            yield raw.reshape(shape, order="F").astype(np.float64)
            return
        width = shape[1] * kind.itemsize
        while raw := stream.read(self.block * width):
            yield np.frombuffer(raw, kind).reshape(-1, shape[1]).astype(np.float64)


@dataclass
class Written(WriterCommitMessage):
    """(temporary, final) paths of a task's archives."""

    files: list[tuple[str, str]]


class GroupedWriter(DataSourceArrowWriter):
    """Rows that come together by ``archive`` (a path below the folder) go to one file each, as they come."""

    def __init__(self, options, overwrite: bool):
        self.root = options["path"].rstrip("/")
        self.overwrite = overwrite
        self.temporary = f"{self.root}/{TEMPORARY}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, place = opened(f"{self.temporary}/{uuid.uuid4().hex}")
        done, open_now = [], None
        with contextlib.ExitStack() as held:
            for batch in iterator:
                names = np.array(batch["archive"].to_pylist(), dtype=object)
                edges = np.append(np.flatnonzero(np.append(True, names[1:] != names[:-1])), len(names)) if len(names) else []
                for a, b in zip(edges, edges[1:], strict=False):
                    if names[a] != open_now:
                        held.close()  # the archive before is complete
                        open_now = names[a]
                        if open_now in {final for _, final in done}:
                            raise ValueError(f"rows of {open_now} are not together: group the input by archive")
                        path = f"{place}/{len(done)}.npz"
                        system.create_dir(place, recursive=True)
                        done.append((path, open_now))
                        state = self.begin(held, held.enter_context(system.open_output_stream(path)))
                    self.add(state, batch.slice(a, b - a))
        return Written(done)

    def begin(self, held: contextlib.ExitStack, sink: pa.NativeFile):
        """What :meth:`add` needs to know of a file just opened; ``held`` closes it."""
        return held.enter_context(zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED))

    def add(self, state, rows: pa.RecordBatch) -> None:
        raise NotImplementedError

    def commit(self, messages) -> None:
        system, root = opened(self.root)
        files = [pair for m in messages if m is not None for pair in m.files]
        twice = len(files) - len({final for _, final in files})
        if twice:
            self.abort(messages)
            raise ValueError(f"{twice} archives were written by more than one task: repartition by archive")
        there = [] if self.overwrite else [i.path for i in system.get_file_info([f"{root}/{final}" for _, final in files]) if i.is_file]
        if there:
            self.abort(messages)
            raise ValueError(f"{len(there)} archives exist, {there[0]} the first")
        if self.overwrite:
            for old in system.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True)):
                if TEMPORARY not in old.path:
                    (system.delete_file if old.is_file else system.delete_dir)(old.path)
        for folder in sorted({f"{root}/{final}".rsplit("/", 1)[0] for _, final in files}):
            system.create_dir(folder, recursive=True)
        for temporary, final in files:
            system.move(temporary, f"{root}/{final}")
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        system, place = opened(self.temporary)
        if system.get_file_info(place).type != arrow_fs.FileType.NotFound:
            system.delete_dir(place)


def _put(archive: zipfile.ZipFile, member: str, value: np.ndarray) -> None:
    with archive.open(f"{member}.npy", "w") as stream:
        np.lib.format.write_array(stream, value)


class MaskWriter(GroupedWriter):
    def add(self, archive, rows):
        gaps = rows["is_gap"].to_pylist() if "is_gap" in rows.schema.names else [False] * rows.num_rows
        columns = [rows[c].to_pylist() for c in ("frame_id", "obj_id", "h", "w", "packed")]
        for frame, obj, h, w, packed, gap in zip(*columns, gaps, strict=True):
            name = lambda part: MASK_MEMBER.format(frame=frame, obj=obj, part=part)  # noqa: B023, E731
            _put(archive, name("packed"), np.frombuffer(packed, np.uint8))
            _put(archive, name("shape"), np.array([h, w]))
            if gap:
                _put(archive, name("gap"), np.ones(1, np.uint8))


class CentroidWriter(GroupedWriter):
    """Rows of an object come together and say in ``n`` how many they are: its array is written as they come."""

    def begin(self, held, sink):
        return {"obj": None, "archive": super().begin(held, sink), "held": held.enter_context(contextlib.ExitStack())}

    def add(self, state, rows):
        obj = rows["obj_id"].to_numpy()
        values = np.stack([rows[c].to_numpy().astype(np.float64) for c in ("frame_id", "x", "y")], axis=1)
        edges = np.append(np.flatnonzero(np.append(True, obj[1:] != obj[:-1])), len(obj))
        for a, b in zip(edges, edges[1:], strict=False):
            if obj[a] != state["obj"]:
                state["held"].close()
                state["obj"] = obj[a]
                state["to"] = state["held"].enter_context(state["archive"].open(f"{CENTROID_MEMBER.format(obj=obj[a])}.npy", "w", force_zip64=True))
                header = {"descr": "<f8", "fortran_order": False, "shape": (int(rows["n"][a].as_py()), 3)}
                np.lib.format.write_array_header_1_0(state["to"], header)
            state["to"].write(np.ascontiguousarray(values[a:b]).tobytes())


class LineWriter(GroupedWriter):
    """Lines (``value``) of text files with given names; the option ``header`` goes before the first of each."""

    def __init__(self, options, overwrite: bool):
        super().__init__(options, overwrite)
        self.header = options.get("header")

    def begin(self, held, sink):
        if self.header is not None:
            sink.write(f"{self.header}\n".encode())
        return sink

    def add(self, sink, rows):
        sink.write("".join(f"{line}\n" for line in rows["value"].to_pylist()).encode())


class BundleReader(ArchiveReader):
    """Members of ``bundle-*.zip`` as text: whole, or line by line."""

    pattern, numbers = "bundle-*.zip", ()

    def __init__(self, options):
        super().__init__(options)
        self.lines = str(options.get("lines", "false")).lower() == "true"
        self.glob = options.get("glob", "*")

    def _texts(self, archive, member) -> Iterator[str]:
        with archive.open(member) as stream:
            if self.lines:
                for line in io.TextIOWrapper(stream, "utf-8", newline="\n"):
                    yield line.removesuffix("\n")
            else:
                yield stream.read().decode()

    def rows(self, name, archive, members):
        paths, values, size = [], [], 0
        for member in members:
            if not fnmatch.fnmatch(member.filename.rsplit("/", 1)[-1], self.glob):
                continue
            for text in self._texts(archive, member):
                paths.append(f"{name}/{member.filename}")
                values.append(text)
                size += len(text)
                if len(paths) == 10_000 or size > BATCH_CHARS:
                    yield pa.record_batch([pa.array(paths), pa.array(values)], schema=TEXTS)
                    paths, values, size = [], [], 0
        if paths:
            yield pa.record_batch([pa.array(paths), pa.array(values)], schema=TEXTS)


class BundleWriter(GroupedWriter):
    """Lines (``value``) that come together by ``member`` to members of their archive."""

    def begin(self, held, sink):
        return {"member": None, "archive": super().begin(held, sink), "held": held.enter_context(contextlib.ExitStack())}

    def add(self, state, rows):
        names = np.array(rows["member"].to_pylist(), dtype=object)
        values = rows["value"].to_pylist()
        edges = np.append(np.flatnonzero(np.append(True, names[1:] != names[:-1])), len(names))
        for a, b in zip(edges, edges[1:], strict=False):
            if names[a] != state["member"]:
                state["held"].close()
                state["member"] = names[a]
                state["to"] = state["held"].enter_context(state["archive"].open(names[a], "w", force_zip64=True))
            state["to"].write("".join(f"{line}\n" for line in values[a:b]).encode())


class TextBundle(DataSource):
    """``spark.read.format("text_bundle")``: (path, value); options path or paths, splitBytes, glob of the members' names, lines.

    Written from rows that come together by ``archive`` and within it by ``member``.
    """

    @classmethod
    def name(cls) -> str:
        return "text_bundle"

    def schema(self) -> str:
        return _ddl(TEXTS)

    def reader(self, schema):
        return BundleReader(self.options)

    def writer(self, schema, overwrite):
        return BundleWriter(self.options, overwrite)


class MaskArchive(DataSource):
    """``spark.read.format("mask_archive")``: options path or paths (JSON list), splitBytes, keysOnly."""

    @classmethod
    def name(cls) -> str:
        return "mask_archive"

    def schema(self) -> str:
        return _ddl(KEYS if str(self.options.get("keysOnly", "false")).lower() == "true" else MASKS)

    def reader(self, schema):
        return MaskReader(self.options)

    def writer(self, schema, overwrite):
        return MaskWriter(self.options, overwrite)


class CentroidArchive(DataSource):
    """``spark.read.format("centroid_archive")``: options as for masks, without keysOnly."""

    @classmethod
    def name(cls) -> str:
        return "centroid_archive"

    def schema(self) -> str:
        return _ddl(CENTROIDS)

    def reader(self, schema):
        return CentroidReader(self.options)

    def writer(self, schema, overwrite):
        return CentroidWriter(self.options, overwrite)


class NamedText(DataSource):
    """Write only: lines to text files whose names the rows give in ``archive``."""

    @classmethod
    def name(cls) -> str:
        return "named_text"

    def writer(self, schema, overwrite):
        return LineWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """The formats in this session, with filters pushed to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (MaskArchive, CentroidArchive, NamedText, TextBundle):
        spark.dataSource.register(source)


def read_archives(spark: SparkSession, name: str, path: str | Sequence[str], **options) -> DataFrame:
    register(spark)
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.format(name).option("paths", json.dumps(paths)).options(**options).load()
