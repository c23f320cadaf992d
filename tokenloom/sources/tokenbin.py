"""``tokenbin``: flat little-endian 16-bit token files as a Spark data source.

Register with ``spark.dataSource.register(TokenBinSource)``. Files are read in the order of their numbers; a
partition is a byte range on an even offset. Writing expects each shard's fragments in one task and
in order (``shards.write_token_bins`` arranges that).

An export commits in two phases. Tasks write files under names of their own. The commit then puts
one list of all files in place (``_commit.json``), moves each file to its name, deletes what the list
does not name, and makes the list the manifest (``_manifest.json``). Readers follow the newest list:
before it is put in place they read the export before it, and after that the new one, even where the
moves were cut short. Sizes, and so positions, come from the list; a file of another size is an
error, and files that it does not name are not read. The next export finishes the moves and sweeps
files that failed tasks or runs left behind. One export at a time may write to a path. Folders
without a list are read as they are.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

# File names and the id type of the format.
TRAIN_DIR = "train_shards"
TRAIN_NAME = "train_shards/shard_{:05d}.bin"
VAL_NAME = "val.bin"
ID_TYPE = np.dtype("<u2")
MAX_ID = 65_535
# The list of an export that is being put in place, and of one that is.
COMMIT, MANIFEST = "_commit.json", "_manifest.json"

READ_SCHEMA = "file string, start long, end long, tokens array<int>"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that a path names. A bare path is a local one; writers spell out the default
    file system of the cluster before a path comes here.
    """
    scheme = re.match(r"([a-z0-9]+):/", path)
    if not scheme:
        return fs.LocalFileSystem(), path
    if scheme[1] == "file":
        return fs.LocalFileSystem(), path.removeprefix("file:").replace("///", "/", 1)
    # Hadoop's names of a store that has one name elsewhere.
    if scheme[1] in ("s3a", "s3n"):
        path = "s3" + path[len(scheme[1]) :]
    return fs.FileSystem.from_uri(path)


@dataclass
class BinFile:
    """A file of an export: its name below the root, where it is now, and its bytes."""

    name: str
    path: str
    size: int


def _exists(system: fs.FileSystem, path: str) -> bool:
    return system.get_file_info(path).type == fs.FileType.File


def _present(system: fs.FileSystem, root: str) -> dict[str, BinFile]:
    """Files of an export's two folders by their name below its root."""
    found = {}
    for folder in ("", TRAIN_DIR):
        at = fs.FileSelector(posixpath.join(root, folder).rstrip("/"), allow_not_found=True)
        for info in system.get_file_info(at):
            if info.type == fs.FileType.File:
                name = posixpath.join(folder, posixpath.basename(info.path))
                found[name] = BinFile(name, info.path, info.size)
    return found


def _read_list(system: fs.FileSystem, root: str) -> list[BinFile] | None:
    """Files of the newest export under ``root``, each where it is now; None without a list."""
    for listed in (COMMIT, MANIFEST):
        if not _exists(system, posixpath.join(root, listed)):
            continue
        with system.open_input_file(posixpath.join(root, listed)) as file:
            entries = json.loads(file.read())
        here = _present(system, root)
        found = []
        for name, temporary, size in entries:
            now = here.get(temporary) or here.get(name)
            if now is None or now.size != size:
                raise ValueError(f"{name} is not the file of {size} bytes that {listed} names")
            found.append(BinFile(name, now.path, size))
        return found
    return None


def _replace(system: fs.FileSystem, source: str, target: str) -> None:
    """Move a file, also where the file system does not move onto an existing one."""
    if _exists(system, target):
        system.delete_file(target)
    system.move(source, target)


def _places(given: str) -> Iterator[tuple[str, str]]:
    """Roots whose list may name what is at a path, and the path below each."""
    yield given, ""
    head, tail = posixpath.split(given)
    if tail in (TRAIN_DIR, VAL_NAME):
        yield head, tail
    if posixpath.basename(head) == TRAIN_DIR:
        yield posixpath.dirname(head), posixpath.join(TRAIN_DIR, tail)


def _bin_files(path: str) -> list[BinFile]:
    """The files to read at a path: an export, one of its folders, one of its files, or files that
    belong to no export.
    """
    system, given = _open(path)
    given = given.rstrip("/")
    for root, below in _places(given):
        listed = _read_list(system, root)
        if listed is not None:
            inside = [f for f in listed if below in (f.name, posixpath.dirname(f.name))]
            return sorted(inside, key=lambda f: file_order(f.name))
    info = system.get_file_info(given)
    if info.type == fs.FileType.File:
        return [BinFile(posixpath.basename(given), info.path, info.size)]
    found = system.get_file_info(fs.FileSelector(given, allow_not_found=True))
    bins = [BinFile(posixpath.basename(f.path), f.path, f.size) for f in found]
    return sorted((f for f in bins if f.name.endswith(".bin")), key=lambda f: file_order(f.name))


def file_order(path: str) -> tuple[str, int, str]:
    """Files of a folder by the number that ends their name, which text order breaks beyond five
    digits; names without a number come first.
    """
    folder, name = posixpath.split(path)
    digits = re.search(r"(\d+)\.bin$", name)
    return folder, int(digits[1]) if digits else -1, name


@dataclass
class ByteRanges(InputPartition):
    """File pieces ``(file, low, high, base)`` in stream order: bytes ``[low, high)`` of a file
    whose first id stands at stream position ``base``.
    """

    pieces: list[tuple[BinFile, int, int, int]]


class TokenBinReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.row_tokens = int(options.get("rowTokens", 65_536))
        self.partition_tokens = int(options.get("partitionTokens", 16_777_216))
        if self.row_tokens <= 0 or self.partition_tokens <= 0:
            raise ValueError("rowTokens and partitionTokens must be positive")

    def partitions(self) -> list[ByteRanges]:
        """Large files are cut and small ones put together, to ``partitionTokens`` per task."""
        files = _bin_files(self.path)
        if not files:
            raise FileNotFoundError(f"no .bin files in {self.path}")
        parts: list[ByteRanges] = []
        base, room = 0, 0
        for info in files:
            low, size = 0, info.size // 2 * 2
            while low < size:
                if room == 0:
                    parts.append(ByteRanges([]))
                    room = 2 * self.partition_tokens
                high = min(low + room, size)
                parts[-1].pieces.append((info, low, high, base))
                room -= high - low
                low = high
            base += size // 2
        return parts

    def read(self, part: ByteRanges) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        for info, low, high, base in part.pieces:
            name = posixpath.basename(info.name)
            # A commit may have moved the file since its place was looked up.
            here = info.path if _exists(system, info.path) else self._final(info)
            with system.open_input_file(here) as file:
                yield from self._rows(file, name, low, high, base)

    @staticmethod
    def _final(info: BinFile) -> str:
        return posixpath.join(posixpath.dirname(info.path), posixpath.basename(info.name))

    def _rows(self, file, name: str, low: int, high: int, base: int) -> Iterator[pa.RecordBatch]:
        for at in range(low, high, 2 * self.row_tokens):
            raw = file.read_at(min(2 * self.row_tokens, high - at), at)
            ids = np.frombuffer(raw, ID_TYPE).astype(np.int32)
            start = base + at // 2
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name]),
                    pa.array([start], pa.int64()),
                    pa.array([start + len(ids)], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                ],
                names=["file", "start", "end", "tokens"],
            )


@dataclass
class WrittenFiles(WriterCommitMessage):
    """Files of one task: the name each is to have, its name now, and its bytes."""

    files: list[tuple[str, str, int]]


class TokenBinWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path = options["path"]
        self.overwrite = overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> WrittenFiles:
        system, root = _open(self.path)
        system.create_dir(posixpath.join(root, TRAIN_DIR), recursive=True)
        files: list[tuple[str, str, int]] = []
        current, sink, reached = None, None, 0
        try:
            for batch in batches:
                columns = [batch.column(batch.schema.get_field_index(c)) for c in
                           ("split", "shard_id", "start", "tokens")]
                splits, shards, starts = (c.to_pylist() for c in columns[:3])
                for row, (split, shard, start) in enumerate(zip(splits, shards, starts)):
                    name = VAL_NAME if split == "val" else TRAIN_NAME.format(shard)
                    if name != current:
                        if sink is not None:
                            sink.close()
                        if any(final == name for final, _, _ in files):
                            raise ValueError(f"fragments of {name} are not together")
                        temporary = f"{name}.{uuid.uuid4().hex}.tmp"
                        sink = system.open_output_stream(posixpath.join(root, temporary))
                        files.append((name, temporary, 0))
                        current, reached = name, start
                    if start != reached:
                        raise ValueError(f"gap or disorder in {name} at {start}")
                    ids = columns[3][row].values.to_numpy(zero_copy_only=False)
                    if len(ids) and (ids.min() < 0 or ids.max() > MAX_ID):
                        raise ValueError(f"an id does not fit 16 bits in {name}")
                    sink.write(ids.astype(ID_TYPE).tobytes())
                    files[-1] = (*files[-1][:2], files[-1][2] + ID_TYPE.itemsize * len(ids))
                    reached += len(ids)
        finally:
            if sink is not None:
                sink.close()
        return WrittenFiles(files)

    def commit(self, messages: list[WrittenFiles]) -> None:
        system, root = _open(self.path)
        system.create_dir(posixpath.join(root, TRAIN_DIR), recursive=True)
        fresh = [file for m in messages if m is not None for file in m.files]
        names = {name for name, _, _ in fresh}
        if len(names) != len(fresh):
            self.abort(messages)
            raise ValueError("a shard was written by two tasks")
        # An export that was cut short after its list was in place is finished first, so that this
        # commit either leaves that one whole or replaces it.
        self._settle(system, root, {temporary for _, temporary, _ in fresh})
        # What an append finds in place stays, named by the list before it or not.
        kept = [] if self.overwrite else self._bins(system, root)
        entries = fresh + [(f.name, None, f.size) for f in kept if f.name not in names]
        temporary = posixpath.join(root, f"{COMMIT}.{uuid.uuid4().hex}.tmp")
        with system.open_output_stream(temporary) as sink:
            sink.write(json.dumps(entries).encode())
        system.move(temporary, posixpath.join(root, COMMIT))
        self._settle(system, root, set())

    @staticmethod
    def _bins(system: fs.FileSystem, root: str) -> list[BinFile]:
        return [f for f in _present(system, root).values() if f.name.endswith(".bin")]

    def _settle(self, system: fs.FileSystem, root: str, pending: set[str]) -> None:
        """Do what is left of a commit whose list is in place, and sweep temporary files other than
        the ``pending`` ones. Every step may be repeated.
        """
        commit = posixpath.join(root, COMMIT)
        if _exists(system, commit):
            with system.open_input_file(commit) as file:
                listed = json.loads(file.read())
            here = _present(system, root)
            for name, temporary, _ in listed:
                if temporary in here:
                    _replace(system, here[temporary].path, posixpath.join(root, name))
            names = {name for name, _, _ in listed}
            for file in self._bins(system, root):
                if file.name not in names:
                    system.delete_file(file.path)
            # Until this move, readers follow the commit's list.
            _replace(system, commit, posixpath.join(root, MANIFEST))
        for file in _present(system, root).values():
            if file.name.endswith(".tmp") and file.name not in pending:
                system.delete_file(file.path)

    def abort(self, messages: list[WrittenFiles]) -> None:
        system, root = _open(self.path)
        for message in messages:
            for _, temporary, _ in message.files if message is not None else ():
                if _exists(system, posixpath.join(root, temporary)):
                    system.delete_file(posixpath.join(root, temporary))


class TokenBinSource(DataSource):
    """Options: ``path``; for reads ``rowTokens`` per row and ``partitionTokens`` per task."""

    @classmethod
    def name(cls) -> str:
        return "tokenbin"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> TokenBinReader:
        return TokenBinReader(self.options)

    def writer(self, schema, overwrite: bool) -> TokenBinWriter:
        return TokenBinWriter(self.options, overwrite)
