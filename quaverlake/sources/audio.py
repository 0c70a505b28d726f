"""Audio files as a data source: a folder walk, and the raw tags that each file carries.

Registered with ``register(spark)``; then ``spark.read.format("audio_files").load(root)`` gives
one row a file, and ``df.write.format("audio_files").mode("append").save(root)`` writes ``name``
and ``content`` as files below ``root``.  Folders are tasks; only their names pass the driver.
"""

from __future__ import annotations

import io
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: The file name endings that count as audio.
EXTENSIONS = (".mp3", ".flac", ".m4a", ".aac", ".ogg", ".opus", ".wma", ".wav")

TAGS = "array<struct<name: string, value: string>>"
SCHEMA = f"path string, name string, bytes long, mtime long, seconds int, tags {TAGS}, info {TAGS}"
#: Longest list of a RIFF file and longest frame that is read, and longest tag that must be held to undo its escapes.
MOST_LIST, MOST_FRAME, MOST_ESCAPED = 1 << 20, 1 << 20, 1 << 24

Tags = list[tuple[str, str]]


@dataclass
class Found:
    """What one file carries; ``info`` only fills what ``tags`` leave open."""

    tags: Tags
    info: Tags
    seconds: float | None = None


def _clean(raw: bytes, encoding: str) -> str:
    return raw.decode(encoding, "replace").strip().strip("\x00").strip()


def _western(raw: bytes) -> str:
    """The part before a zero byte, as UTF-8 or else in a Western code page."""
    raw = raw.split(b"\x00", 1)[0]
    try:
        return raw.decode("utf-8").strip()
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace").strip()


def _chunks(fh: BinaryIO, end: int | None = None) -> Iterator[tuple[bytes, int]]:
    """Name and size of each RIFF chunk; the handle stands at its body, and moves on from there by itself."""
    while end is None or fh.tell() + 8 <= end:
        head = fh.read(8)
        if len(head) < 8:
            return
        size = int.from_bytes(head[4:], "little")
        after = fh.tell() + size + size % 2
        yield head[:4], size
        fh.seek(after)


def _info(body: bytes) -> Tags:
    """Pairs of an INFO list; a value that claims more than is there ends with the list."""
    out, at = [], 4
    while at + 8 <= len(body):
        size = int.from_bytes(body[at + 4 : at + 8], "little")
        value = _western(body[at + 8 : at + 8 + size])
        if value:
            out.append((body[at : at + 4].decode("latin-1"), value))
        at += 8 + size + size % 2
    return out


def _synchsafe(raw: bytes) -> int:
    return sum((b & 127) << 7 * k for k, b in enumerate(reversed(raw)))


ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")


def _texts(encoding: int, raw: bytes) -> list[str]:
    """The values of a text frame, parted by a zero character."""
    text = raw.decode(ENCODINGS[encoding] if encoding < len(ENCODINGS) else "latin-1", "replace")
    return [s.strip().lstrip("﻿") for s in text.split("\x00")]


def _frame(name: str, body: bytes) -> Tags:
    if name == "UFID":
        owner, _, data = body.partition(b"\x00")
        return [(f"UFID:{_clean(owner, 'latin-1')}", _clean(data, "utf-8"))]
    if not name.startswith("T") or not body:
        return []
    values = _texts(body[0], body[1:])
    if name == "TXXX":
        name, values = f"TXXX:{values[0]}", values[1:]
    return [(name, v) for v in values if v]


def _id3(fh: BinaryIO) -> Tags:
    """Frames of an ID3 tag of version 2.3 or 2.4 at the handle; compressed or encrypted frames are left out."""
    head = fh.read(10)
    if len(head) < 10 or head[:3] != b"ID3" or head[3] not in (3, 4):
        return []
    version, flags, left = head[3], head[5], _synchsafe(head[6:])
    if flags & 0x80 and version == 3:
        if left > MOST_ESCAPED:
            return []
        whole = fh.read(left).replace(b"\xff\x00", b"\xff")
        fh, left = io.BytesIO(whole), len(whole)
    number = _synchsafe if version == 4 else lambda raw: int.from_bytes(raw, "big")
    if flags & 0x40:
        size = number(fh.read(4))
        more = size - 4 if version == 4 else size
        fh.seek(more, 1)
        left -= 4 + more
    out: Tags = []
    while left >= 10:
        head = fh.read(10)
        if len(head) < 10 or not head[:4].isalnum():
            break
        name, size, how = head[:4].decode("ascii"), number(head[4:8]), head[9]
        left -= 10 + size
        if left < 0:
            break
        closed = how & (0x0C if version == 4 else 0xC0)
        if closed or size > MOST_FRAME or name[0] not in "TU":
            fh.seek(size, 1)
            continue
        body = fh.read(size)
        if version == 4 and how & 0x01:
            body = body[4:]
        if version == 4 and how & 0x02:
            body = body.replace(b"\xff\x00", b"\xff")
        out += _frame(name, body)
    return out


def _comments(body: bytes) -> Tags:
    """``NAME=value`` pairs after the name of the writer."""
    out, at = [], 4 + int.from_bytes(body[:4], "little")
    count, at = int.from_bytes(body[at : at + 4], "little"), at + 4
    while count and at + 4 <= len(body):
        size = int.from_bytes(body[at : at + 4], "little")
        name, sign, value = body[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
        if sign and value.strip():
            out.append((name, value.strip()))
        at, count = at + 4 + size, count - 1
    return out


def _riff(fh: BinaryIO, found: Found) -> None:
    rate = 0
    for name, size in _chunks(fh):
        if name == b"LIST" and 4 <= size <= MOST_LIST:
            body = fh.read(size)
            found.info += _info(body) if body[:4] == b"INFO" else []
        elif name == b"fmt " and size >= 16:
            rate = int.from_bytes(fh.read(16)[8:12], "little")
        elif name in (b"id3 ", b"ID3 "):
            found.tags += _id3(fh)
        elif name == b"data" and rate:
            found.seconds = size / rate


def _flac(fh: BinaryIO, found: Found) -> None:
    last = False
    while not last:
        head = fh.read(4)
        if len(head) < 4:
            break
        last, kind, size = bool(head[0] & 128), head[0] & 127, int.from_bytes(head[1:], "big")
        after = fh.tell() + size
        if kind == 0 and size >= 18:
            bits = int.from_bytes(fh.read(18)[10:18], "big")
            rate, samples = bits >> 44, bits & ((1 << 36) - 1)
            found.seconds = samples / rate if rate and samples else None
        elif kind == 4:
            found.tags += _comments(fh.read(size))
        fh.seek(after)


def read_tags(fh: BinaryIO) -> Found:
    """The tags of one open file; anything unexpected gives what was found before it, never an error.

    Knows RIFF (INFO lists, ID3 chunks), ID3 2.3 and 2.4 at the head of a file, and FLAC comments.
    The length is known for RIFF and FLAC.  Numbered genres stay numbers.
    """
    found, start = Found([], []), fh.read(12)
    try:
        if start[:4] == b"RIFF" and start[8:] == b"WAVE":
            _riff(fh, found)
        elif start[:4] == b"fLaC":
            fh.seek(4)
            _flac(fh, found)
        else:
            fh.seek(0)
            found.tags += _id3(fh)
    except (ValueError, IndexError, OverflowError):
        pass  # a broken file keeps its name and what was read; errors of the file system are raised
    return found


def _system(root: str):
    from pyarrow import fs

    found, path = fs.FileSystem.from_uri(root if "://" in root or root.startswith("/") else f"file://{root}")
    return found, path.rstrip("/")


class Folder(InputPartition):
    """A folder, with what lies below it where ``deep``; of its files those of one share of their names."""

    def __init__(self, path: str, deep: bool, share: int):
        self.path, self.deep, self.share = path, deep, share


class AudioReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        # a prefix is a whole folder: "a/b" leaves "a/bc" in
        self.excluded = [x.strip("/").lower() for x in options.get("exclude", "").split("|") if x.strip("/")]
        self.depth, self.shares = int(options.get("depth", 1)), int(options.get("shares", 1))
        self.tags = options.get("tags", "true") == "true"

    def _folders(self, system, base: str, path: str) -> tuple[list[str], list]:
        from pyarrow import fs

        below = system.get_file_info(fs.FileSelector(path))
        kept = [x.path for x in below if x.type == fs.FileType.Directory and not self._left_out(x.path[len(base) :])]
        return kept, [x for x in below if x.type == fs.FileType.File and os.path.splitext(x.base_name)[1].lower() in EXTENSIONS]

    def _left_out(self, path: str) -> bool:
        low = path.strip("/").lower()
        return any(low == x or low.startswith(x + "/") for x in self.excluded)

    def partitions(self) -> list[Folder]:
        system, base = _system(self.root)
        level, out = [base], []
        for _ in range(self.depth):
            out += [Folder(p, False, k) for p in level for k in range(self.shares)]
            level = [d for p in level for d in self._folders(system, base, p)[0]]
        return out + [Folder(p, True, k) for p in level for k in range(self.shares)]

    def read(self, part: Folder) -> Iterator[tuple]:
        system, base = _system(self.root)
        open_folders = [part.path]
        while open_folders:
            folders, files = self._folders(system, base, open_folders.pop())
            if part.deep:
                open_folders += folders
            for f in files:
                if zlib.crc32(f.base_name.encode()) % self.shares == part.share:
                    yield self._row(system, base, f)

    def _row(self, system, base: str, f) -> tuple:
        found = Found([], [])
        if self.tags:
            with system.open_input_file(f.path) as fh:
                found = read_tags(fh)
        modified = int(f.mtime_ns // 1_000_000_000) if f.mtime_ns is not None else None
        seconds = int(found.seconds) if found.seconds else None
        return (f.path, f.path[len(base) + 1 :], f.size, modified, seconds, found.tags, found.info)


class AudioWriter(DataSourceWriter):
    """Each file is written under another name and then moved: a task that runs again writes the same files."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, base = _system(self.root)
        made: set[str] = set()
        for r in rows:
            folder, _, name = f"{base}/{r.name}".rpartition("/")
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            part = f"{folder}/.{uuid.uuid4().hex}.part"
            with system.open_output_stream(part) as out:
                out.write(bytes(r.content))
            system.move(part, f"{folder}/{name}")
        return WriterCommitMessage()


class AudioFiles(DataSource):
    """Options: ``exclude`` (folders below the root, parted by ``|``, never listed), ``depth`` (levels of
    folders that become tasks), ``shares`` (tasks a folder), ``tags`` (``false``: files are listed, not opened)."""

    @classmethod
    def name(cls) -> str:
        return "audio_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return AudioReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return AudioWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AudioFiles)
