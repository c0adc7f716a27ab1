"""ZIP archives as a data source: the directory at an archive's end is read when the scan is planned, and each task inflates a range of entries.

No worker holds an archive: entries are inflated one by one from a file that can be read at any place, and only those of a task's range.
An archive that breaks a rule is one row with a code; so is each entry that can't be inflated (wrong checksum, encrypted, unknown method)."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath
from typing import IO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Limits, suffixes, and what counts as an archive in an archive.
MAX_ENTRIES = 500
MAX_UNPACKED = 250 * 1024 * 1024
MAX_RATIO = 100
SUFFIXES = ("jpg", "jpeg", "png")
NESTED = (".zip", ".tar", ".gz", ".7z", ".rar")

#: Bytes of inflated entries that a task gets at most, but for a single larger entry.
RANGE = 32 << 20
#: Archives whose directories are read in planning; more are a task each, which reads its own.
PLANNED = 1000
SCHEMA = "path string, pos int, name string, content binary, code string, message string"
ARROW = pa.schema([("path", pa.string()), ("pos", pa.int32()), ("name", pa.string()), ("content", pa.binary()), ("code", pa.string()), ("message", pa.string())])


@dataclass(frozen=True)
class Refused(Exception):
    """Why a whole archive is refused, and at which entry."""

    code: str
    message: str
    name: str | None = None


def suffix(name: str) -> str:
    return PurePosixPath(name).suffix.lower().lstrip(".")


def directory(archive: zipfile.ZipFile) -> list[tuple[int, zipfile.ZipInfo, str | None]]:
    """(place, entry, why it is passed over) of an archive's files.  Archives in it are passed over before sizes are added up."""
    members = archive.infolist()
    if not members:
        raise Refused("EMPTY_ZIP", "no entries")
    if len(members) > MAX_ENTRIES:
        raise Refused("ZIP_TOO_MANY_ENTRIES", str(len(members)))
    total, out = 0, []
    for pos, entry in enumerate(members):
        name = entry.filename.replace("\\", "/")
        if entry.is_dir():
            continue
        parts = PurePosixPath(name).parts
        if name.startswith("/") or ".." in parts or ":" in parts[0]:
            raise Refused("ZIP_PATH_TRAVERSAL", "unsafe entry name", entry.filename)
        if name.lower().endswith(NESTED):
            out.append((pos, entry, "nested archive"))
            continue
        total += entry.file_size
        if total > MAX_UNPACKED:
            raise Refused("ZIP_TOO_LARGE", str(total), entry.filename)
        if entry.file_size / max(1, entry.compress_size) > MAX_RATIO:
            raise Refused("ZIP_SUSPICIOUS_RATIO", entry.filename, entry.filename)
        out.append((pos, entry, None if suffix(name) in SUFFIXES else "unsupported ZIP entry"))
    return out


def opened(file: IO[bytes]) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(file)
    except (zipfile.BadZipFile, EOFError, ValueError, OSError) as error:
        raise Refused("CORRUPT_ZIP", "not a readable archive") from error


def inflated(archive: zipfile.ZipFile, entries: list[tuple[int, zipfile.ZipInfo, str | None]]) -> Iterator[tuple[int, str, bytes | None, str | None, str | None]]:
    """(place, name, bytes, code, message) of entries, one at a time."""
    for pos, entry, why in entries:
        if why:
            yield pos, entry.filename, None, "SKIPPED", why
        elif entry.flag_bits & 1:
            yield pos, entry.filename, None, "ENCRYPTED_ENTRY", "needs a password"
        else:
            try:
                yield pos, entry.filename, archive.read(entry), None, None
            except NotImplementedError as error:
                yield pos, entry.filename, None, "UNSUPPORTED_COMPRESSION", str(error)
            except Exception as error:  # a wrong checksum, a broken stream, a header that lies: the entry is lost, not the job
                yield pos, entry.filename, None, "CORRUPT_ZIP", f"{type(error).__name__}: {error}"[:200]


def unzip(file: IO[bytes]) -> Iterator[tuple[int | None, str | None, bytes | None, str | None, str | None]]:
    """(place, name, bytes, code, message) of a whole archive; a code without a place refuses it."""
    try:
        with opened(file) as archive:
            yield from inflated(archive, directory(archive))
    except Refused as why:
        yield None, why.name, None, why.code, why.message


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Part(InputPartition):
    """Some entries of an archive, by their places; no places: all that its directory has."""

    path: str
    places: tuple[int, ...] | None = None
    refused: tuple[str, str, str | None] | None = None


def ranges(entries: list[tuple[int, zipfile.ZipInfo, str | None]], most: int) -> list[tuple[int, ...]]:
    """Places of the entries in runs of at most ``most`` inflated bytes."""
    out: list[list[int]] = []
    size = 0
    for pos, entry, why in entries:
        own = 0 if why else entry.file_size
        if not out or size + own > most:
            out.append([])
            size = 0
        out[-1].append(pos)
        size += own
    return [tuple(x) for x in out]


class ZipReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.most = int(options.get("rangeBytes", RANGE))
        self.planned = int(options.get("planned", PLANNED))

    def archives(self) -> list[str]:
        """The archive, or those of a folder (not below it)."""
        system, path = store(self.path)
        head = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        if system.get_file_info(path).type != fs.FileType.Directory:
            return [self.path]
        found = system.get_file_info(fs.FileSelector(path))
        return sorted(head + x.path for x in found if x.type == fs.FileType.File and x.path.lower().endswith(".zip"))

    def partitions(self) -> list[Part]:
        found = self.archives()
        if len(found) > self.planned:
            return [Part(x) for x in found]
        out = []
        for path in found:
            system, at = store(path)
            try:
                with system.open_input_file(at) as file, opened(file) as archive:
                    out += [Part(path, places) for places in ranges(directory(archive), self.most)]
            except Refused as why:
                out.append(Part(path, (), (why.code, why.message, why.name)))
        return out or [Part("", ())]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        def row(pos, name, content, code, message):
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part.path, pos, name, content, code, message), ARROW.types)], schema=ARROW)

        if part.refused:
            code, message, name = part.refused
            yield row(None, name, None, code, message)
        elif part.places is None or part.places:
            system, at = store(part.path)
            with system.open_input_file(at) as file:
                if part.places is None:
                    for x in unzip(file):
                        yield row(*x)
                    return
                wanted = set(part.places)
                with opened(file) as archive:
                    for x in inflated(archive, [e for e in directory(archive) if e[0] in wanted]):
                        yield row(*x)


class ZipEntries(DataSource):
    """``spark.read.format("zip_entries").load(path)``: the entries of an archive or of the archives of a folder."""

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options)


def entries(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    """One row per entry: path of the archive, place, name, content, code and message."""
    spark.dataSource.register(ZipEntries)
    return spark.read.format("zip_entries").options(**options).load(path)
