"""Folders of office files as tables: scan, guard, decode, extract."""

from __future__ import annotations

import os
import selectors
import stat
import struct
import subprocess
import sys
import time
from collections.abc import Iterable, Iterator
from json import loads

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.runtime import cut
from lodestone.sources import extraction
from lodestone.sources.extraction import OFFICE, decode_bytes, extract_text, markup_text, office_text, plain_lines  # noqa: F401

# The largest file, the time an office file may take.
MOST_BYTES = 200 * 1024 * 1024
DEADLINE_S = 180
SCAN = "path string, root string, modified_ms bigint, size bigint"
_FOUND = SCAN + ", kind string, reason string"
_ROWS = 1_000


def _remote(path: str) -> tuple[object, str] | None:
    """The file system of a path with a scheme and the path in it; ``None`` for a local one."""
    if "://" not in path or path.startswith("file:"):
        return None
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _local(path: str) -> str:
    return path[5:].replace("//", "/", 1) if path.startswith("file:") else path


def list_folder(path: str) -> Iterator[tuple[str, str, int | None, int | None, str | None]]:
    """``path, kind, modified_ms, size, reason`` of everything in a folder, whatever its name; links are not followed.

    ``kind``: ``file``, ``folder`` or ``error``, which is what could not be read, with its reason.
    """
    remote = _remote(path)
    if remote is not None:
        from pyarrow import fs

        system, inner = remote
        scheme = path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"
        try:
            for info in system.get_file_info(fs.FileSelector(inner)):
                kind = {fs.FileType.Directory: "folder", fs.FileType.File: "file"}.get(info.type)
                if kind:
                    yield scheme + info.path, kind, info.mtime_ns // 1_000_000 if info.mtime_ns else None, info.size, None
        except OSError as error:
            yield path, "error", None, None, str(error)
        return
    try:
        with os.scandir(_local(path)) as entries:
            for entry in entries:
                try:
                    seen = entry.stat(follow_symlinks=False)
                except OSError as error:
                    yield entry.path, "error", None, None, str(error)
                    continue
                if stat.S_ISDIR(seen.st_mode):
                    yield entry.path, "folder", None, None, None
                elif stat.S_ISREG(seen.st_mode):
                    yield entry.path, "file", seen.st_mtime_ns // 1_000_000, seen.st_size, None
    except OSError as error:
        yield path, "error", None, None, str(error)


def state_of(path: str) -> tuple[str, int | None, int | None]:
    """``kind, modified_ms, size`` of one path; ``kind`` is ``missing`` where there is nothing."""
    remote = _remote(path)
    if remote is not None:
        from pyarrow import fs

        info = remote[0].get_file_info(remote[1])
        kind = {fs.FileType.Directory: "folder", fs.FileType.File: "file", fs.FileType.NotFound: "missing"}.get(info.type, "other")
        return kind, info.mtime_ns // 1_000_000 if info.mtime_ns else None, info.size
    try:
        seen = os.stat(_local(path))
    except OSError:
        return "missing", None, None
    kind = "folder" if stat.S_ISDIR(seen.st_mode) else "file" if stat.S_ISREG(seen.st_mode) else "other"
    return kind, seen.st_mtime_ns // 1_000_000, seen.st_size


def _walked(folders: DataFrame, deep: bool) -> DataFrame:
    """``_FOUND`` below ``path`` for each row of ``path, root``: what is in the folders, or all the way down."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                waiting = [row["path"]]
                while waiting:
                    for path, kind, ms, size, reason in list_folder(waiting.pop()):
                        if kind == "folder" and deep:
                            waiting.append(path)
                            continue
                        held.append((path, row["root"], ms, size, kind, reason))
                        if len(held) >= _ROWS:
                            yield _batch(held)
                            held = []
        if held:
            yield _batch(held)

    return folders.select("path", "root").mapInArrow(run, _FOUND)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in _FOUND.split(", ")])


def _all_below(folders: DataFrame) -> DataFrame:
    """Everything below the folders: their own entries first, so that subfolders are walked by tasks of their own."""
    top = cut(_walked(folders.repartition("path"), deep=False))
    return top.where("kind <> 'folder'").unionByName(_walked(top.where("kind = 'folder'").select("path", "root").repartition("path"), deep=True))


def _states(paths: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, None, ms, size, kind, None) for p in batch.column("path").to_pylist() for kind, ms, size in [state_of(p)]]
            if rows:
                yield _batch(rows)

    return paths.where("path is not null").select("path").distinct().mapInArrow(run, _FOUND)


def scan_roots(spark: SparkSession, roots: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``path, root, modified_ms, size`` of the supported files below the roots; ``root, complete``; ``path, reason`` of failures.

    A root that is no folder is offline: it is not complete and gives no file. What cannot be read in a root is a failure
    and makes it incomplete; the rest of it is read. Hidden files count, links are not followed.
    """
    known = _states(spark.createDataFrame([(r,) for r in dict.fromkeys(roots)], "path string"))
    known = cut(known)
    folders = known.where("kind = 'folder'").select("path", F.col("path").alias("root"))
    found = cut(_all_below(folders))
    files = found.where((F.col("kind") == "file") & T.is_supported(F.col("path"))).select("path", "root", "modified_ms", "size")
    errors = found.where("kind = 'error'")
    broken = errors.select("root").distinct()
    complete = folders.select("root").join(broken, "root", "left_anti").select("root", F.lit(True).alias("complete"))
    partly = known.select(F.col("path").alias("root")).join(complete, "root", "left").select("root", F.coalesce("complete", F.lit(False)).alias("complete"))
    offline = known.where("kind <> 'folder'").select("path", F.lit("directory not found: offline").alias("reason"))
    return files, partly, errors.select("path", "reason").unionByName(offline)


def scan_paths(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``path, modified_ms, size`` of the supported files that the paths are or hold, and the paths that were read without failure.

    Only these paths are looked at, not the roots they lie in. A path that is missing was read: it holds nothing.
    """
    known = cut(_states(paths))
    below = cut(_all_below(known.where("kind = 'folder'").select("path", F.col("path").alias("root"))))
    files = known.where("kind = 'file'").unionByName(below.where("kind = 'file'")).where(T.is_supported(F.col("path")))
    broken = below.where("kind = 'error'").select(F.col("root").alias("path")).distinct()
    return files.select("path", "modified_ms", "size").dropDuplicates(["path"]), known.select("path").join(broken, "path", "left_anti")


class Extractor:
    """Reads office files and PDFs in a process of its own, which is ended at a file's deadline and started afresh."""

    def __init__(self, deadline: float = DEADLINE_S) -> None:
        self.deadline, self.worker = deadline, None

    def __call__(self, data: bytes, extension: str) -> tuple[str | None, str | None]:
        """Text or reason."""
        if extension.lower() not in OFFICE:
            try:
                return extract_text(data, extension), None
            except Exception as error:  # noqa: BLE001
                return None, str(error) or type(error).__name__
        if self.worker is None:
            self.worker = subprocess.Popen([sys.executable, extraction.__file__], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
        name = extension.encode()
        try:
            self.worker.stdin.write(struct.pack("<IQ", len(name), len(data)) + name + data)
            self.worker.stdin.flush()
            until = time.monotonic() + self.deadline
            head = self._read(8, until)
            return tuple(loads(self._read(struct.unpack("<Q", head)[0], until)))
        except TimeoutError:
            self.close()
            return None, f"timeout: extraction took more than {self.deadline:g} seconds"
        except (OSError, EOFError):
            self.close()
            return None, "the extraction process ended without a result"

    def _read(self, size: int, until: float) -> bytes:
        out = bytearray()
        with selectors.DefaultSelector() as ready:
            ready.register(self.worker.stdout, selectors.EVENT_READ)
            while len(out) < size:
                if not ready.select(max(0.0, until - time.monotonic())):
                    raise TimeoutError
                part = os.read(self.worker.stdout.fileno(), min(size - len(out), 1 << 20))
                if not part:
                    raise EOFError
                out += part
        return bytes(out)

    def close(self) -> None:
        if self.worker is not None:
            self.worker.kill()
            self.worker.communicate()
            self.worker = None


def extract_isolated(data: bytes, extension: str, deadline: float = DEADLINE_S) -> tuple[str | None, str | None]:
    """Text or reason of one file."""
    reader = Extractor(deadline)
    try:
        return reader(data, extension)
    finally:
        reader.close()


def read_file(path: str) -> bytes:
    remote = _remote(path)
    if remote is not None:
        with remote[0].open_input_stream(remote[1]) as stream:
            return stream.read()
    with open(_local(path), "rb") as file:
        return file.read()


def extract(jobs: DataFrame, deadline: float = DEADLINE_S) -> DataFrame:
    """``path, root, modified_ms, size, text, category, reason``: each file of the scan read, or why it could not be.

    Files over ``MOST_BYTES`` are refused unread. Each file is opened where its row is, on a local disk or by its URI, so
    nothing is shuffled and no content passes through the driver.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Extractor(deadline)
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    text, reason = None, None
                    if row["size"] is not None and row["size"] > MOST_BYTES:
                        reason = "the file is larger than 200 MiB"
                    else:
                        try:
                            text, reason = reader(read_file(row["path"]), row["path"].rpartition(".")[2])
                        except PermissionError:
                            reason = "Permission denied"
                        except FileNotFoundError:
                            reason = "No such file"
                        except OSError as error:
                            reason = f"offline: {error.strerror or error}"
                    yield pa.RecordBatch.from_pylist([row | {"text": text, "reason": reason}], schema=schema)
        finally:
            reader.close()

    schema = pa.schema([("path", pa.string()), ("root", pa.string()), ("modified_ms", pa.int64()), ("size", pa.int64()), ("text", pa.string()), ("reason", pa.string())])
    out = jobs.select("path", "root", "modified_ms", "size").mapInArrow(run, SCAN + ", text string, reason string")
    return out.withColumn("category", F.when(F.col("reason").isNotNull(), T.classify_failure(F.col("reason"))))


def read_vocabulary(data: bytes) -> dict[bytes, int]:
    """Tokens and ids of a binary vocabulary: ``RWKVTOK1``, a 32-bit count, then tokens with 16-bit lengths.

    Token 0 and empty tokens are reserved.
    """
    if data[:8] != b"RWKVTOK1":
        raise ValueError("invalid vocabulary")
    (count,), at, out = struct.unpack_from("<I", data, 8), 12, {}
    for token in range(count):
        if at + 2 > len(data):
            raise ValueError("the vocabulary is incomplete")
        (length,) = struct.unpack_from("<H", data, at)
        piece = data[at + 2 : at + 2 + length]
        if len(piece) < length:
            raise ValueError("the vocabulary is incomplete")
        if token and length:
            out[piece] = token
        at += 2 + length
    return out


class LongestMatch:
    """Greedy longest-match tokeniser over bytes."""

    def __init__(self, vocabulary: dict[bytes, int]) -> None:
        self.ids = vocabulary
        self.lengths: dict[int, list[int]] = {}
        for piece in vocabulary:
            self.lengths.setdefault(piece[0], []).append(len(piece))
        self.lengths = {k: sorted(set(v), reverse=True) for k, v in self.lengths.items()}

    def encode(self, text: str) -> list[int]:
        data, at, out = text.encode(), 0, []
        while at < len(data):
            for n in self.lengths.get(data[at], ()):
                token = self.ids.get(data[at : at + n])
                if token is not None:
                    out.append(token)
                    at += n
                    break
            else:
                raise ValueError("the vocabulary does not cover every byte")
        return out


def plan_batches(lengths: list[int], rows: int = 4, budget: int = 8192) -> list[list[int]]:
    """Batches of positions by length: at most ``rows`` each, and rows times the longest within ``budget``.

    Shorter texts come first, and a text that breaks the budget alone is alone; the longest one is in the last batch.
    """
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__):
        open_ = out and len(out[-1]) < rows and lengths[i] * (len(out[-1]) + 1) <= budget
        if open_:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def padded_tokens(lengths: list[int], batches: list[list[int]]) -> tuple[int, int]:
    """Tokens that the batches hold and tokens that they take when padded to their longest."""
    return sum(lengths), sum(len(b) * max(lengths[i] for i in b) for b in batches)
