"""Small files on any file system that Hadoop knows: what they are, their ends, and atomic writes."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import SparkSession


class Files:
    """Access through Hadoop's file systems, so paths mean the same to the driver and to executors."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self._conf), where

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def glob(self, pattern: str) -> list[str]:
        """Files and folders that a pattern names, sorted."""
        fs, where = self._at(pattern)
        return sorted(f.getPath().toString() for f in fs.globStatus(where) or [])

    def stats(self, path: str) -> list[tuple[str, int, int]]:
        """(path, size, time in milliseconds) of a file, or of all files under a folder but hidden ones, sorted."""
        fs, where = self._at(path)
        out, files = [], fs.listFiles(where, True)
        while files.hasNext():
            f = files.next()
            if not f.getPath().getName().startswith(("_", ".")):
                out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return sorted(out)

    def read(self, path: str, tail: int | None = None) -> bytes:
        """The bytes of a small file, or the last of a large one."""
        fs, where = self._at(path)
        stream = fs.open(where)
        try:
            if tail is not None:
                stream.seek(max(0, fs.getFileStatus(where).getLen() - tail))
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, path: str, data: bytes) -> None:
        """Writes beside the file and renames, so that readers see all of it or nothing; an older file goes first."""
        fs, where = self._at(path)
        _, beside = self._at(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(beside)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        if not fs.rename(beside, where):
            fs.delete(where, False)
            if not fs.rename(beside, where):
                raise OSError(f"{path} can't be renamed into place")


def fingerprint(files: Files, path: str, tail: int = 1_000_000) -> dict:
    """Path, size, time and SHA-256 of the last bytes, where a Parquet file has its footer."""
    ((_, size, time),) = files.stats(path)
    return {"path": path, "size": size, "mtime_ms": time, "tail_sha256": hashlib.sha256(files.read(path, tail)).hexdigest()}


def fingerprint_status(files: Files, record: dict | None, path: str) -> str:
    """OK, MISSING, DRIFTED or NOFILE, as of a file; a new time alone is no drift. The end is read only if the size is as recorded."""
    if not files.exists(path):
        return "MISSING"
    if record is None:
        return "NOFILE"
    ((_, size, _),) = files.stats(path)
    if size != record["size"]:
        return "DRIFTED"
    return "OK" if fingerprint(files, path)["tail_sha256"] == record["tail_sha256"] else "DRIFTED"
