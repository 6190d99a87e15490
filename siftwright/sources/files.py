"""Small files in any file system that Spark reaches: local ones, hdfs:, s3: and the like."""

from __future__ import annotations

import json
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

PIECE = 1 << 20  #: bytes of a file that are held at once


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        target = self._jvm.org.apache.hadoop.fs.Path(str(path))
        return target.getFileSystem(self._conf), target

    def exists(self, path: str) -> bool:
        system, target = self._at(path)
        return system.exists(target)

    def names(self, folder: str) -> list[str]:
        """Names in a folder, in order; none without the folder."""
        system, target = self._at(folder)
        return sorted(s.getPath().getName() for s in system.listStatus(target)) if system.exists(target) else []

    def write(self, path: str, data: bytes) -> None:
        system, target = self._at(path)
        out = system.create(target, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def read(self, path: str) -> bytes:
        system, target = self._at(path)
        stream = system.open(target)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def sha256(self, path: str) -> str:
        """Digest of a file, streamed within the driver's JVM."""
        system, target = self._at(path)
        stream = system.open(target)
        try:
            return self._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()

    def link(self, source: str, target: str) -> bool:
        """The files of a flat folder once more in target, as hard links in place of what is there; False where that can't be done.

        Tables are replaced, never changed, so a linked file stays as it is. Names that Spark's readers leave out are left out.
        """
        system, folder = self._at(source)
        if system.getUri().getScheme() != "file":
            return False
        names = [s.getPath().getName() for s in system.listStatus(folder) if s.isFile()]
        if any(s.isDirectory() for s in system.listStatus(folder)):
            return False
        local = lambda path: system.pathToFile(self._at(path)[1])
        system.delete(self._at(target)[1], True)
        system.mkdirs(self._at(target)[1])
        try:
            for name in names:
                if not name.startswith(("_", ".")):
                    self._jvm.org.apache.hadoop.fs.HardLink.createHardLink(local(f"{source}/{name}"), local(f"{target}/{name}"))
        except Py4JJavaError:
            return False
        return True

    def zip(self, path: str, entries: list[tuple[str, str | bytes]]) -> None:
        """An archive of (name, path or content), in that order; a file goes through in pieces, whatever its size."""
        system, target = self._at(path)
        archive = self._jvm.java.util.zip.ZipOutputStream(system.create(target, True))  # beyond 4 GB as ZIP64
        try:
            for name, what in entries:
                archive.putNextEntry(self._jvm.java.util.zip.ZipEntry(name))
                if isinstance(what, bytes):
                    archive.write(bytearray(what))
                else:
                    self._copy(what, archive)
                archive.closeEntry()
        finally:
            archive.close()

    def _copy(self, path: str, out) -> None:
        system, source = self._at(path)
        stream = system.open(source)
        try:
            self._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, PIECE, False)
        finally:
            stream.close()

    def unzip(self, path: str, folder: str, wanted: Callable[[str], bool] = lambda _: True, digests: dict[str, str] | None = None) -> list[str]:
        """The archive's entries below a folder, each copied in pieces; the names of all in order.

        wanted: of the name of an entry; others are read, not written. digests: gets the SHA-256 digest of each entry.
        """
        system, source = self._at(path)
        archive, names = self._jvm.java.util.zip.ZipInputStream(system.open(source)), []
        try:
            while (entry := archive.getNextEntry()) is not None:
                names.append(entry.getName())
                if ".." in names[-1].split("/") or names[-1].startswith("/"):
                    raise ValueError(f"an entry outside of the archive: {names[-1]}")
                to, target = self._at(f"{folder}/{names[-1]}")
                out = to.create(target, True) if wanted(names[-1]) else self._jvm.java.io.OutputStream.nullOutputStream()
                summed = self._jvm.java.security.MessageDigest.getInstance("SHA-256")
                try:
                    self._jvm.org.apache.hadoop.io.IOUtils.copyBytes(self._jvm.java.security.DigestInputStream(archive, summed), out, PIECE, False)
                finally:
                    out.close()
                if digests is not None:
                    digests[names[-1]] = bytes(summed.digest()).hex()
        finally:
            archive.close()
        return names

    def write_json(self, payload: dict, path: str) -> dict:
        self.write(path, json.dumps(payload, indent=2, ensure_ascii=False, default=str).encode("utf-8"))
        return payload

    def read_json(self, path: str) -> dict:
        return json.loads(self.read(path)) if self.exists(path) else {}

    def merge_json(self, path: str, **parts: dict) -> dict:
        return self.write_json(self.read_json(path) | parts, path)
