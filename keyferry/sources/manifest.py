"""Numbered manifests under a path: each says which folders make up a table, and replaces the one before by one rename."""

import json
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Manifests:
    """The manifests of one table. Folders are named relative to its path. One writer at a time."""

    spark: SparkSession
    path: str

    def _files(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        files, at = self._files("manifest")
        if not files.exists(at):
            return []
        return sorted(int(f.getPath().getName()) for f in files.listStatus(at) if f.getPath().getName().isdigit())

    def read(self, version: int) -> dict:
        files, at = self._files(f"manifest/{version}")
        stream = files.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, manifest: dict, version: int) -> None:
        """Add a manifest; readers see it whole or not at all. The version must be new."""
        files, draft = self._files(f"manifest/_{version}")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        _, final = self._files(f"manifest/{version}")
        if files.exists(final) or not files.rename(draft, final):
            raise RuntimeError(f"version {version} of {self.path} was written by another job")

    def delete(self, name: str) -> None:
        files, at = self._files(name)
        files.delete(at, True)
