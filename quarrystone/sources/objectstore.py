"""Objects by key over any Hadoop file system, and what the providers' names mean."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..errors import Conflict, InvalidArgument, NotFound, StoreUnavailable

SCHEMES = {
    **dict.fromkeys(("s3", "aws", "aws-s3", "aws_s3"), "s3a"),
    **dict.fromkeys(("gcs", "google", "google-cloud-storage", "google_cloud_storage"), "gs"),
}


def location(provider: str, bucket: str, prefix: str = "") -> str:
    """The URI that Spark reads for a bucket of a provider."""
    scheme = SCHEMES.get(provider.strip().lower())
    if scheme is None:
        raise InvalidArgument("expected one of: s3, gcs")
    return f"{scheme}://{bucket}/{prefix.strip('/')}".rstrip("/")


class ObjectStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, key: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}" if key else self.root)

    def uri(self, key: str) -> str:
        return f"{self.root}/{key}"

    def put(self, key: str, text: str, absent: bool = False) -> None:
        """absent: the key must be new, else Conflict."""
        try:
            stream = self._fs.create(self._path(key), not absent)
        except Exception as e:  # the JVM's exceptions come through the gateway
            if absent and "AlreadyExists" in str(e):
                raise Conflict(f"{key} exists") from e
            raise StoreUnavailable(str(e)) from e
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def get(self, key: str) -> str:
        if not self._fs.exists(self._path(key)):
            raise NotFound(key)
        stream = self._fs.open(self._path(key))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    # values that are changed by compare-and-set: each version is an object of its own, created if it is new

    def versioned(self, key: str) -> tuple[str | None, int]:
        """The latest text of a key and its version; nothing and 0 before the first."""
        found = [int(k.rsplit("/", 1)[1]) for k in self.list(f"{key}.versions")]
        if not found:
            return None, 0
        return self.get(f"{key}.versions/{max(found):020d}"), max(found)

    def put_versioned(self, key: str, text: str, expected: int) -> int:
        """The new version; Conflict if another writer was faster."""
        self.put(f"{key}.versions/{expected + 1:020d}", text, absent=True)
        if expected > 1:  # one older version stays, for readers that have just listed it
            self.delete(f"{key}.versions/{expected - 1:020d}")
        return expected + 1

    def exists(self, key: str) -> bool:
        return self._fs.exists(self._path(key))

    def list(self, prefix: str) -> list[str]:
        """Keys under a folder, sorted."""
        top = self._path(prefix)
        if not self._fs.exists(top):
            return []
        out, files = [], self._fs.listFiles(top, True)
        base = self._fs.makeQualified(self._path("")).toUri().getPath().rstrip("/")
        while files.hasNext():
            out.append(files.next().getPath().toUri().getPath()[len(base) + 1 :])
        return sorted(out)

    def delete(self, key: str) -> None:
        self._fs.delete(self._path(key), True)
