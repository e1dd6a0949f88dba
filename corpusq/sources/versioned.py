"""A keyed table in versions: an upsert rewrites only the hash buckets that change, and is committed by a rename."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from corpusq.operators.identity import upsert_changes, upsert_table
from corpusq.registry import query, table
from corpusq.sources.tables import kept, work_dir


class VersionedTable:
    """Rows by ``key``, in ``buckets`` of the key's hash, under one folder that readers and one writer share.

    ``data/<attempt>/bucket=<b>`` holds the rows that a write made, ``versions/<n>.json`` says for version n in which
    attempt's folder each bucket stands. A version exists once its file has been renamed into place, which is the last step of
    a write; what a killed write has left is named by no version and never read. Buckets that a write doesn't change
    keep their files. Readers take the last version, or an older one by number. Rows with a null key are not kept.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "url", buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        folder = self._path(f"{self.path}/versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{schema, buckets: {bucket: folder}} of a version, the last one by default; two entries of fixed size."""
        version = self.versions()[-1] if version is None else version
        file = self._fs.open(self._path(f"{self.path}/versions/{version:08d}.json"))
        try:
            return json.loads(bytes(file.readAllBytes()).decode())
        finally:
            file.close()

    def _commit(self, version: int, manifest: dict) -> int:
        final, temp = self._path(f"{self.path}/versions/{version:08d}.json"), self._path(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = self._fs.create(temp, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(temp, final):
            self._fs.delete(temp, False)
            raise RuntimeError(f"version {version} has been committed by another writer")
        return version

    def _bucket(self, df: DataFrame) -> DataFrame:
        return df.where(F.col(self.key).isNotNull()).withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, touched: list[int] | None) -> dict[str, str]:
        """Where the buckets of ``rows`` now stand; of ``touched`` ones without rows nowhere."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        made = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{folder}"))]
        return {**{str(b): "" for b in touched or ()}, **{n[7:]: f"{folder}/{n}" for n in made if n.startswith("bucket=")}}

    def create(self, rows: DataFrame) -> int:
        """The first version, of these rows."""
        where = self._write(self._bucket(rows), None)
        return self._commit(0, {"schema": rows.schema.json(), "buckets": where})

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets."""
        m = self.manifest(version)
        schema = StructType.fromJson(json.loads(m["schema"]))
        folders = [f"{self.path}/{f}" for b, f in m["buckets"].items() if f and (only is None or int(b) in only)]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def upsert(self, incoming: DataFrame, digest: str = "hash") -> int:
        """New and changed rows of ``incoming`` replace those of their key; the new version's number, or the old one's if none changed.

        Of rows that share a key the first by digest counts; discovery items are left out (``upsert_changes``).
        """
        last = self.versions()[-1]
        m = self.manifest(last)
        order = W.partitionBy(self.key).orderBy(digest)
        rows = self._bucket(incoming).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
        there = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most ``buckets``
        stored = self.read(last, there)
        changed = kept(upsert_changes(rows, stored, self.key, digest).where("change <> 'unchanged'"), "upsert-changed")
        touched = [r[0] for r in changed.select("bucket").distinct().collect()]
        if not touched:
            return last
        new = upsert_table(changed.drop("change"), self.read(last, touched), self.key, digest)
        return self._commit(last + 1, m | {"buckets": m["buckets"] | self._write(self._bucket(new), touched)})

    def rollback(self, version: int) -> int:
        """A new version with the rows of an older one; nothing is copied or deleted."""
        return self._commit(self.versions()[-1] + 1, self.manifest(version))


@query("""WITH i AS (SELECT 'doc/' || doc_id AS url, md5(text || '!') AS hash FROM documents WHERE doc_id % 5 = 0), s AS (SELECT 'doc/' || doc_id AS url, md5(text) AS hash FROM documents WHERE doc_id % 3 <> 0)
SELECT coalesce(i.url, s.url) AS url, coalesce(i.hash, s.hash) AS hash FROM s FULL JOIN i ON s.url = i.url""")
def upsert_sink_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("url", F.concat(F.lit("doc/"), "doc_id"))
    stored = VersionedTable(spark, work_dir(spark, "stored"), buckets=16)
    stored.create(d.where("doc_id % 3 <> 0").select("url", F.md5("text").alias("hash")))
    stored.upsert(d.where("doc_id % 5 = 0").select("url", F.md5(F.concat("text", F.lit("!"))).alias("hash")))
    return stored.read()
