"""A pool that grows by batches, each visible as a whole or not at all.

Batches are Parquet folders of their own; a manifest, one small file a version,
lists the batches that make the pool. A reader takes the newest manifest, so it
never sees files of a batch that is being written. A commit is the rename of a
finished manifest to the next version's name, which fails if another writer has
taken it; then the batch is checked against what that writer added, and tried again.

Ids stay unique within a modality: a batch is compared with earlier batches only
where the ranges of their ids overlap, and only rows in the overlap are read
(files are sorted by id, so their statistics skip the rest).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.functions import vectors as V

POOL_SCHEMA = "doc_id long, c_mod string, vec array<double>"


class DuplicateIds(ValueError):
    """A batch holds an id twice, or one that the pool already has."""


class GrowingPool:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- manifests ----------------------------------------------------------------

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifest/{version:09d}.json"

    def version(self) -> int:
        """The newest version; 0 where nothing is committed."""
        folder = self._hadoop.Path(f"{self.path}/manifest")
        if not self._files.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def batches(self, version: int | None = None) -> list[dict]:
        """The batches of a version: folder, rows, dim, and per modality the least and largest id."""
        version = self.version() if version is None else version
        if version == 0:
            return []
        stream = self._files.open(self._hadoop.Path(self._manifest(version)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, batches: list[dict]) -> bool:
        """Make ``batches`` the given version; False if there is one already."""
        made = self._hadoop.Path(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        stream = self._files.create(made)
        try:
            stream.write(bytearray(json.dumps(batches).encode()))
        finally:
            stream.close()
        target = self._hadoop.Path(self._manifest(version))
        context = self._hadoop.FileContext.getFileContext(self._files.getUri(), self.spark._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(self._files.makeQualified(made), self._files.makeQualified(target), no_options)      # never overwrites
        except Exception:
            if not self._files.exists(target):
                raise
            self._files.delete(made, False)
            return False
        return True

    # ---- reading and appending ----------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """(doc_id, c_mod, vec) of all batches of a version, the newest unless said."""
        return self._read([b["folder"] for b in self.batches(version)])

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], POOL_SCHEMA)
        return self.spark.read.schema(POOL_SCHEMA).parquet(*[f"{self.path}/{f}" for f in folders])

    def append(self, batch: DataFrame) -> int:
        """Add a batch (doc_id, c_mod, vec); returns the version that first holds it.

        An id that a modality of the batch or of the pool already has is refused,
        and so are ragged vectors and vectors of another size than the pool's;
        what was written of a refused batch is deleted. An empty batch adds nothing.
        """
        folder = f"batches/{uuid.uuid4().hex}"
        rows = batch.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("c_mod").cast("string").alias("c_mod"), V.as_double("vec").alias("vec"))
        rows.repartitionByRange("c_mod", "doc_id").sortWithinPartitions("c_mod", "doc_id").write.parquet(f"{self.path}/{folder}")
        try:
            about = self._describe(folder)
            checked: set[str] = set()
            while about["rows"]:
                version = self.version()
                earlier = self.batches(version)
                self._refuse_known(about, [b for b in earlier if b["folder"] not in checked])
                checked |= {b["folder"] for b in earlier}
                if self._commit(version + 1, [*earlier, about]):
                    return version + 1
        except BaseException:
            self._files.delete(self._hadoop.Path(f"{self.path}/{folder}"), True)
            raise
        self._files.delete(self._hadoop.Path(f"{self.path}/{folder}"), True)
        return self.version()

    def _describe(self, folder: str) -> dict:
        """Numbers of a written batch, one row per modality; an id twice in a modality is refused."""
        per_id = self._read([folder]).groupBy("c_mod", "doc_id").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most"))
        found = per_id.groupBy("c_mod").agg(
            F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.sum("n").alias("rows"), F.min("least").alias("least"),
            F.max("most").alias("most"), F.min(F.when(F.col("n") > 1, F.col("doc_id"))).alias("twice")).collect()
        for r in found:
            if r["twice"] is not None:
                raise DuplicateIds(f"id {r['twice']} occurs more than once in modality {r['c_mod']} of the batch")
        sizes = {s for r in found for s in (r["least"], r["most"])}
        if len(sizes) > 1:
            raise ValueError(f"ragged vectors in the batch: sizes {min(sizes)}..{max(sizes)}")
        return {"folder": folder, "rows": sum(r["rows"] for r in found), "dim": sizes.pop() if sizes else None,
                "ids": {r["c_mod"]: [r["first"], r["last"]] for r in found}}

    def _refuse_known(self, about: dict, earlier: list[dict]) -> None:
        """Compare a batch with earlier ones where the ranges of their ids overlap."""
        for other in earlier:
            if other["dim"] != about["dim"]:
                raise ValueError(f"vectors of size {about['dim']} for a pool of size {other['dim']}")
        for c_mod, (first, last) in about["ids"].items():
            near = [b for b in earlier if c_mod in b["ids"] and b["ids"][c_mod][0] <= last and first <= b["ids"][c_mod][1]]
            if not near:
                continue
            low, high = max(first, min(b["ids"][c_mod][0] for b in near)), min(last, max(b["ids"][c_mod][1] for b in near))

            def ids(folders: list[str]) -> DataFrame:
                return self._read(folders).where((F.col("c_mod") == c_mod) & F.col("doc_id").between(low, high)).select("doc_id")
            known = ids([about["folder"]]).join(ids([b["folder"] for b in near]), "doc_id", "left_semi").agg(F.min("doc_id")).first()[0]
            if known is not None:
                raise DuplicateIds(f"id {known} is already in modality {c_mod} of the pool")
