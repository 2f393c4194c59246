"""Vector and cache tables as Parquet folders: create, upsert by key, search. Folders are written whole before a pointer names them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:gristmill:node")


class Table:
    """Rows unique by a key. put() adds a folder with the new rows alone; of rows of equal key readers see the one put last.

    A pointer file names the folders of a version and is renamed into place when they are whole, so readers see whole
    versions only. After MOST folders the next put() writes one folder of all, so a row is written again once in MOST
    puts, and the number of folders read stays small. Folders that the version before the last needs stay; older ones go.
    """

    MOST = 16

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str):
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), key, schema

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[int]:
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        names = (f.getPath().getName() for f in fs.listStatus(p))
        return sorted(int(n.removeprefix("current-")) for n in names if n.startswith("current-"))

    def _folders(self, version: int) -> list[str]:
        return json.loads(self.spark.read.text(f"{self.path}/current-{version:08d}").first()[0])

    def version(self) -> int | None:
        found = self._versions()
        return found[-1] if found else None

    def read(self) -> DataFrame:
        v = self.version()
        return self._read(self._folders(v)) if v is not None else self.spark.createDataFrame([], self.schema)

    def _read(self, folders: list[str]) -> DataFrame:
        names = self.spark.createDataFrame([], self.schema).columns
        rows = None
        for i, f in enumerate(folders):
            part = self.spark.read.schema(self.schema).parquet(f"{self.path}/{f}").withColumn("__n", F.lit(i))
            rows = part if rows is None else rows.unionByName(part)
        if len(folders) == 1:
            return rows.drop("__n")
        last = rows.groupBy(self.key).agg(F.max(F.struct("__n", *(F.col(n) for n in names if n != self.key))).alias("r")) if self._sortable() else None
        if last is not None:
            return last.select(*(F.col(n) if n == self.key else F.col(f"r.{n}").alias(n) for n in names))
        newest = rows.groupBy(self.key).agg(F.max("__n").alias("__n"))
        return rows.join(newest, [self.key, "__n"], "left_semi").select(*names)

    def _sortable(self) -> bool:
        return not any("map" in f.dataType.simpleString() for f in self.spark.createDataFrame([], self.schema).schema)

    def put(self, rows: DataFrame, overwrite: bool = False) -> None:
        """Of rows that share a key one stays. overwrite: the rows replace all there are."""
        names = self.spark.createDataFrame([], self.schema).columns
        new = rows.select(*names).dropDuplicates([self.key])
        v = self.version()
        folders = [] if overwrite or v is None else self._folders(v)
        own = f"v-{uuid.uuid4().hex}"
        new.write.parquet(f"{self.path}/{own}")
        folders = [*folders, own]
        if len(folders) > self.MOST:
            whole = f"v-{uuid.uuid4().hex}"
            self._read(folders).write.parquet(f"{self.path}/{whole}")
            folders = [whole]
        self._point((v or 0) + 1, folders)

    def _point(self, version: int, folders: list[str]) -> None:
        fs, temporary = self._fs(f"{self.path}/_{uuid.uuid4().hex}")
        out = fs.create(temporary)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        _, final = self._fs(f"{self.path}/current-{version:08d}")
        if not fs.rename(temporary, final):
            fs.delete(temporary, False)
            raise RuntimeError(f"version {version} was written by another writer")
        self._clean(version)

    def _clean(self, version: int) -> None:
        """Removes pointers before the last two, and folders that neither of those names."""
        versions = [v for v in self._versions() if v <= version]
        kept = {f for v in versions[-2:] for f in self._folders(v)}
        for v in versions[:-2]:
            gone = set(self._folders(v)) - kept
            for name in [*gone, f"current-{v:08d}"]:
                fs, p = self._fs(f"{self.path}/{name}")
                fs.delete(p, True)

    def pending(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.read().select(self.key), self.key, "left_anti")


VECTORS = "node_id string, point_id string, is_leaf boolean, text string, graph_kind string, entity_ids array<string>, source_chunk_ids array<string>, dense array<float>, tokens array<array<float>>"


def point_id(key):
    """UUID version 5 of the node id, from SHA-1 alone."""
    digest = F.sha1(F.concat(F.lit(NAMESPACE.bytes), key.cast("binary")))
    part = lambda a, n: F.substring(digest, a, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


class VectorStore(Table):
    """Dense and token vectors with their payload, graph fields included. Sizes must be positive and those of the table."""

    def __init__(self, spark: SparkSession, path: str, dense_size: int, token_size: int | None = None):
        if dense_size < 1 or (token_size is not None and token_size < 1):
            raise ValueError("vector sizes must be positive")
        super().__init__(spark, path, "node_id", VECTORS)
        self.dense_size, self.token_size = dense_size, token_size

    def upsert(self, rows: DataFrame, overwrite: bool = False) -> None:
        names = self.spark.createDataFrame([], VECTORS).columns
        kinds = {f.name: f.dataType for f in self.spark.createDataFrame([], VECTORS).schema}
        full = rows.withColumn("point_id", point_id(F.col("node_id")))
        full = full.select(*((F.col(n) if n in full.columns else F.lit(None)).cast(kinds[n]).alias(n) for n in names))
        ok = F.when(F.size("dense") == self.dense_size, F.col("dense")).otherwise(F.raise_error(F.concat(F.lit("wrong vector size: "), "node_id")))
        self.put(full.withColumn("dense", ok), overwrite)

    def ensure(self) -> bool:
        """Makes an empty table if there is none; False if there is one. One of other vector sizes is an error."""
        sizes = self.read().where("dense is not null").select(F.size("dense").alias("n")).limit(1).collect()
        if sizes and sizes[0]["n"] != self.dense_size:
            raise ValueError(f"the vectors there have size {sizes[0]['n']}")
        if self.version() is not None:
            return False
        self.recreate()
        return True

    def recreate(self) -> None:
        """An empty table in place of what there is."""
        self.put(self.spark.createDataFrame([], VECTORS), overwrite=True)

    def search_tokens(self, questions: DataFrame, k: int, where: str | None = None) -> DataFrame:
        """(query_id, node_id, score, rank) by late interaction over the token matrices; questions: query_id, q (token matrix)."""
        from gristmill.operators.retrieval import max_sim_top

        rows = self.read() if where is None else self.read().where(where)
        return max_sim_top(rows.select("node_id", "tokens"), questions, k)

    def search(self, questions: DataFrame, k: int, where: str | None = None) -> DataFrame:
        """(query_id, node_id, score, rank) by cosine over the dense vectors; `where` is pushed into the scan."""
        from gristmill.operators.retrieval import dense

        if k <= 0:
            return self.spark.createDataFrame([], "query_id long, node_id string, score double, rank int")
        rows = self.read() if where is None else self.read().where(where)
        norm = lambda c: F.transform(c, lambda x: x.cast("double") / F.greatest(F.sqrt(F.aggregate(c, F.lit(0e0), lambda s, y: s + y.cast("double") * y.cast("double"))), F.lit(1e-12)))
        return dense(rows.select("node_id", norm(F.col("dense")).alias("v")), questions.select("query_id", norm(F.col("q")).alias("q")), k)


def manifest(counts: DataFrame, config: dict) -> str:
    """A JSON manifest of all per-kind counts (kind, n): a driver's document, so kinds are names of a schema, not of data."""
    return json.dumps({"config": config, "counts": {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).orderBy("kind").collect()}}, sort_keys=True)
