"""Where an index, its caches and chat sessions are kept: Parquet and JSON below one path."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.graph import GraphTables


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


class Versions:
    """Numbered folders below one path. A version counts once its mark is there, which is made last and in one step.

    Readers take the latest marked version, so they see a whole one whatever a writer is doing or has left behind.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self) -> list[str]:
        if not self._fs.exists(self._at(self.path)):
            return []
        return sorted(n for s in self._fs.listStatus(self._at(self.path)) if (n := s.getPath().getName()).startswith("v"))

    def begin(self, kind: str = "full") -> str:
        """A new version's path, later than all there are; its data goes below."""
        last = max((int(n[1:13]) for n in self._names()), default=0)
        return f"{self.path}/v{last + 1:012d}-{kind}-{uuid.uuid4().hex}"

    def commit(self, version: str) -> None:
        self._fs.create(self._at(f"{version}/DONE"), True).close()

    def done(self) -> list[str]:
        """Paths of the versions that count, oldest first."""
        return [f"{self.path}/{n}" for n in self._names() if self._fs.exists(self._at(f"{self.path}/{n}/DONE"))]

    def latest(self) -> str | None:
        return (self.done() or [None])[-1]

    def drop_before(self, version: str) -> None:
        """Deletes the versions older than this one; their readers fail."""
        for old in self.done():
            if old < version:
                self._fs.delete(self._at(old), True)


class IndexStore:
    """Chunks (with vectors, questions, coordinates and labels) and the graph of one corpus, saved as one version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, f"{self.path}/versions")

    def save(self, chunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> None:
        """The version before the new one stays for those who read it now; older ones go."""
        before, version = self.versions.latest(), self.versions.begin()
        chunks.write.parquet(f"{version}/chunks")
        GraphTables(self.spark, f"{version}/graph").write(nodes, edges)
        self.versions.commit(version)
        if before:
            self.versions.drop_before(before)

    def _latest(self) -> str:
        version = self.versions.latest()
        if version is None:
            raise FileNotFoundError(f"{self.path}: build the index first")
        return version

    def load(self) -> DataFrame:
        """The chunks; an error says what is missing."""
        version = self._latest()
        for part in ("chunks", "graph/nodes", "graph/edges"):
            if not path_exists(self.spark, f"{version}/{part}/_SUCCESS"):
                raise FileNotFoundError(f"{version}/{part}: build the index first")
        return self.spark.read.parquet(f"{version}/chunks")

    @property
    def graph(self) -> GraphTables:
        return GraphTables(self.spark, f"{self._latest()}/graph")


class ValueCache:
    """Computed values by content hash; appended to, never rewritten. An unreadable cache is an empty one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path).dropDuplicates(["key"])
        except Exception as e:  # an absent or damaged cache is no error
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e) or "CANNOT_READ_FILE_FOOTER" in str(e):
                return None
            raise

    def append(self, new: DataFrame) -> None:
        new.select("key", "value").write.mode("append").parquet(self.path)


class SessionStore:
    """Chat sessions as JSON: (id, name, created_at, docs, messages).

    A version holds all sessions or, after a message, the one session that changed; the latest state of each counts.
    A writer that fails midway leaves everything as it was.
    """

    SCHEMA = "id string, name string, created_at timestamp, docs array<string>, chunk_count int, messages array<struct<role:string,content:string>>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.versions = Versions(spark, path)

    def load(self) -> DataFrame:
        done = self.versions.done()
        full = [i for i, v in enumerate(done) if "-full-" in v]
        live = done[full[-1] :] if full else done
        if not live:
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(self.SCHEMA).json([f"{v}/sessions" for v in live])
        latest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("written_in")))
        return rows.withColumn("written_in", F.regexp_extract(F.col("_metadata.file_path"), r"/(v\d{12}-[^/]+)/sessions/", 1)).withColumn("n", latest).where("n = 1").drop("written_in", "n")

    def _put(self, sessions: DataFrame, kind: str) -> str:
        version = self.versions.begin(kind)
        sessions.write.json(f"{version}/sessions")
        self.versions.commit(version)
        return version

    def save(self, sessions: DataFrame) -> None:
        """These are all sessions from now on. The last whole version before stays for those who read it now."""
        full = [v for v in self.versions.done() if "-full-" in v]
        self._put(sessions, "full")
        if full:
            self.versions.drop_before(full[-1])

    def append_exchange(self, session_id: str, question: str, answer: str) -> None:
        """Adds a question and its answer; writes that session alone. An unknown session is an error."""
        message = lambda role, text: F.struct(F.lit(role).alias("role"), F.lit(text).alias("content"))
        more = F.concat(F.coalesce("messages", F.array().cast("array<struct<role:string,content:string>>")), F.array(message("user", question), message("assistant", answer)))
        one = self.load().where(F.col("id") == session_id)
        if one.isEmpty():
            raise KeyError(session_id)
        self._put(one.withColumn("messages", more), "one")


def session_summary(turns: DataFrame) -> DataFrame:
    """One row a conversation (conv_id, turn, role, text): its turns, the roles' shares and the first and last text."""
    first = F.min(F.struct("turn", "text"))["text"]
    last = F.max(F.struct("turn", "text"))["text"]
    is_ = lambda role: F.sum(F.when(F.col("role") == role, 1).otherwise(0))
    return turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_messages"), is_("user").alias("n_user"), is_("assistant").alias("n_assistant"), first.alias("first_text"), last.alias("last_text"), F.sum(F.length("text")).alias("n_chars")
    )


def url_section_path(url: Column) -> Column:
    """Host and directories of an address, as a heading path of three at most."""
    parts = F.filter(F.split(F.regexp_replace(url, r"^[a-z]+://", ""), "[/?#]"), lambda p: p != "")
    return F.slice(parts, 1, 3)

