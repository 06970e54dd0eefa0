"""Index artefacts as Parquet: chunks, postings, vectors; and the opened index that questions are asked of.

Postings lie in buckets by chunk_id, sorted by token: the sums of a question's tokens over a chunk need no shuffle, and row
groups without any of the questions' tokens are skipped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import RetrievalConfig
from quillspark.functions.encode import DenseEncoder, SparseEncoder, hashed_vectors, token_weights
from quillspark.operators.ranking import content_key
from quillspark.plans.lineage import released

ARTEFACTS = ("chunks", "postings", "vectors")
BUCKETS = 64  # of a new index; grows with the corpus by parameter
PUSHED_TOKENS = 1000  # distinct tokens that are pushed to the scan of the postings; with more the join alone selects
POSTINGS = "chunk_id BIGINT, token STRING, weight DOUBLE"


class NotReady(RuntimeError):
    """The index or a model that the pipeline needs is missing."""


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _table(where: str) -> str:
    return "quillspark_postings_" + hashlib.md5(where.encode()).hexdigest()


def missing(spark: SparkSession, directory: str) -> list[str]:
    return [a for a in ARTEFACTS if not _exists(spark, f"{directory}/{a}/_SUCCESS")]


def build_index(
    chunks: DataFrame,
    directory: str,
    vectors: DataFrame | None = None,
    rebuild: bool = False,
    sparse: SparseEncoder | None = token_weights,
    dense: DenseEncoder | None = hashed_vectors,
    buckets: int = BUCKETS,
    parts: int = 1,
) -> list[str]:
    """Write what is missing, all of it on rebuild; the names written. Every artefact comes from the one chunk table.

    Vectors are given (chunk_id, embedding) or come from the dense encoder. Without a sparse encoder the postings stay
    empty, and the index answers from its dense half alone. An empty chunk table gives empty artefacts.

    Texts are sent to their bucket before they are encoded, so that sums over a chunk's tokens need no exchange of the
    tokens, which are several times the texts; parts is the number of tasks, and of files, a bucket.
    """
    spark = chunks.sparkSession
    todo = list(ARTEFACTS) if rebuild else missing(spark, directory)
    if "chunks" in todo:
        todo = list(ARTEFACTS)  # artefacts of another chunk table would not match
    placed = chunks.repartition(buckets * parts, "chunk_id")  # a task has chunks of one bucket only
    for name in todo:
        where = f"{directory}/{name}"
        with released(spark):
            if name == "chunks":
                chunks.withColumn("doc_key", content_key()).write.mode("overwrite").parquet(where)
            elif name == "vectors":
                found = vectors if vectors is not None else dense(placed.where("content IS NOT NULL"), "chunk_id", "content") if dense else spark.createDataFrame([], "chunk_id bigint, embedding array<double>")
                found.where("embedding IS NOT NULL").write.mode("overwrite").parquet(where)
            else:
                found = sparse(placed.select("chunk_id", "content"), "chunk_id", "content") if sparse else spark.createDataFrame([], POSTINGS)
                spread = found.select(F.col("chunk_id").cast("bigint").alias("chunk_id"), "token", F.col("weight").cast("double").alias("weight"))
                spark.sql(f"DROP TABLE IF EXISTS {_table(where)}")
                spread.write.mode("overwrite").bucketBy(buckets, "chunk_id").sortBy("token", "chunk_id").option("path", where).format("parquet").saveAsTable(_table(where))
                spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{directory}/postings_layout")
    return todo


@dataclass
class Index:
    """An opened index with the encoders that questions go through, which must be those it was built with."""

    chunks: DataFrame  # chunk_id, source, page_number, content, customer, clause, hierarchy, doc_key
    postings: DataFrame  # chunk_id, token, weight
    vectors: DataFrame  # chunk_id, embedding
    names: DataFrame  # name
    sparse: SparseEncoder | None = token_weights
    dense: DenseEncoder | None = hashed_vectors
    cfg: RetrievalConfig = field(default_factory=RetrievalConfig)

    def postings_of(self, tokens: Iterable[str]) -> DataFrame:
        """The postings; restricted to the tokens where these are few enough to be pushed to the scan."""
        known = list(tokens)
        return self.postings.where(F.col("token").isin(known)) if 0 < len(known) <= PUSHED_TOKENS else self.postings


def read_index(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One artefact. Postings keep their buckets, also in a session that did not write them."""
    where = f"{directory}/{name}"
    if name != "postings":
        return spark.read.parquet(where)
    if not spark.catalog.tableExists(_table(where)):
        buckets = spark.read.parquet(f"{directory}/postings_layout").first()[0]
        spark.sql(f"CREATE TABLE {_table(where)} ({POSTINGS}) USING parquet OPTIONS (path '{where}') CLUSTERED BY (chunk_id) SORTED BY (token, chunk_id) INTO {buckets} BUCKETS")
    return spark.table(_table(where))


def open_index(spark: SparkSession, directory: str, names: DataFrame | None = None, sparse: SparseEncoder | None = token_weights, dense: DenseEncoder | None = hashed_vectors, cfg: RetrievalConfig = RetrievalConfig()) -> Index:
    """The index of a folder, ready for questions; NotReady, with what is missing, where it isn't complete."""
    lacking = missing(spark, directory)
    if lacking:
        raise NotReady("System not ready. Details: " + " ".join(f"{name} missing." for name in lacking))
    names = spark.createDataFrame([], "name string") if names is None else names
    return Index(*[read_index(spark, directory, a) for a in ARTEFACTS], names, sparse, dense, cfg)
