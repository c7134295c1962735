"""Stored tables and indexes: upserts and deletes by appending, a BM25 index, vectors by cluster."""

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions.text import index_tokens
from docweave.operators import retrieval


class Folder:
    """Tables of appended batches under one path; a batch counts once its entry is written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.batches = sorted(self._names())

    def _at(self, name: str) -> tuple:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        path, fs = self._at("batches")
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _has(self, name: str) -> bool:
        path, fs = self._at(name)
        return fs.exists(path)

    def _tag(self) -> str:
        return f"{len(self.batches):06d}-{uuid.uuid4().hex[:8]}"

    def _count(self, tag: str) -> None:
        path, fs = self._at(f"batches/{tag}")
        fs.mkdirs(path)
        self.batches.append(tag)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}").where(F.col("batch").isin(self.batches))


class TableStore(Folder):
    """Rows by key: later rows replace earlier ones, deleted keys are gone until they come again.

    Nothing is rewritten; `load` takes the last row of each key, and `compact` writes them anew. A
    later session goes on by opening the same path.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        super().__init__(spark, path)
        self.keys = keys

    def upsert(self, rows: DataFrame) -> None:
        """Append rows; each key must come once among them. Rows without a key are left out."""
        tag = self._tag()
        rows.dropna(subset=self.keys).write.parquet(f"{self.path}/rows/batch={tag}")
        self._count(tag)

    def delete(self, gone: DataFrame) -> None:
        tag = self._tag()
        gone.select(*self.keys).dropna().distinct().write.parquet(f"{self.path}/gone/batch={tag}")
        self._count(tag)

    def load(self) -> DataFrame:
        rows = self._read("rows")
        last = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*self.keys).orderBy(F.desc("batch")))).where("__n = 1").drop("__n")
        if self._has("gone"):
            gone = self._read("gone").groupBy(*self.keys).agg(F.max("batch").alias("__gone"))
            last = last.join(gone, self.keys, "left").where("__gone is null or batch > __gone").drop("__gone")
        return last.drop("batch")

    def compact(self, path: str) -> "TableStore":
        """The rows that are there as one batch of a new store."""
        new = TableStore(self.spark, path, self.keys)
        new.upsert(self.load())
        return new


class Bm25Index(Folder):
    """Postings, term counts and sizes of documents, added to in batches and read again for every search.

    Postings are parted by buckets of their terms, so a search reads those of its terms only. An id
    must be added once.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        super().__init__(spark, path)
        self.buckets = buckets

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")

    def add(self, docs: DataFrame, id_col: str, text_col: str) -> None:
        tag = self._tag()
        posted = retrieval.postings(docs, id_col, text_col).withColumn("bucket", self._bucket())
        posted.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/postings/batch={tag}")
        written = self.spark.read.parquet(f"{self.path}/postings/batch={tag}") if self._written(tag) else posted.limit(0)
        written.groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{self.path}/terms/batch={tag}")
        docs.agg(F.count("*").alias("docs")).crossJoin(written.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("terms"))).write.parquet(f"{self.path}/sizes/batch={tag}")
        self._count(tag)

    def _written(self, tag: str) -> bool:
        path, fs = self._at(f"postings/batch={tag}")
        return any(s.isDirectory() for s in fs.listStatus(path))

    def search(self, queries: DataFrame, id_col: str, query_id: str, query_col: str, k: int = 30) -> DataFrame:
        """(query id, id, score, rank), as `retrieval.bm25`."""
        asked = retrieval.asked_terms(queries, query_id, query_col)
        needed = [r[0] for r in asked.select(self._bucket()).distinct().collect()]  # at most `buckets`
        posted = self._read("postings").where(F.col("bucket").isin(needed))
        df = self._read("terms").groupBy("term").agg(F.sum("df").alias("df"))
        stats = self._read("sizes").agg(F.sum("docs").alias("docs"), (F.sum("terms") / F.sum("docs")).alias("avg_len"))
        return retrieval.scored(posted, df, stats, asked, k).withColumnsRenamed({"query": query_id, "id": id_col})


def clustered(vectors: DataFrame, vector_col: str, clusters: int, sample: int = 20_000, seed: int = 7):
    """A k-means model of the vectors, fitted on at most `sample` of them (a documented bound)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.where(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(vector_col)).limit(sample)
    return KMeans(k=clusters, seed=seed, maxIter=10).fit(rows.select(array_to_vector(vector_col).alias("features")))


def ivf_nearest(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, query_id: str, query_vector: str, k: int = 10, clusters: int = 16, probes: int = 4, dim: int = 64) -> DataFrame:
    """(query id, id, distance, rank) as `retrieval.nearest` by squared distance, among the `probes` clusters nearest to a query.

    Every vector is in one cluster; which clusters are searched is the only approximation.
    """
    from pyspark.ml.functions import array_to_vector

    model = clustered(vectors.where(F.size(vector_col) == dim), vector_col, clusters)
    centers = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in model.clusterCenters()))
    placed = model.transform(vectors.where(F.size(vector_col) == dim).withColumn("features", array_to_vector(vector_col))).drop("features").withColumnRenamed("prediction", "cluster")
    far = F.transform(centers, lambda c, i: F.struct(F.aggregate(F.zip_with(c, query_vector, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x).alias("d"), i.alias("cluster")))
    probed = queries.where(F.size(query_vector) == dim).withColumn("probe", F.explode(F.slice(F.array_sort(far), 1, probes)["cluster"])).select(query_id, query_vector, "probe")
    return retrieval.nearest(placed, probed, id_col, vector_col, query_id, query_vector, k, "l2", F.col("cluster"), F.col("probe"), dim=dim)
