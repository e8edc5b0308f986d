"""The corpus pipeline: toxicity, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept; ``run`` writes every stage's
result to the shared folder and reads it back for the next.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tesserae.llm import decontam, jaccard, mixing, sharding, toxicity
from tesserae.storage import keep_ids, materialise, small_side

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL cannot express the trained models and the random paths of the first two stages; tests hold the stages against brute force.
ORACLE_SQL = None


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__key``, a text that is equal for rows that are equal in all columns alone, and in the order of ids with
    the null id last.  So rows with a null id, and different rows with one id, are told apart."""
    part = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    digest = F.md5(F.concat(*(part(F.col(c)) for c in COLUMNS)).cast("binary"))
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        first = F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0")
        return docs.withColumn("__key", F.concat(F.coalesce(first, F.lit("9" * 20)), digest))
    return docs.withColumn("__key", F.concat(F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit("n")), F.lit(" "), digest))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models do not reject; labels are learnt from the labelled rows among ``docs``.

    Every row is judged by its text alone: rows with null ids and repeated rows too; null and empty texts have no toxic
    token.  An empty table gives an empty one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rest = tuple(c for c in COLUMNS if c != "doc_id")
    return toxicity.score_toxicity(docs, labels, keep=rest).where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones: that with the smallest id, a null id being the largest, ties by digest.

    Rows that are equal in all columns are one document.  Texts without words are similar to none, so different rows without
    words all stay, as do different texts that share an id.  An empty table gives an empty one.
    """
    rows = keyed(docs)
    classes = jaccard.join_similar(rows.select("__key", "text"), id_col="__key")
    copies = materialise(classes.where("doc_id != class_id").select(F.col("doc_id").alias("__key")))
    kept = keep_ids(rows, copies, "__key", "left_anti")
    repeated = materialise(rows.groupBy("__key").count().where("count > 1"))
    once = keep_ids(kept, repeated, "__key", "left_anti")
    firsts = keep_ids(kept, repeated, "__key", "left_semi").groupBy("__key").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return once.select(*COLUMNS).unionByName(firsts.select("row.*").select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item.

    A row goes for its own text alone, whatever other rows have its id, and with a null id too; null and empty texts overlap
    nothing.  An empty table, or an empty benchmark, leaves all rows.
    """
    rows = keyed(docs)
    leaks = decontam.find_leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="__key")
    return keep_ids(rows, leaks.select(F.col("doc_id").alias("__key")), "__key", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: words taken over size, rounded; one that is taken at all stays at least
    once, and so does one without words, which takes none of the mix's budget.

    Rows that agree in id, source and size, null ones too, share what the mix takes of them evenly.  An empty table gives an
    empty one.
    """
    place = F.to_json(F.struct("doc_id", "source", "size"))
    taken = mixing.mix_documents(docs).where("size > 0").groupBy(place.alias("__place")).agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = F.when(F.col("taken") > 0, F.greatest(F.lit(1), F.round(F.col("taken") / F.col("size")))).otherwise(0).cast("int")
    changed = taken.withColumn("times", times).where("times != 1").select("__place", "times")
    rows = docs.withColumn("size", mixing.word_count(F.col("text"))).withColumn("__place", place)
    return repeat_rows(rows, changed, "__place").select(*COLUMNS)


def repeat_rows(docs: DataFrame, times: DataFrame, on: str) -> DataFrame:
    """Each row as often as ``times`` says for its key, in one pass over the rows; keys that are not listed stay as they are."""
    listed = small_side(materialise(times.select(on, F.col("times").alias("__times"))))
    copies = F.array_repeat(F.lit(0), F.coalesce("__times", F.lit(1)))
    return docs.join(listed, on, "left").withColumn("__copy", F.explode(copies)).drop("__copy", "__times")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document of the mix; repeats of a document share a shard and have slots of their own."""
    return sharding.assign_shards(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
