"""Token counts by source, language and tokenizer version, kept up to date from batches of changes.

A batch holds inserts, deletes and revised counts of documents. It is turned into signed differences against what
earlier batches left, summed up by key, and written to a folder of its own. Totals are the sum over all folders. A batch
reads earlier batches only and overwrites its own folders, so committing it again, or again after a failure half-way, changes nothing.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrain.llm import tokens
from veilgrain.llm.mixing import word_count
from veilgrain.llm.words import slices
from veilgrain.session import delete_at_exit, run_folder, store

KEYS = ["source", "lang", "version"]
DOCS = "batch int, doc_id long, source string, lang string, version string, n_tokens long, live boolean"
DELTAS = "batch int, source string, lang string, version string, n_docs long, n_tokens long"


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)


def commit(spark: SparkSession, root: str, batch: int, changes: DataFrame) -> None:
    """Apply one batch of changes (op, doc_id, source, lang, version, n_tokens) to the rollup under ``root``.

    ``op`` is insert, revise or delete. A document has one count per tokenizer version. An insert or revision replaces
    the count, source and language that the document had under that version, if any; deletes take it away and need
    doc_id and version alone. Deletes of unknown documents, other values of ``op`` and rows with a null id change nothing. If a
    document has several changes in one batch, deletes come last; of several counts the largest holds. A null count is
    0; null sources, languages and versions are keys like others. Batches are numbered in the order of their effect.
    """
    order = F.struct(F.when(F.col("op") == "delete", 1).otherwise(0).alias("o"), F.coalesce("n_tokens", F.lit(0)).alias("n"),
                     "source", "lang")
    new = (
        changes.where("doc_id is not null and op in ('insert', 'revise', 'delete')")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"), "version")
        .agg(F.max(order).alias("x"))
        .select("doc_id", "version", "x.source", "x.lang", F.col("x.n").cast("long").alias("n_tokens"), (F.col("x.o") == 0).alias("live"))
    )
    rows = new.select("doc_id", "source", "lang", "version", "n_tokens", "live")
    rows.write.mode("overwrite").parquet(os.path.join(root, "docs", f"batch={batch}"))
    # each batch writes its own folder: what is read here is what was just written and what earlier batches left
    log = _read(spark, os.path.join(root, "docs"), DOCS).where(F.col("batch") <= batch)
    state = F.struct("batch", "live", "source", "lang", "n_tokens")
    mine = F.when(F.col("batch") == batch, state)
    past = F.when(F.col("batch") < batch, state)
    both = log.groupBy("doc_id", "version").agg(F.max(mine).alias("new"), F.max(past).alias("old")).where("new is not null")
    signed = F.explode(F.array(
        F.struct(F.lit(-1).alias("sign"), F.col("old").alias("s")), F.struct(F.lit(1).alias("sign"), F.col("new").alias("s"))
    ))
    deltas = (
        both.select("version", signed.alias("x"))
        .where("x.s.live")
        .groupBy("x.s.source", "x.s.lang", "version")
        .agg(F.sum("x.sign").alias("n_docs"), F.sum(F.col("x.sign") * F.col("x.s.n_tokens")).alias("n_tokens"))
        .where("n_docs != 0 or n_tokens != 0")
    )
    deltas.write.mode("overwrite").parquet(os.path.join(root, "deltas", f"batch={batch}"))


def totals(spark: SparkSession, root: str) -> DataFrame:
    """(source, lang, version, n_docs, n_tokens) over all committed batches; keys that have nothing left are absent."""
    log = _read(spark, os.path.join(root, "deltas"), DELTAS)
    sums = log.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return sums.where("n_docs != 0")


def counted(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, source, lang, n_words, n_tokens, digest) of whole texts; null texts count 0."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path).encode
        for batch in slices(batches):
            sizes = pa.array([len(x) for x in encode(batch.column(batch.num_columns - 1).to_pylist())], pa.int64())
            names = [*batch.schema.names[:-1], "n_tokens"]
            yield pa.record_batch([*batch.columns[:-1], sizes], names=names)

    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"), word_count(F.col("text")).alias("n_words"),
        F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "text",
    )
    schema = "doc_id long, source string, lang string, n_words long, digest string, n_tokens long"
    return source.mapInArrow(rows, schema)


def corpus_rollup(docs: DataFrame, path: str, version: str, restore: bool = False) -> DataFrame:
    """Totals of a corpus after its life so far: estimates come in, exact counts replace them, copies go.

    Every row is a document under a row key of its own, so that rows with a null id and rows that share an id count.
    Batch 1 inserts every document with its number of words as an estimate; batch 2 revises all counts to those of the
    tokenizer; batch 3 deletes documents whose text an earlier id has, too. With ``restore``, batch 4 inserts them
    again, and the totals are those of all rows. Batch 2 is then committed a second time, as after a lost
    acknowledgement.
    """
    spark = docs.sparkSession
    root = run_folder(spark, "rollup")
    delete_at_exit(spark, root)
    # the keys are stored with the counts, so that all batches see the same ones
    keyed = counted(docs, path).withColumn("row", F.monotonically_increasing_id())
    all_ = store(keyed, "counted").withColumn("version", F.lit(version))
    columns = ["op", F.col("row").alias("doc_id"), "source", "lang", "version", "n_tokens"]
    estimates = all_.withColumn("op", F.lit("insert")).withColumn("n_tokens", F.col("n_words")).select(columns)
    exact = all_.withColumn("op", F.lit("revise")).select(columns)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    first = all_.groupBy("digest").agg(F.min(order).alias("kept"))
    copies = all_.join(first, "digest").where("row != kept.row")
    batches = [(1, estimates), (2, exact), (3, copies.withColumn("op", F.lit("delete")).select(columns))]
    if restore:
        batches.append((4, copies.withColumn("op", F.lit("insert")).select(columns)))
    for batch, changes in (*batches, (2, exact)):
        commit(spark, root, batch, changes)
    return totals(spark, root)
