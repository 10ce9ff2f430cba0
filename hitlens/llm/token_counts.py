"""Token counts kept by signed changes.

Totals by source, language and tokenizer version are sums, so a change is a signed row: +1 for an
insert, -1 for a delete, both for a revised count. A batch adds up its rows before they are
shuffled and is committed under its name: a folder of its own, whole once Spark has
written its success mark. Committing a name again does nothing, and an attempt that broke off is
written anew, so that a batch counts once whatever happens.

Null sources, languages and texts are groups and empty texts like any other; repeated rows count
each; an empty batch changes nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Tokenizer versions, as counts of a text: runs without spaces; words and single signs.
RUNS, WORDS = r"[^ \t\n\r]+", r"[\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\r]"
TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "runs-1": lambda text: F.regexp_count(text, F.lit(RUNS)).cast("long"),
    "words-2": lambda text: F.regexp_count(text, F.lit(WORDS)).cast("long"),
}
KEYS = ("source", "lang", "tokenizer")
_SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long"


def counted(df: DataFrame, text: Column, name: str, tokenizers: Mapping = TOKENIZERS) -> DataFrame:
    """Add ``name``: a map from tokenizer version to the number of tokens of a text."""
    pairs = [x for version, count in sorted(tokenizers.items()) for x in (
        F.lit(version), F.coalesce(count(F.coalesce(text, F.lit(""))), F.lit(0).cast("long")))]
    return df.withColumn(name, F.create_map(*pairs))


def signed(df: DataFrame, counts: str, sign: int, source: str = "source",
           lang: str = "lang") -> DataFrame:
    """Signed rows of documents: one per tokenizer version in the map ``counts``."""
    return df.select(
        F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"),
        F.explode(counts).alias("tokenizer", "tokens")).select(
        *KEYS, F.lit(sign).cast("long").alias("documents"),
        (F.col("tokens") * sign).alias("tokens"))


def inserts(df: DataFrame, counts: str) -> DataFrame:
    return signed(df, counts, 1)


def deletes(df: DataFrame, counts: str) -> DataFrame:
    return signed(df, counts, -1)


def revisions(df: DataFrame, old: str, new: str) -> DataFrame:
    return deletes(df, old).unionByName(inserts(df, new))


class Ledger:
    """Committed batches of signed changes under a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, batch: str) -> str:
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("batch names are letters, digits, - and _")
        return f"{self.path}/batch={batch}"

    def committed(self, batch: str) -> bool:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._folder(batch)}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False if it was there already and nothing was done."""
        if self.committed(batch):
            return False
        (added(changes).write.mode("overwrite")
         .option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
         .parquet(self._folder(batch)))
        return True

    def batches(self) -> list[str]:
        """Names of the committed batches."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(n[6:] for n in names if n.startswith("batch=") and self.committed(n[6:]))

    def totals(self) -> DataFrame:
        """Totals of all committed batches; groups whose documents and tokens are 0 are left out."""
        folders = [self._folder(b) for b in self.batches()]
        if not folders:
            return self.spark.createDataFrame([], _SCHEMA)
        return added(self.spark.read.schema(_SCHEMA).parquet(*folders))


def added(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*KEYS).agg(F.sum("documents").alias("documents"),
                                      F.sum("tokens").alias("tokens")).where(
        (F.col("documents") != 0) | (F.col("tokens") != 0))


# Fixed value: signs of the junk that the revision takes out.
JUNK = "[%&$#*]{3}"


def replay(documents: DataFrame, ledger: Ledger, scratch: str) -> DataFrame:
    """The history of a corpus as batches: load all documents, revise the counts of those with
    junk signs, withdraw all but the first of equal texts, and send the load once more.

    Texts are read once; the counts per document are written to ``scratch``. Withdrawing takes
    all documents out and the first of each text in again, both added up before the shuffle, so
    a text with very many copies makes no hot group.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select("doc_id", "source", "lang", text.alias("text"))
    rows = rows.select("*", F.regexp_replace("text", JUNK, "").alias("clean"),
                       F.md5(F.col("text").cast("binary")).alias("key"))
    rows = counted(rows, F.col("text"), "first")
    changed = F.col("clean") != F.col("text")
    rows = counted(rows, F.when(changed, F.col("clean")), "second")
    rows = rows.select("doc_id", "source", "lang", "key", "first", changed.alias("revised"),
                       F.when(changed, F.col("second")).otherwise(F.col("first")).alias("now"))
    spark = documents.sparkSession
    schema = rows.schema
    rows.write.parquet(scratch)
    rows = spark.read.schema(schema).parquet(scratch)
    kept = rows.select("key", F.struct(
        "doc_id", "source", "lang", F.map_entries("now").alias("now")).alias("row")).groupBy(
        "key").agg(F.min("row").alias("row")).select(
        "row.source", "row.lang", F.map_from_entries("row.now").alias("now"))
    ledger.commit("load", inserts(rows, "first"))
    ledger.commit("revision", revisions(rows.where("revised"), "first", "now"))
    ledger.commit("withdrawal", deletes(rows, "now").unionByName(inserts(kept, "now")))
    ledger.commit("load", inserts(rows, "first"))
    return ledger.totals()


ORACLE = f"""
with d as (select doc_id, source, lang, coalesce(text, '') as body from documents),
k as (select source, lang, regexp_replace(body, '{JUNK}', '', 'g') as body from d
      qualify row_number() over (partition by md5(body)
        order by doc_id nulls first, source nulls first, lang nulls first) = 1),
c as (select source, lang, unnest(['runs-1', 'words-2']) as tokenizer,
        unnest([len(regexp_extract_all(body, '{RUNS}')),
                len(regexp_extract_all(body, '{WORDS}'))])::bigint as tokens from k)
select source, lang, tokenizer, count(*)::bigint as documents, sum(tokens)::bigint as tokens
from c group by all"""
