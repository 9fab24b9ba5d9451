"""Delta-maintained rollups of token counts by source, language and tokenizer version.

An event inserts a document's count, deletes it, or revises it; it is signed, as it holds the count before and after. A
batch of events is summed by key, with partial sums before the shuffle, so a source with a third of all rows is one row
of each task. Totals are additive: they are the sums of the committed batches, and no document is read again.

A batch is committed once: its sums are written to a folder of their own, and a file that names this folder is renamed to
``batch=<id>``, which either happens or doesn't. Committing an id again, after a retry or a replay, changes nothing.
Compaction folds the batches of one listing into a snapshot that names them; a reader uses the latest snapshot and the
batches that it doesn't name.

Null keys form a group of their own. A null text has no tokens. Counts that are null count as zero. Events of an unknown
kind fail the batch before anything is committed. Repeated rows are events of their own. Other columns are ignored; an
empty batch commits and changes nothing.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.llm.common import fs_delete, fs_of, shared, table

KEYS = ["source", "lang", "tokenizer_version"]
SUMS = ["n_docs", "n_tokens", "n_inserts", "n_deletes", "n_revisions"]
SCHEMA = ", ".join([f"{k} string" for k in KEYS] + [f"{s} long" for s in SUMS])
#: Tokenizers that are patterns: each match is a token.
TOKENIZERS = {"words-1": r"[^\x20\x09-\x0D]+", "alnum-1": r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"}


def tokens(text: Column, version: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[version])), F.lit(0)).cast("long")


def events(docs: DataFrame, kind: str, version: str, before: Column | None = None, after: Column | None = None) -> DataFrame:
    """Events of one kind (insert, delete, revise) from documents and their counts before and after."""
    none = F.lit(0).cast("long")
    return docs.select(F.lit(kind).alias("kind"), F.col("source").cast("string"), F.col("lang").cast("string"), F.lit(version).alias("tokenizer_version"), (none if before is None else before).alias("before"), (none if after is None else after).alias("after"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Events that lead from one state of (doc_id, KEYS, n_tokens) to another; ids are distinct in each. A document
    that moves to another source or language is deleted there and inserted here."""
    same = ["doc_id", *KEYS]
    both = old.select(*same, F.col("n_tokens").alias("before")).join(new.select(*same, F.col("n_tokens").alias("after")), same, "full")
    kind = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("revise")
    return both.withColumn("kind", kind).filter("kind <> 'revise' or before <> after").select("kind", *KEYS, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


class Rollup:
    """Totals in ``folder``, a path that executors share. A batch's sums lie in a folder of their own; the file ``batch=<id>``
    names it. Snapshots lie in folders that files ``snapshot=<number>`` name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        fs, path = fs_of(spark, folder)
        fs.mkdirs(path)

    def names(self) -> tuple[list[str], str | None]:
        """One listing: the names of the batches that are there, and of the latest snapshot."""
        fs, path = fs_of(self.spark, self.folder)
        found = sorted(s.getPath().getName() for s in fs.listStatus(path))
        return [n for n in found if n.startswith("batch=")], max((n for n in found if n.startswith("snapshot=")), default=None)

    def named(self, *names: str) -> list[str]:
        """The folders that files name, in any order; one read for all."""
        return [f"{self.folder}/{r[0]}" for r in self.spark.read.text([f"{self.folder}/{n}" for n in names]).collect()] if names else []

    def put(self, name: str, *rows: tuple[str, DataFrame]) -> bool:
        """Write the rows to a new folder, and the file ``name`` by one rename; False, and nothing stays, if there is one."""
        fs, final = fs_of(self.spark, f"{self.folder}/{name}")
        if fs.exists(final):
            return False
        own = f"rows-{uuid.uuid4().hex}"
        for part, df in rows:
            df.write.parquet(f"{self.folder}/{own}/{part}")
        temp = fs_of(self.spark, f"{self.folder}/{own}.tmp")[1]
        out = fs.create(temp)
        out.write(own.encode())
        out.close()
        # Renaming a file never moves it into another one, as it would with a folder.
        if fs.exists(final) or not fs.rename(temp, final):
            fs_delete(self.spark, f"{self.folder}/{own}.tmp")
            fs_delete(self.spark, f"{self.folder}/{own}")
            return False
        return True

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Add a batch of events; False, and no change, if the batch is already there."""
        found, last = self.names()
        if f"batch={batch}" in found or self.folded(last, [batch]):
            return False
        is_ = lambda k: (F.col("kind") == k).cast("long")
        known = F.when(F.col("kind").isin("insert", "delete", "revise"), is_("insert") - is_("delete")).otherwise(F.raise_error(F.lit("unknown kind of event")).cast("long"))
        delta = rows.groupBy(*KEYS).agg(F.sum(known).alias("n_docs"), F.sum(F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))).cast("long").alias("n_tokens"), F.sum(is_("insert")).alias("n_inserts"), F.sum(is_("delete")).alias("n_deletes"), F.sum(is_("revise")).alias("n_revisions"))
        return self.put(f"batch={batch}", ("sums", delta))

    def folded(self, snapshot: str | None, batches: list[str]) -> set[str]:
        """Those of the batches that a snapshot holds."""
        if snapshot is None or not batches:
            return set()
        return {r.batch for r in self.spark.read.schema("batch string").parquet(f"{self.named(snapshot)[0]}/batches").filter(F.col("batch").isin(batches)).collect()}

    def open_(self, found: list[str], last: str | None) -> list[str]:
        """Of the batches found those that the snapshot doesn't hold."""
        ids = [n.removeprefix("batch=") for n in found]
        done = self.folded(last, ids)
        return [i for i in ids if i not in done]

    def sums(self, batches: list[str], last: str | None) -> DataFrame:
        paths = [f"{own}/sums" for own in self.named(*(f"batch={i}" for i in batches), *([last] if last else []))]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*paths).groupBy(*KEYS).agg(*[F.sum(s).alias(s) for s in SUMS])

    def totals(self) -> DataFrame:
        """KEYS and SUMS of all committed batches. Keys whose documents are all gone stay, with zeros."""
        found, last = self.names()
        return self.sums(self.open_(found, last), last)

    def compact(self, listing: tuple[list[str], str | None] | None = None) -> bool:
        """Fold the batches of one listing into a snapshot; one that is committed meanwhile is not in the listing, and stays for
        the next. What the snapshot before it had folded is deleted now, so a reader of that one is not disturbed."""
        found, last = listing or self.names()
        new = self.open_(found, last)
        number = int(last.removeprefix("snapshot=")) + 1 if last else 0
        names = self.spark.createDataFrame([(i,) for i in new], "batch string")
        if last:
            names = names.unionByName(self.spark.read.schema("batch string").parquet(f"{self.named(last)[0]}/batches"))
        if not self.put(f"snapshot={number:08d}", ("sums", self.sums(new, last)), ("batches", names)):
            return False
        for name in [n for n in found if n.removeprefix("batch=") not in new]:
            own = self.named(name)[0]
            fs_delete(self.spark, f"{self.folder}/{name}")
            fs_delete(self.spark, own)
        return True


def op2_token_counts(spark, sf_dir):
    """Three batches over all documents: counts of both tokenizers inserted; counts of words-1 revised where a text
    repeats lines (to its distinct lines); texts without words deleted. The second is committed twice."""
    docs = table(spark, sf_dir, "documents")
    rollup = Rollup(spark, shared(spark, "rollup"))
    inserts = [events(docs, "insert", v, after=tokens(F.col("text"), v)) for v in TOKENIZERS]
    rollup.commit("1-load", inserts[0].unionByName(inserts[1]))
    lines = F.split("text", "\n")
    once = F.array_join(F.array_distinct(lines), "\n")
    repeated = docs.filter(F.size(lines) > F.size(F.array_distinct(lines)))
    revised = events(repeated, "revise", "words-1", tokens(F.col("text"), "words-1"), tokens(once, "words-1"))
    rollup.commit("2-lines", revised)
    rollup.commit("2-lines", revised)
    empty = docs.filter(tokens(F.col("text"), "words-1") == 0)
    gone = [events(empty, "delete", v, before=tokens(F.col("text"), v)) for v in TOKENIZERS]
    rollup.commit("3-empty", gone[0].unionByName(gone[1]))
    return rollup.totals()


OP2_SQL = r"""
with d as (
  select source, lang, coalesce(text, '') as t, string_split(text, chr(10)) as lines from documents
), c as (
  select source, lang,
    len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) as w,
    len(regexp_extract_all(t, '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) as a,
    coalesce(len(lines) > len(list_distinct(lines)), false) as rep,
    coalesce(list_sum(list_transform(list_distinct(lines), lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))), 0) as once
  from d
), e as (
  select source, lang, 'words-1' as tokenizer_version, case when rep then once else w end as n, w, rep from c
  union all
  select source, lang, 'alnum-1', a, w, false from c
)
select source, lang, tokenizer_version,
  cast(sum(case when w = 0 then 0 else 1 end) as bigint) as n_docs,
  cast(sum(case when w = 0 then 0 else n end) as bigint) as n_tokens,
  cast(count(*) as bigint) as n_inserts,
  cast(sum(case when w = 0 then 1 else 0 end) as bigint) as n_deletes,
  cast(sum(case when rep then 1 else 0 end) as bigint) as n_revisions
from e group by source, lang, tokenizer_version
"""
