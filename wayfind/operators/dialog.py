"""Conversations as turns (conv_id, turn, role, text)."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.functions import text as X

#: Fixed values.
DIAGNOSIS = ("diagnosis", "you may have", "it appears", "likely cause", "seems like")
INSUFFICIENT = ("not enough information", "context doesn't contain")
EXIT = ("quit", "exit", "bye")


def any_of(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(w)) for w in words))


def running(*, before: bool = False):
    return Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)


def latch(turns: DataFrame, words=DIAGNOSIS) -> DataFrame:
    """Turns with suggested (a reply up to here names a diagnosis) and notice (this one is the first)."""
    hit = F.when((F.col("role") == "assistant") & any_of(F.col("text"), words), 1).otherwise(0)
    rows = turns.withColumn("_hit", hit)
    return rows.select("conv_id", "turn", "role", (F.max("_hit").over(running()) == 1).alias("suggested"), ((F.col("_hit") == 1) & (F.coalesce(F.max("_hit").over(running(before=True)), F.lit(0)) == 0)).alias("notice"))


def until_exit(turns: DataFrame, words=EXIT) -> DataFrame:
    """Turns before the first in which the user leaves."""
    leaves = F.when((F.col("role") == "user") & F.lower(X.stripped(F.col("text"))).isin(*words), 1).otherwise(0)
    return turns.withColumn("_out", F.max(leaves).over(running())).filter("_out = 0").drop("_out")


def transcript(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, transcript) of the user's and the assistant's turns."""
    who = F.when(F.col("role") == "user", "Patient: ").otherwise("Doctor: ")
    line = F.struct("turn", F.concat(who, F.coalesce("text", F.lit(""))).alias("s"))
    out = turns.filter(F.col("role").isin("user", "assistant")).groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("l"))
    return out.select("conv_id", F.size("l").cast("long").alias("n_turns"), F.array_join(F.transform("l", lambda x: x["s"]), "\n").alias("transcript"))


def pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) of conversations with a patient's turn: an array of (patient, doctor), in order; the doctor is null where
    the next turn isn't a reply."""
    both = turns.filter(F.col("role").isin("user", "assistant"))
    reply = F.lead(F.when(F.col("role") == "assistant", F.col("text"))).over(Window.partitionBy("conv_id").orderBy("turn"))
    said = both.withColumn("doctor", reply).filter("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("patient"), "doctor"))).alias("turns"))
    return said.select("conv_id", F.transform("turns", lambda x: F.struct(x["patient"].alias("patient"), x["doctor"].alias("doctor"))).alias("turns"))


def insufficient(answer: Column) -> Column:
    return F.coalesce(any_of(answer, INSUFFICIENT), F.lit(False))
