"""The diagnosis latch over a stream of turns: state is one flag for each conversation."""

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayfind.operators.dialog import DIAGNOSIS, any_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTPUT = "conv_id long, turn long, notice boolean"


def first_hit(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Of a conversation's new turns (conv_id, turn, hit) those that are its first hit."""
    rows = pd.concat(list(parts)).sort_values("turn")
    said = state.get[0] if state.exists else False
    first = rows["hit"] & (rows["hit"].cumsum() == 1) & (not said)
    state.update((bool(said or rows["hit"].any()),))
    yield pd.DataFrame({"conv_id": rows["conv_id"], "turn": rows["turn"], "notice": first})


def notices(turns: DataFrame, words=DIAGNOSIS) -> DataFrame:
    """(conv_id, turn, notice) of a stream of turns (conv_id, turn, role, text): notice marks the first reply that names a
    diagnosis. What a reply says is decided by columns. Turns of a conversation must arrive in order over batches; within one
    they are sorted. streaming/sessions.py has no such need, and lets go of old conversations."""
    hit = F.coalesce((F.col("role") == "assistant") & any_of(F.col("text"), words), F.lit(False))
    return turns.select("conv_id", "turn", hit.alias("hit")).groupBy("conv_id").applyInPandasWithState(first_hit, OUTPUT, "said boolean", "append", GroupStateTimeout.NoTimeout)
