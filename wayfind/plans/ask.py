"""Questions to answers, for whole tables of questions."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfind.functions import text as X
from wayfind.operators import context as C
from wayfind.operators import search as S
from wayfind.operators.adjacency import bounded_context
from wayfind.operators.dialog import insufficient
from wayfind.operators.paths import multi_hop_batch
from wayfind.plans import models as M
from wayfind.plans.routed import Route, routed
from wayfind.sources.graph import Graph
from wayfind.sources.log import Log
from wayfind.sources.store import kept, sized

CLIP = 301  # characters that travel of a text: lines clip at 300 at most, and must see that there are more


def contexts(graph: Graph, questions: DataFrame, limit: int = 15) -> DataFrame:
    """(qid, question, entity, context) of questions (qid, question, entity). An entity that isn't given is taken from
    the question; each entity is searched and expanded once, whatever the number of questions that ask for it."""
    asked = questions.select("qid", "question", F.coalesce("entity", X.entity(F.col("question"))).alias("entity"))
    top = S.scored_batch(graph, asked, limit).withColumn("text", F.left("text", F.lit(CLIP)))
    short = Graph(graph.nodes.withColumn("text", F.left("text", F.lit(CLIP))), graph.edges)
    rows = S.expanded(top, short, few=True)
    found = C.joined(C.lines(rows, [F.col("rank"), F.col("edge_id").asc_nulls_first()], ["needle"]), ["needle"])
    before, after = C.NOTHING.split("{}")
    nothing = F.concat(F.lit(before), F.col("entity"), F.lit(after))
    text = F.when(F.col("entity").isNull(), C.NO_ENTITY).otherwise(F.coalesce("context", nothing))
    return asked.join(found, asked.entity == found.needle, "left").select("qid", "question", "entity", text.alias("context"))


def bounded_contexts(graph, questions: DataFrame, limit: int = 15, most: int = 4500) -> DataFrame:
    """What contexts() gives, cut to ``most`` characters and with the whole length as context_length, for a graph with segments: no
    hub's lines are collected."""
    asked = questions.select("qid", "question", F.coalesce("entity", X.entity(F.col("question"))).alias("entity"))
    found = bounded_context(S.scored_batch(graph, asked, limit), graph.segments(), graph.nodes, most=most + 1)
    before, after = C.NOTHING.split("{}")
    nothing = F.when(F.col("entity").isNull(), C.NO_ENTITY).otherwise(F.concat(F.lit(before), F.col("entity"), F.lit(after)))
    text = F.coalesce("context", nothing)
    return asked.join(found, asked.entity == found.needle, "left").select("qid", "question", "entity", text.alias("context"), F.coalesce(F.col("context_length"), F.length(text)).cast("int").alias("context_length"))


def ask(graph: Graph, questions: DataFrame, limit: int = 15, make=M.Extract, backend: str = "extract", bounded: bool = False) -> DataFrame:
    """Answer records of questions (qid, question, entity). ``bounded``: contexts in the records are cut, as prompts are."""
    rows = bounded_contexts(graph, questions, limit) if bounded else contexts(graph, questions, limit)
    return M.record(M.answered(rows.withColumn("prompt", C.prompt(F.col("question"), F.col("context"))), make, backend))


def ask_routed(graph: Graph, questions: DataFrame, routes: dict[str, Route], log: Log, limit: int = 15) -> DataFrame:
    """Answer records of questions (qid, question, entity, backend, model): each by its own backend and model."""
    route = questions.select("qid", "backend", "model")
    rows = contexts(graph, questions, limit).join(route, "qid").withColumn("prompt", C.prompt(F.col("question"), F.col("context")))
    return M.record(routed(rows, routes, log))


def plain_contexts(graph: Graph, questions: DataFrame, limit: int = 5) -> DataFrame:
    """(qid, question, entity, context) by unscored search: an entity's nodes by node_id with their edges, of which the first
    ``limit`` rows count. Each node has a row, so its first ``limit`` nodes are enough."""
    asked = questions.select("qid", "question", F.coalesce("entity", X.entity_plain(F.col("question"))).alias("entity"))
    needles = S.needles_of(asked)
    text = F.left("text", F.lit(CLIP)).alias("text")
    own = graph.nodes.select("node_id", "labels", text, "name", "canonical_name")
    top = sized(S.hits(graph, needles, limit, ranked=False).select("q", "node_id").join(needles, "q"), "hits").join(own, "node_id").drop("q")
    order = [F.col("node_id"), F.col("edge_id").asc_nulls_first()]
    few = S.expanded(top, Graph(graph.nodes.withColumn("text", text), graph.edges), few=True).withColumn("_n", F.row_number().over(Window.partitionBy("needle").orderBy(*order))).filter(F.col("_n") <= X.whole(limit))
    found = C.joined(C.lines(few, order, ["needle"], plain=True), ["needle"])
    before, after = C.NOTHING.split("{}")
    said = F.when(F.col("entity").isNull(), C.NO_ENTITY_PLAIN).otherwise(F.coalesce("context", F.concat(F.lit(before), F.col("entity"), F.lit(after))))
    return asked.join(found, asked.entity == found.needle, "left").select("qid", "question", "entity", said.alias("context"))


def ask_plain(graph: Graph, questions: DataFrame, limit: int = 5, make=M.Extract, backend: str = "extract") -> DataFrame:
    """Answer records of the plain pipeline: its own way to take an entity from a question, unscored search, and shorter prompts."""
    rows = plain_contexts(graph, questions, limit)
    return M.record(M.answered(rows.withColumn("prompt", C.prompt(F.col("question"), F.col("context"), 3000, C.CUT_PLAIN)), make, backend))


def ask_statement(graph: Graph, questions: DataFrame, statement: str, args: dict | None = None, plain: bool = False, make=M.Extract, backend: str = "extract") -> DataFrame:
    """Answer records of questions (qid, question) over the rows of one SELECT statement, run once for all: 15 spread over lines, or
    10 compact ones in the plain pipeline."""
    rows = S.select(graph, statement, args)
    text = C.or_else(C.joined(C.records(rows, 10 if plain else 15, not plain), []), C.NOTHING_FROM_QUERY)
    most, mark = (3000, C.CUT_PLAIN) if plain else (4500, C.CUT)
    asked = questions.select("qid", "question").join(F.broadcast(text), F.lit(True), "left")  # one row
    return M.record(M.answered(asked.withColumn("prompt", C.prompt(F.col("question"), F.col("context"), most, mark)), make, backend))


def ask_paths(graph: Graph, questions: DataFrame, limit: int = 20, make=M.Extract, backend: str = "extract") -> DataFrame:
    """Answer records with multi-hop contexts for questions (qid, question, entity); those without an entity have none."""
    paths = multi_hop_batch(graph, questions, 2, limit)
    short = graph.nodes.withColumn("text", F.left("text", F.lit(CLIP)))
    found = C.joined(C.path_lines(paths, short, keys=("needle",)), ["needle"])
    before, after = C.NOTHING_ON_PATHS.split("{}")
    text = F.coalesce("context", F.concat(F.lit(before), F.col("entity"), F.lit(after)))
    asked = questions.filter("entity is not null").select("qid", "question", "entity")
    rows = asked.join(found, asked.entity == found.needle, "left").select("qid", "question", "entity", text.alias("context"))
    return M.record(M.answered(rows.withColumn("prompt", C.prompt(F.col("question"), F.col("context"))), make, backend))


def ask_with_fallback(graph: Graph, questions: DataFrame, make=M.Extract, backend: str = "extract", when_empty: bool = False) -> DataFrame:
    """Scored search first; questions whose answer says that the context doesn't do are asked again with multi-hop search,
    all in one pass. The first answers are stored, so no model is asked twice for one."""
    first = kept(ask(graph, questions, 15, make, backend), "answers")
    weak = insufficient(F.col("answer")) | (F.lit(when_empty) & F.col("context").startswith(C.NOTHING.split("'")[0]))
    again = first.filter(weak).join(questions.select("qid", F.col("entity").alias("given")), "qid").select("qid", "question", F.coalesce("given", X.entity(F.col("question"))).alias("entity")).filter("entity is not null")
    return first.join(again.select("qid"), "qid", "left_anti").unionByName(ask_paths(graph, again, 20, make, backend))


def ask_one(graph: Graph, question: str, entity: str | None = None, statement: str | None = None, args: dict | None = None, multihop: bool = False, limit: int = 15, make=M.Extract, backend: str = "extract") -> DataFrame:
    """The answer record of one question. A SELECT statement comes before an entity, and an entity before one that is taken
    from the question."""
    asked = graph.nodes.sparkSession.range(1).select(F.col("id").alias("qid"), F.lit(question).cast("string").alias("question"), F.lit(entity).cast("string").alias("entity"))
    if statement is not None:
        text = C.or_else(C.joined(C.records(S.select(graph, statement, args)), []), C.NOTHING_FROM_QUERY)
        rows = asked.drop("entity").join(text, F.lit(True), "left").withColumn("prompt", C.prompt(F.col("question"), F.col("context")))
        return M.record(M.answered(rows, make, backend))
    if not multihop:
        return ask(graph, asked, limit, make, backend)
    known = asked.withColumn("entity", F.coalesce("entity", X.entity(F.col("question"))))
    return ask_paths(graph, known, limit, make, backend).unionByName(ask(graph, known.filter("entity is null"), limit, make, backend))


def chat_context(graph: Graph, message: str, limit: int = 5) -> DataFrame:
    """(context) of a chat message: the nodes that hold all of it."""
    return C.or_else(C.joined(C.dumped(S.chat(graph, message, limit)), []), C.NO_CHAT_MATCH)


def chat(graph: Graph, message: str, conversation: list[tuple[str, str | None]] = (), make=M.Extract, backend: str = "extract") -> DataFrame:
    """The reply to a message after turns (patient, doctor), as an answer record."""
    turns = F.array(*[F.struct(F.lit(p).cast("string").alias("patient"), F.lit(d).cast("string").alias("doctor")) for p, d in [*conversation, (message, None)]])
    rows = chat_context(graph, message).select(F.lit(0).cast("long").alias("qid"), F.lit(message).alias("question"), "context")
    return M.record(M.answered(rows.withColumn("prompt", C.chat_prompt(turns, F.col("context"))), make, backend))
