"""Queries by name, each over whole tables, and DuckDB SQL with the same results."""

import uuid

from pyspark.sql import functions as F

from wayfind.functions import text as X
from wayfind.operators import adjacency as A
from wayfind.operators import context as C
from wayfind.operators import dialog as D
from wayfind.operators import ingest as I
from wayfind.operators import paths as P
from wayfind.operators import search as S
from wayfind.operators import vectors as E
from wayfind.operators.similarity import link_counts, links
from wayfind.plans import models as M
from wayfind.plans import statements as Z
from wayfind.plans.ask import ask, ask_one, ask_plain, ask_routed, ask_statement, ask_with_fallback, contexts
from wayfind.plans.ask import chat_context as chat_text
from wayfind.plans.embed import Hashed, embed_nodes
from wayfind.plans.routed import Route
from wayfind.sources import indexed as N
from wayfind.sources import properties as V
from wayfind.sources.buckets import save_bucketed
from wayfind.sources.graph import Graph, load, read_links, table
from wayfind.sources.store import kept, new_log, shared_folder, stored, upsert_links
from wayfind.streaming.chat import notices
from wayfind.streaming.sessions import session_for, sessions

NEEDLE, WIDE, NEEDLES = "red bolt", "red", ["red bolt", "blue", "supplier#000000001", "È", "no such thing"]
SIMILAR = 0.3

NODES = """nodes as (
  select 'part:' || p_partkey as node_id, 'Part' as label, p_name as name, p_brand as canonical_name, p_type as text from part
  union all select 'supplier:' || s_suppkey, 'Supplier', s_name, null, null from supplier
  union all select 'nation:' || n_nationkey, 'Nation', n_name, null, null from nation
  union all select 'region:' || r_regionkey, 'Region', r_name, null, null from region
  union all select 'customer:' || c_custkey, 'Customer', c_name, null, c_mktsegment from customer
  union all select 'doc:' || doc_id, 'Document', null, null, text from documents
  union all select 'vec:' || vec_id, 'EntityCanonical', null, null, null from embeddings)"""
EDGES = """edges as (
  select src || '|' || type || '|' || dst as edge_id, src, dst, type from (
    select distinct 'part:' || l_partkey as src, 'supplier:' || l_suppkey as dst, 'SUPPLIED_BY' as type from lineitem
    union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'IN_NATION' from supplier
    union all select 'customer:' || c_custkey, 'nation:' || c_nationkey, 'IN_NATION' from customer
    union all select 'nation:' || n_nationkey, 'region:' || n_regionkey, 'IN_REGION' from nation))"""
GRAPH = f"with recursive {NODES}, {EDGES}"
SHOWN = "coalesce(nullif({0}text, ''), nullif({0}name, ''), nullif({0}canonical_name, ''), '')"


def sql_match(q: str, p: str = "") -> str:
    return " or ".join(f"coalesce(contains(lower({p}{c}), lower({q})), false)" for c in ("text", "name", "canonical_name"))


def sql_score(q: str) -> str:
    return f"case when lower(name) = lower({q}) or lower(canonical_name) = lower({q}) then 10 when contains(lower(name), lower({q})) or contains(lower(canonical_name), lower({q})) then 5 when contains(lower(text), lower({q})) then 1 else 0 end"


def sql_clip(x: str, n: int, mark: str = "...") -> str:
    return f"case when length({x}) > {n} then left({x}, {n}) || {mark if mark.startswith('chr') else repr(mark)} else {x} end"


SCORED = f"""top as (select *, {sql_score(f"'{NEEDLE}'")} as relevance from nodes where {sql_match(f"'{NEEDLE}'")} order by relevance desc, node_id limit 15),
hits as (select top.*, e.edge_id, e.type, m.node_id as target_id, m.label as target_label, {SHOWN.format('m.')} as target, {SHOWN.format('top.')} as shown
  from top left join edges e on e.src = top.node_id left join nodes m on m.node_id = e.dst)"""
SCORED_LINES = """lines as (select i, case when shown <> '' then i || '. [' || label || '] ' || repeat('★', least(3, relevance // 3)::int) || ' ' || {0} end as node_line,
  case when edge_id is not null and target <> '' then '   → ' || type || ': [' || target_label || '] ' || {1} end as edge_line
  from (select *, row_number() over (order by relevance desc, node_id, edge_id nulls first) as i from hits))""".format(sql_clip("shown", 300), sql_clip("target", 200))
PLAIN = f"""hits as (select n.node_id, n.label, e.edge_id, e.type, m.node_id as target_id, m.label as target_label, {SHOWN.format('m.')} as target, {SHOWN.format('n.')} as shown
  from nodes n left join edges e on e.src = n.node_id left join nodes m on m.node_id = e.dst where {sql_match(f"'{NEEDLE}'", 'n.')} order by n.node_id, e.edge_id nulls first limit 5)"""
JOINED = "select coalesce(string_agg(s, chr(10) order by i), '') as context from (select i, nullif(concat_ws(chr(10), node_line, edge_line), '') as s from lines)"
WALKS = """w(start_id, end_id, path_length, ids, types) as (
  select n.node_id, e.dst, 1, [e.edge_id], [e.type] from nodes n join edges e on e.src = n.node_id where {0}
  union all select w.start_id, e.dst, w.path_length + 1, list_append(w.ids, e.edge_id), list_append(w.types, e.type)
  from w join edges e on e.src = w.end_id where w.path_length < {1} and not list_contains(w.ids, e.edge_id))"""
PATHS = f"{GRAPH}, {WALKS.format(sql_match(repr(WIDE), 'n.'), 2)}, top as (select start_id, end_id, path_length, array_to_string(ids, ',') as path, array_to_string(types, ' → ') as types from w order by path_length, start_id, path, end_id limit 20)"
LINKS = """links as (select q.vec_id as a, v.vec_id as b, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as score
  from embeddings q join embeddings v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0 and round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) >= 0.3)"""
EVERY_LINK = LINKS.replace("q.vec_id % 100 = 0 and ", "")  # all pairs, not those of a query set

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def hits(df):
    return df.select("node_id", X.label().alias("label"), "name", *(["relevance"] if "relevance" in df.columns else []), "edge_id", "type", "target_id", F.when(F.col("target_id").isNotNull(), X.label("target_labels")).alias("target_label"))


HIT = "node_id, label, name, {0} edge_id, type, target_id, target_label"


@query(f"{GRAPH}, {SCORED} select {HIT.format('relevance,')} from hits")
def scored_search(spark, d):
    return hits(S.scored(stored(spark, d), NEEDLE))


@query(f"{GRAPH}, {SCORED} select {HIT.format('relevance,')} from hits qualify row_number() over (partition by node_id order by edge_id nulls last) = 1")
def scored_search_first_edge(spark, d):
    return hits(S.scored(stored(spark, d), NEEDLE, first_edge=True))


@query(f"{GRAPH} select {sql_score(repr(WIDE))} as relevance, count(*) as n from nodes where {sql_match(repr(WIDE))} group by 1")
def scored_search_tiers(spark, d):
    return S.matches(stored(spark, d), WIDE).groupBy(X.relevance(F.lit(WIDE)).alias("relevance")).agg(F.count("*").alias("n"))


@query(f"{GRAPH} select needle, node_id, {sql_score('needle')} as relevance, cast(row_number() over (partition by needle order by {sql_score('needle')} desc, node_id) as int) as rank from nodes, (values {', '.join(f'({n!r})' for n in NEEDLES)}) t(needle) where {sql_match('needle')} qualify rank <= 15")
def scored_search_batch(spark, d):
    asked = spark.createDataFrame(list(enumerate(NEEDLES)), "qid long, entity string")
    return S.scored_batch(stored(spark, d), asked).select("needle", "node_id", "relevance", "rank")


@query(f"{GRAPH}, {PLAIN} select node_id, label, edge_id, type, target_id, target_label from hits")
def proto_search(spark, d):
    return hits(S.plain(stored(spark, d), NEEDLE)).drop("name")


@query(f"{GRAPH} select node_id, label, name, text from nodes where coalesce(contains(lower(name), '{WIDE}'), false) or coalesce(contains(lower(text), '{WIDE}'), false) order by node_id limit 5")
def chat_search(spark, d):
    return S.chat(stored(spark, d), WIDE).select("node_id", X.label().alias("label"), "name", "text")


@query(f"{GRAPH} select node_id, label from nodes where name is not null or text is not null order by node_id limit 5")
def chat_search_empty_needle(spark, d):
    return S.chat(stored(spark, d), "").select("node_id", X.label().alias("label"))


@query(f"{PATHS} select * from top")
def multihop_search(spark, d):
    return P.multi_hop(stored(spark, d), WIDE, 2, 20)


@query(f"""{GRAPH}, starts as (select needle, node_id from nodes, (values {', '.join(f'({n!r})' for n in NEEDLES)}) t(needle) where {sql_match('needle')}),
one as (select needle, node_id as start_id, dst as end_id, edge_id, type from starts join edges on src = node_id),
w as (select needle, start_id, end_id, 1 as path_length, edge_id as path, type as types from one
  union all select needle, start_id, e.dst, 2, one.edge_id || ',' || e.edge_id, one.type || ' → ' || e.type from one join edges e on e.src = one.end_id and e.edge_id <> one.edge_id)
select needle, start_id, end_id, path_length, path, types from w qualify row_number() over (partition by needle order by path_length, start_id, path, end_id) <= 20""")
def multihop_batch(spark, d):
    asked = spark.createDataFrame(list(enumerate(NEEDLES)), "qid long, entity string")
    return P.multi_hop_batch(stored(spark, d), asked, 2, 20)


@query(f"{GRAPH}, {WALKS.format(repr('x') + ' = ' + repr('x') + ' and n.node_id = ' + repr('part:1'), 3)} select start_id, end_id, path_length, array_to_string(ids, ',') as path from w")
def multihop_recursive(spark, d):
    return P.recursive(stored(spark, d), "part:1", 3)


@query(f"{GRAPH} select n.node_id, n.name, e.edge_id, m.node_id as target_id, m.name as target_name from nodes n join edges e on e.src = n.node_id join nodes m on m.node_id = e.dst where n.label = 'Part' and contains(lower(n.name), '{WIDE}') order by n.node_id, e.edge_id limit 15")
def label_substring_expand(spark, d):
    return S.labelled(stored(spark, d), "Part", WIDE).select("node_id", "name", "edge_id", "target_id", "target_name")


@query(f"{GRAPH} select label, count(*) as n from nodes group by label")
def node_label_counts(spark, d):
    return stored(spark, d).nodes.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query(f"{GRAPH} select type, count(*) as n from edges group by type")
def rel_type_counts(spark, d):
    return stored(spark, d).edges.groupBy("type").agg(F.count("*").alias("n"))


@query(f"{GRAPH} select 'labels' as kind, string_agg(distinct label, ',' order by label) as names from nodes union all select 'types', string_agg(distinct type, ',' order by type) from edges")
def schema_summary(spark, d):
    return S.schema(stored(spark, d))


@query(f"{GRAPH} select node_id, label, name, canonical_name, text, {', '.join(f'cast(null as varchar) as {c}' for c in ('title', 'description', 'disease', 'symptom', 'canonical_id', 'original_id'))} from nodes order by node_id limit 5")
def sample_nodes(spark, d):
    return S.sample(stored(spark, d))


@query(f"{GRAPH} select label, count(*) as n from nodes where text is not null and text <> '' group by label")
def custom_query(spark, d):
    return S.select(stored(spark, d), "select labels[0] as label, count(*) as n from nodes where text is not null and text <> :empty group by labels[0]", {"empty": ""})


def similarity(spark, d):
    vectors = table(spark, d, "embeddings")
    return links(vectors, vectors.filter("vec_id % 100 = 0"), SIMILAR)


def similar_graph(spark, d) -> Graph:
    g = stored(spark, d)
    edges = similarity(spark, d).select(F.concat(F.lit("vec:"), "a").alias("src"), F.concat(F.lit("vec:"), "b").alias("dst"), "score").select(F.concat_ws("|", "src", F.lit("SIMILAR_TO"), "dst").alias("edge_id"), "src", "dst", F.lit("SIMILAR_TO").alias("type"), "score")
    return Graph(g.nodes, g.edges.unionByName(edges))


@query(f"with {LINKS} select * from links")
def similar_pairs(spark, d):
    return similarity(spark, d)


@query(f"with {EVERY_LINK} select 'canonical_nodes' as metric, count(*) as value from embeddings union all select 'similarity_links', count(*) from links union all select 'canonical_without_similarity', count(*) from embeddings where vec_id not in (select a from links union select b from links)")
def integrity_report(spark, d):
    """Of the links between all vectors, each compared with each."""
    counts = link_counts(table(spark, d, "embeddings"), SIMILAR).select(F.concat(F.lit("vec:"), "vec_id").alias("node_id"), "links")
    return I.integrity_of_counts(load(spark, d).nodes, counts)


@query(f"with {LINKS} select 'vec:' || vec_id as node_id from embeddings where vec_id not in (select a from links union select b from links)")
def isolated_nodes(spark, d):
    g = similar_graph(spark, d)
    return I.isolated(g.nodes.filter(F.array_contains("labels", "EntityCanonical")).select("node_id"), g.edges.filter("type = 'SIMILAR_TO'"))


ROWS = """rows as (select 3 * vec_id as row_no, vec_id as a, vec_id + 1 as b, 0.1 as score from embeddings
  union all select 3 * vec_id + 1, vec_id, vec_id + 1, 0.2 from embeddings
  union all select 3 * vec_id + 2, vec_id + 1, vec_id, 0.3 from embeddings where vec_id % 2 = 0),
old as (select vec_id as a, vec_id + 1 as b, 0.9 as score from embeddings where vec_id % 5 = 0 union all select vec_id, vec_id + 2, 0.5 from embeddings),
ok as (select * from rows where a in (select vec_id from embeddings) and b in (select vec_id from embeddings)),
new as (select a, b, arg_max(score, row_no) as score from ok group by a, b)"""


def upsert_input(spark, d):
    v = table(spark, d, "embeddings").select("vec_id")
    s = lambda c: c.cast("string")
    row = lambda n, a, b, x: v.select((3 * F.col("vec_id") + n).alias("row_no"), s(a).alias("source"), s(b).alias("target"), F.lit(x).alias("score"), "vec_id")
    one, two = F.col("vec_id"), F.col("vec_id") + 1
    rows = row(0, one, two, 0.1).unionByName(row(1, one, two, 0.2)).unionByName(row(2, two, one, 0.3).filter("vec_id % 2 = 0"))
    old = row(0, one, two, 0.9).filter("vec_id % 5 = 0").unionByName(row(0, one, one + 2, 0.5)).select(F.col("source").alias("src"), F.col("target").alias("dst"), "score")
    return v.select(s(one).alias("key")), old, rows.drop("vec_id")


@query(f"with {ROWS} select cast(a as varchar) as src, cast(b as varchar) as dst, cast(score as double) as score from new union all select cast(a as varchar), cast(b as varchar), cast(score as double) from old where not exists (select 1 from new where new.a = old.a and new.b = old.b)")
def edge_upsert(spark, d):
    return I.upsert_edges(*upsert_input(spark, d))


@query(f"with {ROWS} select row_no, cast(a as varchar) as source, cast(b as varchar) as target from rows where row_no not in (select row_no from ok)")
def edge_upsert_rejected(spark, d):
    keys, _, rows = upsert_input(spark, d)
    return I.rejected(keys, rows).select("row_no", "source", "target")


@query("select cast(label as varchar) as key, count(*) as n from embeddings where label is not null group by label having count(*) > 1")
def duplicate_keys(spark, d):
    return I.duplicates(stored(spark, d).nodes.filter(F.array_contains("labels", "EntityCanonical")), "original_id")


@query("select cast(vec_id as varchar) as key, count(*) as n from (select vec_id from embeddings union all select vec_id from embeddings where vec_id % 10 = 3) group by vec_id having count(*) > 1")
def constraint_violations(spark, d):
    """What a uniqueness constraint on canonical_id would refuse: every tenth node is there twice."""
    nodes = stored(spark, d).nodes.filter(F.array_contains("labels", "EntityCanonical"))
    return I.duplicates(nodes.unionByName(nodes.filter(F.col("canonical_id").cast("long") % 10 == 3)), "canonical_id")


@query(f"{GRAPH} select node_id, cast(null as varchar) as original_id, text from nodes where text is not null and text <> ''")
def harvest_text(spark, d):
    return I.harvest(stored(spark, d).nodes)


@query("""with new as (select vec_id, label, embedding as e from embeddings where label is null
  union all select vec_id, label, last_e from embeddings join (select label as l, arg_max(embedding, vec_id) as last_e from embeddings where label is not null group by label) t on l = label)
select vec_id, cast(label as varchar) as original_id, cast(i as bigint) as place, round(e[i + 1]::double, 6) as value from (select *, unnest(range(len(e))) as i from new)""")
def embedding_update(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("original_id"), "embedding")
    out = I.update_embeddings(v, v.select(F.col("vec_id").alias("row_no"), "original_id", "embedding"))
    return out.select("vec_id", "original_id", F.posexplode("embedding").alias("place", "value")).select("vec_id", "original_id", F.col("place").cast("long").alias("place"), F.round(F.col("value").cast("double"), 6).alias("value"))


def scored_lines(spark, d):
    return C.lines(S.scored(stored(spark, d), NEEDLE), [F.desc("relevance"), F.col("node_id"), F.col("edge_id").asc_nulls_first()], [])


@query(f"{GRAPH}, {SCORED}, {SCORED_LINES} select i, node_line, edge_line from lines")
def scored_context_lines(spark, d):
    return scored_lines(spark, d).select(F.col("i").cast("long").alias("i"), "node_line", "edge_line")


@query(f"{GRAPH}, {SCORED}, {SCORED_LINES} {JOINED}")
def scored_context(spark, d):
    return C.or_else(C.joined(scored_lines(spark, d), []), C.NOTHING.format(NEEDLE))


@query("{}, {}, lines as (select i, case when shown <> '' then i || '. ' || label || ': ' || {} end as node_line, case when edge_id is not null and target <> '' then '   → ' || type || ': ' || target_label || ' - ' || {} end as edge_line from (select *, row_number() over (order by node_id, edge_id nulls first) as i from hits)) {}".format(GRAPH, PLAIN, sql_clip("shown", 200), sql_clip("target", 150), JOINED))
def proto_context(spark, d):
    rows = C.lines(S.plain(stored(spark, d), NEEDLE), [F.col("node_id"), F.col("edge_id").asc_nulls_first()], [], plain=True)
    return C.or_else(C.joined(rows, []), C.NOTHING.format(NEEDLE))


@query(f"{PATHS}, lines as (select i, case when a <> '' and b <> '' then i || '. [' || la || '] ' || a || ' --' || types || '--> [' || lb || '] ' || b end as node_line, null as edge_line from (select row_number() over (order by path_length, start_id, path, end_id) as i, types, s.label as la, left({SHOWN.format('s.')}, 150) as a, t.label as lb, left({SHOWN.format('t.')}, 150) as b from top join nodes s on s.node_id = start_id join nodes t on t.node_id = end_id) where i <= 10) {JOINED}")
def path_context(spark, d):
    g = stored(spark, d)
    return C.or_else(C.joined(C.path_lines(P.multi_hop(g, WIDE, 2, 20), g.nodes), []), C.NOTHING_ON_PATHS.format(WIDE))


@query("select doc_id, cast(length(coalesce(text, '')) as int) as context_length, cast(case when length(coalesce(text, '')) > 4500 then 4500 + length(chr(10) || '... (context truncated)') else length(coalesce(text, '')) end as int) as capped_length from documents")
def prompt_lengths(spark, d):
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.length(text).alias("context_length"), F.length(C.capped(text)).alias("capped_length"))


WORDS = r"regexp_split_to_array(text, '\s+')"
ENTITY = rf"trim(coalesce(list_filter({WORDS}, lambda w: length(w) > 4 and regexp_matches(substr(w, 1, 1), '^\p{{Lu}}'))[1], list_filter({WORDS}, lambda w: length(w) > 5)[1]), '?,.:;!')"


@query(f"""{GRAPH} select string_agg(i || '. ' || j, chr(10) order by i) as context
  from (select row_number() over (order by node_id) as i, to_json(struct_pack(node_id := node_id, name := name, n := length(name), vowel := contains('AEIOU', left(name, 1)), s := struct_pack(k := name, n := 1)))::varchar as j from nodes where label = 'Nation' qualify i <= 15)""")
def record_context(spark, d):
    """Strings, numbers, booleans and structs of these; vectors and other arrays within structs go."""
    statement = """select node_id, name, length(name) as n, contains('AEIOU', left(name, 1)) as vowel, named_struct('k', name, 'n', 1, 'embedding', array(1.0), 'l', array(1)) as s, array(0.5) as embedding
      from nodes where array_contains(labels, :label) order by node_id"""
    return C.or_else(C.joined(C.records(S.select(stored(spark, d), statement, {"label": "Nation"})), []), C.NOTHING_FROM_QUERY)


@query(f"""{GRAPH} select coalesce(string_agg(j, chr(10) order by node_id), '{C.NO_CHAT_MATCH}') as context
  from (select node_id, '{{' || chr(10) || concat_ws(',' || chr(10), '  "name": ' || to_json(name)::varchar, '  "canonical_name": ' || to_json(canonical_name)::varchar, '  "text": ' || to_json(text)::varchar) || chr(10) || '}}' as j from nodes
  where contains(lower(coalesce(name, '')), '{NEEDLE}') or contains(lower(coalesce(text, '')), '{NEEDLE}') order by node_id limit 5)""")
def chat_context(spark, d):
    return chat_text(stored(spark, d), NEEDLE)


@query(f"select conv_id, turn, {ENTITY} as entity from conversations")
def auto_entity(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.entity(F.col("text")).alias("entity"))


@query(f"select conv_id, turn, trim(list_filter({WORDS}, lambda w: length(w) > 4)[1], '?,.:;') as entity from conversations")
def auto_entity_proto(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.entity_plain(F.col("text")).alias("entity"))


#: Conversations in which some users leave, and some replies name a diagnosis or say that the context doesn't do.
SPOKEN = """spoken as (select conv_id, turn, role, case
  when role = 'user' and (conv_id + turn) % 7 = 0 then '  QUIT' || chr(10)
  when role = 'user' and (conv_id + turn) % 11 = 0 then text || ' quit'
  when role = 'assistant' and (conv_id + turn) % 5 = 0 then text || ' It APPEARS to be a cold.'
  when role = 'assistant' and (conv_id + turn) % 3 = 0 then 'The context doesn''t contain this. ' || text
  else text end as text from conversations)"""


def said_text():
    at, user, said = F.col("conv_id") + F.col("turn"), F.col("role") == "user", F.col("role") == "assistant"
    return (
        F.when(user & (at % 7 == 0), F.lit("  QUIT\n")).when(user & (at % 11 == 0), F.concat("text", F.lit(" quit")))
        .when(said & (at % 5 == 0), F.concat("text", F.lit(" It APPEARS to be a cold."))).when(said & (at % 3 == 0), F.concat(F.lit("The context doesn't contain this. "), "text"))
        .otherwise(F.col("text"))
    )


def spoken(spark, d):
    return table(spark, d, "conversations").withColumn("text", said_text())


@query(f"with {SPOKEN} select conv_id, turn, coalesce(contains(lower(text), 'not enough information') or contains(lower(text), 'context doesn''t contain'), false) as again from spoken where role = 'assistant'")
def insufficient_answers(spark, d):
    return spoken(spark, d).filter("role = 'assistant'").select("conv_id", "turn", D.insufficient(F.col("text")).alias("again"))


@query("with {}, h as (select conv_id, turn, role, case when role = 'assistant' and ({}) then 1 else 0 end as hit from spoken), r as (select *, max(hit) over (partition by conv_id order by turn rows unbounded preceding) as now, coalesce(max(hit) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as before from h) select conv_id, turn, role, now = 1 as suggested, hit = 1 and before = 0 as notice from r".format(SPOKEN, " or ".join(f"contains(lower(text), '{w}')" for w in D.DIAGNOSIS)))
def diagnosis_latch(spark, d):
    return D.latch(spoken(spark, d))


@query(rf"with {SPOKEN}, o as (select *, max(case when role = 'user' and lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) in ('quit', 'exit', 'bye') then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as gone from spoken) select conv_id, turn, role, text from o where gone = 0")
def exit_cut(spark, d):
    return D.until_exit(spoken(spark, d)).select("conv_id", "turn", "role", "text")


@query("select conv_id, count(*) as n_turns, string_agg(case when role = 'user' then 'Patient: ' else 'Doctor: ' end || coalesce(text, ''), chr(10) order by turn) as transcript from conversations where role in ('user', 'assistant') group by conv_id")
def transcript(spark, d):
    return D.transcript(table(spark, d, "conversations"))


@query(f"""{GRAPH}, q as (select conv_id, turn, {ENTITY} as entity from conversations where role = 'user'),
top as (select n.*, needle, {sql_score('needle')} as relevance from nodes n, (select distinct entity as needle from q where entity is not null) where {sql_match('needle', 'n.')} qualify row_number() over (partition by needle order by relevance desc, node_id) <= 15),
hits as (select top.*, e.edge_id, e.type, m.label as target_label, {SHOWN.format('m.')} as target, {SHOWN.format('top.')} as shown from top left join edges e on e.src = top.node_id left join nodes m on m.node_id = e.dst),
lines as (select needle, i, case when shown <> '' then i || '. [' || label || '] ' || repeat('★', least(3, relevance // 3)::int) || ' ' || {sql_clip('shown', 300)} end as node_line, case when edge_id is not null and target <> '' then '   → ' || type || ': [' || target_label || '] ' || {sql_clip('target', 200)} end as edge_line
  from (select *, row_number() over (partition by needle order by relevance desc, node_id, edge_id nulls first) as i from hits)),
c as (select needle, coalesce(string_agg(s, chr(10) order by i), '') as context from (select needle, i, nullif(concat_ws(chr(10), node_line, edge_line), '') as s from lines) group by needle)
select conv_id, turn, entity, case when entity is null then '{C.NO_ENTITY}' else coalesce(context, 'No results found for ''' || entity || '''.') end as context from q left join c on needle = entity""")
def ask_batch(spark, d):
    q = table(spark, d, "conversations").filter("role = 'user'").select(F.struct("conv_id", "turn").alias("qid"), F.col("text").alias("question"), F.lit(None).cast("string").alias("entity"))
    return contexts(stored(spark, d), q).select("qid.conv_id", "qid.turn", "entity", "context")

ANSWERED = "'Answer from the context alone.' || chr(10) || chr(10) || 'Context:' || chr(10) || {0} || chr(10) || chr(10) || 'Question: ' || {1} || chr(10) || 'Answer:'"


@query("select doc_id, md5({}) as prompt_md5 from documents".format(ANSWERED.format(sql_clip("coalesce(text, '-')", 4500, "chr(10) || '... (context truncated)'"), "'What of ' || lang || '?'")))
def prompts(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(C.prompt(F.concat(F.lit("What of "), "lang", F.lit("?")), F.coalesce("text", F.lit("-")))).alias("prompt_md5"))


@query("""with t as (select conv_id, turn, text as patient, lead(case when role = 'assistant' then text end) over (partition by conv_id order by turn) as doctor, role from conversations where role in ('user', 'assistant')),
s as (select conv_id, string_agg('Patient: ' || coalesce(patient, '') || coalesce(chr(10) || 'Doctor: ' || doctor, ''), chr(10) order by turn) as said from t where role = 'user' group by conv_id)
select conv_id, 'Reply to the patient: ask what is still open, or say what is likely and what to do.' || chr(10) || chr(10) || 'Conversation:' || chr(10) || said || chr(10) || chr(10) || 'Context:' || chr(10) || 'none' || chr(10) || chr(10) || 'Reply:' as prompt from s""")
def chat_prompts(spark, d):
    return D.pairs(table(spark, d, "conversations")).select("conv_id", C.chat_prompt(F.col("turns"), F.lit("none")).alias("prompt"))


ASKED = [(1, "What of it?", NEEDLE), (2, "And blue things?", "blue"), (3, "Who else?", "no such thing"), (4, "so?", None), (5, "è", "È"), (6, "Which Supplier#000000001 is it", None), (7, "Where?", "EUROPE")]
GIVEN = "asked as (select * from (values {}) v(qid, question, given)), q as (select qid, question, given, coalesce(given, {}) as entity from asked)".format(", ".join(f"({i}, '{q}', {'null' if e is None else repr(e)})" for i, q, e in ASKED), ENTITY.replace("text", "question"))
CONTEXTS = f"""top as (select n.*, needle, {sql_score('needle')} as relevance from nodes n, (select distinct entity as needle from q where entity is not null) where {sql_match('needle', 'n.')} qualify row_number() over (partition by needle order by relevance desc, node_id) <= 15),
hits as (select top.*, e.edge_id, e.type, m.label as target_label, {SHOWN.format('m.')} as target, {SHOWN.format('top.')} as shown from top left join edges e on e.src = top.node_id left join nodes m on m.node_id = e.dst),
lines as (select needle, i, case when shown <> '' then i || '. [' || label || '] ' || repeat('★', least(3, relevance // 3)::int) || ' ' || {sql_clip('shown', 300)} end as node_line, case when edge_id is not null and target <> '' then '   → ' || type || ': [' || target_label || '] ' || {sql_clip('target', 200)} end as edge_line
  from (select *, row_number() over (partition by needle order by relevance desc, node_id, edge_id nulls first) as i from hits)),
c as (select needle, coalesce(string_agg(s, chr(10) order by i), '') as context from (select needle, i, nullif(concat_ws(chr(10), node_line, edge_line), '') as s from lines) group by needle),
first as (select qid, question, given, entity, case when entity is null then '{C.NO_ENTITY}' else coalesce(context, 'No results found for ''' || entity || '''.') end as context from q left join c on needle = entity)"""
RECORD = "qid, question, {0} as answer, context, 'extract' as backend, 'extract' as model, cast(length({1}) as int) as prompt_length, cast(length(context) as int) as context_length, 'ok' as status"
CAPPED = sql_clip("context", 4500, "chr(10) || '... (context truncated)'")
PROMPT = ANSWERED.format(CAPPED, "question")
LINE = f"split_part({CAPPED}, chr(10), 1)"
GOOD = f"(contains({PROMPT}, '→') or contains({PROMPT}, '--'))"


def asked(spark):
    return spark.createDataFrame(ASKED, "qid int, question string, entity string")


@query(f"{GRAPH}, {GIVEN}, {CONTEXTS} select {RECORD.format(LINE, PROMPT)} from first")
def answer_records(spark, d):
    return ask(stored(spark, d), asked(spark))


@query(f"""{GRAPH}, {GIVEN}, {CONTEXTS}, judged as (select *, {GOOD} as good from first),
starts as (select needle, node_id from nodes, (select distinct entity as needle from judged where not good and entity is not null) where {sql_match('needle')}),
one as (select needle, node_id as start_id, dst as end_id, edge_id, type from starts join edges on src = node_id),
w as (select needle, start_id, end_id, 1 as path_length, edge_id as path, type as types from one
  union all select needle, start_id, e.dst, 2, one.edge_id || ',' || e.edge_id, one.type || ' → ' || e.type from one join edges e on e.src = one.end_id and e.edge_id <> one.edge_id),
few as (select * from w qualify row_number() over (partition by needle order by path_length, start_id, path, end_id) <= 20),
chains as (select needle, i, case when a <> '' and b <> '' then i || '. [' || la || '] ' || a || ' --' || types || '--> [' || lb || '] ' || b end as s from (select needle, row_number() over (partition by needle order by path_length, start_id, path, end_id) as i, types, s.label as la, left({SHOWN.format('s.')}, 150) as a, t.label as lb, left({SHOWN.format('t.')}, 150) as b from few join nodes s on s.node_id = start_id join nodes t on t.node_id = end_id) where i <= 10),
p as (select needle, coalesce(string_agg(s, chr(10) order by i), '') as context from chains group by needle),
again as (select qid, question, coalesce(p.context, 'No multi-hop results found for ''' || entity || '''.') as context from judged j left join p on p.needle = j.entity where not good and entity is not null),
all_ as (select qid, question, context from judged where good or entity is null union all select * from again)
select {RECORD.format(f"case when {GOOD} then {LINE} else 'There is not enough information.' end", PROMPT)} from all_""")
def fallback_records(spark, d):
    return ask_with_fallback(stored(spark, d), asked(spark), make=M.Doubting)


@query(f"""select 'search' as kind, 'No results found for ''no such thing''.' as context union all select 'plain', 'No results found for ''no such thing''.' union all select 'paths', 'No multi-hop results found for ''no such thing''.'
  union all select 'statement', '{C.NOTHING_FROM_QUERY}' union all select 'chat', '{C.NO_CHAT_MATCH}' union all select 'no entity', '{C.NO_ENTITY}'""")
def empty_results(spark, d):
    g, missing = stored(spark, d), NEEDLES[-1]
    rows = lambda df, plain: C.lines(df, [F.col("node_id"), F.col("edge_id").asc_nulls_first()], [], plain)
    found = {
        "search": C.or_else(C.joined(rows(S.scored(g, missing), False), []), C.NOTHING.format(missing)),
        "plain": C.or_else(C.joined(rows(S.plain(g, missing), True), []), C.NOTHING.format(missing)),
        "paths": C.or_else(C.joined(C.path_lines(P.multi_hop(g, missing), g.nodes), []), C.NOTHING_ON_PATHS.format(missing)),
        "statement": C.or_else(C.joined(C.records(S.select(g, "select name from nodes where false")), []), C.NOTHING_FROM_QUERY),
        "chat": chat_text(g, missing),
        "no entity": contexts(g, spark.createDataFrame([(1, "so?", None)], "qid int, question string, entity string")).select("context"),
    }
    out = None
    for kind, df in found.items():
        one = df.select(F.lit(kind).alias("kind"), "context")
        out = one if out is None else out.unionByName(one)
    return out


@query("select cast(label as varchar) as original_id, count(*) as n_nodes, cast(64 as int) as size, true as unit from embeddings where label is not null group by label")
def encoded_texts(spark, d):
    """Vectors of texts, which every node with the id gets; the default encoder gives vectors of length one."""
    nodes = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("node_id"), F.col("label").cast("string").alias("original_id"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("text"), F.lit(None).cast("array<float>").alias("embedding"))
    out = embed_nodes(nodes, lambda: Hashed(64)).filter("original_id is not null")
    norm = F.sqrt(F.aggregate(F.transform("embedding", lambda x: (x * x).cast("double")), F.lit(0.0), lambda a, b: a + b))
    return out.groupBy("original_id").agg(F.count("*").alias("n_nodes"), F.max(F.size("embedding")).alias("size"), F.min(F.abs(norm - 1) < 1e-5).alias("unit"))

@query("select cast(vec_id as varchar) as source, cast(vec_id + 1 as varchar) as target, cast(case when vec_id % 5 = 0 then null else vec_id / 8.0 end as double) as score from embeddings where vec_id % 7 <> 0")
def csv_links(spark, d):
    """A CSV table of links whose columns are found by their names; rows without an endpoint go."""
    v, here = table(spark, d, "embeddings"), f"{shared_folder(spark)}/links-{uuid.uuid4().hex}"
    rows = v.select(F.lit("x").alias("note"), F.when(F.col("vec_id") % 7 != 0, F.col("vec_id")).alias("Source_Node"), (F.col("vec_id") + 1).alias("tgt"), F.when(F.col("vec_id") % 5 != 0, F.col("vec_id") / 8.0).alias("simScore"))
    rows.write.option("header", True).csv(here)
    return read_links(spark, here).select("source", "target", "score")


@query(ORACLE["edge_upsert"])
def stored_upsert(spark, d):
    """Links upserted into stored edges; both tables and the change are versions of one log."""
    keys, old, rows = upsert_input(spark, d)
    log = new_log(spark, "links")
    change = log.begin()
    change.create("nodes", keys, ["key"])
    change.create("edges", old, ["src", "dst"])
    change.commit()
    upsert_links(log, rows)
    return log.read("edges")


@query(f"""with {ROWS},
one as (select a, b, arg_max(score, row_no) as score from ok where row_no % 3 <> 2 group by a, b), two as (select a, b, max(0.7) as score from ok where a % 3 = 0 group by a, b),
all_ as (select a, b, score, 0 as v from old union all select a, b, score, 1 from one union all select a, b, score, 2 from two)
select cast(a as varchar) as src, cast(b as varchar) as dst, cast(arg_max(score, v) as double) as score from all_ where a % 4 <> 0 group by a, b""")
def concurrent_upserts(spark, d):
    """Two writers that have seen the same version both hold, the later one on what both have; then nodes go with their edges,
    and what is left is packed."""
    keys, old, rows = upsert_input(spark, d)
    log = new_log(spark, "links")
    change = log.begin()
    change.create("nodes", keys, ["key"])
    change.create("edges", old, ["src", "dst"])
    change.commit()
    one, two = log.begin(), log.begin()
    one.upsert("edges", I.last_scores(one.read("nodes"), rows.filter("row_no % 3 <> 2")))
    two.upsert("edges", I.last_scores(two.read("nodes"), rows.filter("cast(source as long) % 3 = 0").withColumn("score", F.lit(0.7))))
    one.commit()
    two.commit()
    gone = log.begin()
    gone.delete("nodes", keys.filter("cast(key as long) % 4 = 0"))
    gone.delete("edges", log.read("edges").filter("cast(src as long) % 4 = 0"))
    gone.commit()
    log.compact("edges")
    return log.read("edges")


@query(f"""select 'entity' as kind, context from ({ORACLE['scored_context']}) union all select 'paths', context from ({ORACLE['path_context']})
union all select 'statement', '1. {{"n":' || count(*) || '}}' from nation union all select 'none', '{C.NO_ENTITY}'""")
def ask_dispatch(spark, d):
    """What one question leads to: a statement before an entity, and an entity before one that is taken from the question."""
    g = stored(spark, d)
    kinds = {
        "entity": ask_one(g, "What of Supplier#000000001?", NEEDLE),
        "paths": ask_one(g, "What of it?", WIDE, multihop=True),
        "statement": ask_one(g, "How many?", NEEDLE, "select count(*) as n from nodes where array_contains(labels, :label)", {"label": "Nation"}),
        "none": ask_one(g, "so?"),
    }
    out = None
    for kind, df in kinds.items():
        one = df.select(F.lit(kind).alias("kind"), "context")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"select conv_id, turn, notice from ({ORACLE['diagnosis_latch']})")
def stream_notices(spark, d):
    """The latch over a stream of turns, run until the stream's end."""
    stream = spark.readStream.schema(table(spark, d, "conversations").schema).parquet(f"{d}/conversations.parque[t]")  # a pattern, as without one a stream takes folders only
    same = stream.withColumn("text", said_text()).select("conv_id", "turn", "role", "text")
    here = f"{shared_folder(spark)}/notices-{uuid.uuid4().hex}"
    run = notices(same).writeStream.format("parquet").option("checkpointLocation", f"{here}/checkpoint").option("path", f"{here}/rows").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("conv_id long, turn long, notice boolean").parquet(f"{here}/rows")


@query(ORACLE["scored_search"])
def indexed_search(spark, d):
    """The same search by trigrams: postings, and the rows that they name."""
    return hits(S.scored(N.stored_index(spark, d), NEEDLE))


@query(ORACLE["scored_search_batch"])
def indexed_search_batch(spark, d):
    asked = spark.createDataFrame(list(enumerate(NEEDLES)), "qid long, entity string")
    return S.scored_batch(N.stored_index(spark, d), asked).select("needle", "node_id", "relevance", "rank")


@query(ORACLE["chat_search"])
def indexed_chat(spark, d):
    return S.chat(N.stored_index(spark, d), WIDE).select("node_id", X.label().alias("label"), "name", "text")


@query(ORACLE["multihop_batch"])
def indexed_paths_batch(spark, d):
    """Walks over segments of edges: found by trigrams, and read from the beginning of each source."""
    asked = spark.createDataFrame(list(enumerate(NEEDLES)), "qid long, entity string")
    return P.multi_hop_batch(N.stored_index(spark, d), asked, 2, 20)


CHANGED = """changed as (select node_id, label, case when label = 'Part' and cast(substr(node_id, 6) as bigint) % 3 <> 0 then 'old ' || name else name end as name, canonical_name, text from nodes where label <> 'Customer')"""


@query(f"{GRAPH}, {CHANGED} select needle, {sql_score('needle')} as relevance, count(*) as n from changed, (values ('red bolt'), ('old red'), ('customer#'), ('the')) t(needle) where {sql_match('needle')} group by 1, 2")
def indexed_changes(spark, d):
    """An index that follows its graph: nodes come in two batches, some are replaced, and some go."""
    g, log = load(spark, d), new_log(spark, "index")
    is_ = lambda label: F.array_contains("labels", label)
    N.build(Graph(g.nodes.filter(~is_("Part")), g.edges), log)
    parts = g.nodes.filter(is_("Part"))
    N.put_nodes(log, parts.withColumn("name", F.concat(F.lit("old "), "name")))
    N.put_nodes(log, parts.filter("cast(substr(node_id, 6) as long) % 3 = 0"))
    N.delete_nodes(log, g.nodes.filter(is_("Customer")))
    own = N.open_indexed(log)
    found = own.found(spark.createDataFrame([("red bolt",), ("old red",), ("customer#",), ("the",)], "q string"))
    return found.groupBy(F.col("q").alias("needle"), "relevance").agg(F.count("*").alias("n"))


HUBS = ["NATION_1", "europe", "no such thing", "a"]


@query(f"""{GRAPH}, rev as (select edge_id, dst as src, src as dst, 'HAS' as type from edges where type <> 'SUPPLIED_BY'),
top as (select n.*, needle, {sql_score('needle')} as relevance from nodes n, (values {', '.join(f"('{h}')" for h in HUBS)}) t(needle) where label in ('Nation', 'Region') and ({sql_match('needle', 'n.')}) qualify row_number() over (partition by needle order by relevance desc, node_id) <= 15),
hits as (select top.*, e.edge_id, e.type, m.label as target_label, {SHOWN.format('m.')} as target, {SHOWN.format('top.')} as shown from top left join rev e on e.src = top.node_id left join nodes m on m.node_id = e.dst),
lines as (select needle, i, case when shown <> '' then i || '. [' || label || '] ' || repeat('★', least(3, relevance // 3)::int) || ' ' || {sql_clip('shown', 300)} end as node_line, case when edge_id is not null and target <> '' then '   → ' || type || ': [' || target_label || '] ' || {sql_clip('target', 200)} end as edge_line
  from (select *, row_number() over (partition by needle order by relevance desc, node_id, edge_id nulls first) as i from hits))
select needle, left(context, 4500) as context, cast(length(context) as bigint) as context_length from (select needle, coalesce(string_agg(s, chr(10) order by i), '') as context from (select needle, i, nullif(concat_ws(chr(10), node_line, edge_line), '') as s from lines) group by needle)""")
def hub_contexts(spark, d):
    """Contexts of hubs, nations with all their customers: the beginning of each, and the length of the whole."""
    g = stored(spark, d)
    back = g.edges.filter("type <> 'SUPPLIED_BY'").select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("HAS").alias("type"), "score")
    places = Graph(g.nodes.filter(F.array_contains("labels", "Nation") | F.array_contains("labels", "Region")), back)
    top = S.scored_batch(places, spark.createDataFrame(list(enumerate(HUBS)), "qid long, entity string"))
    return A.bounded_context(top, A.segments(back), g.nodes)


@query(f"{GRAPH}, {GIVEN}, {CONTEXTS}, cut as (select qid, question, context as whole, left(context, 4501) as context from first) select {RECORD.format(LINE, PROMPT).replace('length(context)', 'length(whole)')} from cut")
def bounded_records(spark, d):
    """Answer records with cut contexts and whole lengths, over the stored index."""
    return ask(N.stored_index(spark, d), asked(spark), bounded=True)


#: Columns of the tables by the kind of their values, as properties of nodes.
KINDS = {
    "Part": ("part", "p_partkey", {"BIGINT": ["p_partkey", "p_size"], "STRING": ["p_name", "p_brand", "p_type"], "DOUBLE": ["p_retailprice"]}),
    "Supplier": ("supplier", "s_suppkey", {"BIGINT": ["s_suppkey", "s_nationkey"], "STRING": ["s_name"], "DOUBLE": ["s_acctbal"]}),
    "Nation": ("nation", "n_nationkey", {"BIGINT": ["n_nationkey", "n_regionkey"], "STRING": ["n_name"]}),
    "Region": ("region", "r_regionkey", {"BIGINT": ["r_regionkey"], "STRING": ["r_name"]}),
    "Customer": ("customer", "c_custkey", {"BIGINT": ["c_custkey", "c_nationkey"], "STRING": ["c_name", "c_mktsegment"], "DOUBLE": ["c_acctbal"]}),
    "Document": ("documents", "doc_id", {"BIGINT": ["doc_id", "n_chars"], "STRING": ["text", "lang", "source"]}),
    "EntityCanonical": ("embeddings", "vec_id", {"BIGINT": ["vec_id", "label"]}),
    "Order": ("orders", "o_orderkey", {"BIGINT": ["o_orderkey", "o_custkey"], "STRING": ["o_orderstatus", "o_orderpriority"], "DOUBLE": ["o_totalprice"]}),
}
UNPIVOTED = " union all ".join(f"select '{t}:' || {key} as node_id, '{label}' as label, '{c}' as key, '{kind}' as kind, cast({c} as varchar) as value, try_cast({c} as double) as number from {t} where {c} is not null" for label, (t, key, kinds) in KINDS.items() for kind, columns in kinds.items() for c in columns)


@query(f"with p as ({UNPIVOTED}) select label, key, kind, count(*) as n, count(distinct value) as n_values, round(sum(case when kind <> 'STRING' then number end), 2) as total from p group by label, key, kind")
def property_kinds(spark, d):
    """What properties the nodes of each label have, of which kinds: strings, numbers and booleans, no vectors and no times."""
    rows = V.properties(V.load_properties(spark, d))
    number = F.when(F.col("kind") != "STRING", F.expr("try_variant_get(value, '$', 'double')"))
    return rows.groupBy("label", "key", "kind").agg(F.count("*").alias("n"), F.count_distinct(F.expr("cast(value as string)")).alias("n_values"), F.round(F.sum(number), 2).alias("total"))


@query(f"with p as ({UNPIVOTED}) select node_id, label, key from p where kind <> 'DOUBLE' and contains(lower(value), 'h#00000001') union all select 'part:' || p_partkey, 'Part', 'p_size' from part where p_size > 45 and p_brand = 'Brand#13'")
def property_search(spark, d):
    """Substrings of any plain property, and typed values of some."""
    nodes = V.load_properties(spark, d)
    sized = nodes.filter((V.typed("p_size", "int") > 45) & (V.typed("p_brand", "string") == "Brand#13")).select("node_id", "label", F.lit("p_size").alias("key"))
    return V.holding(nodes, "H#00000001").unionByName(sized)


@query(f"""with p as ({UNPIVOTED} union all select 'embeddings:' || vec_id, 'EntityCanonical', 'embedding', 'ARRAY<FLOAT>', '', null from embeddings where embedding is not null union all select 'orders:' || o_orderkey, 'Order', 'o_orderdate', 'TIMESTAMP_NTZ', '', null from orders where o_orderdate is not null)
select label, 'OBJECT<' || string_agg(key || ': ' || kind, ', ' order by key) || '>' as schema from (select distinct label, key, kind from p) group by label""")
def property_schemas(spark, d):
    """The schema that each label's nodes turn out to have."""
    return V.schemas(V.load_properties(spark, d))


SPREAD = """'{' || chr(10) || concat_ws(',' || chr(10), '  "label": ' || to_json(label)::varchar, '  "n": ' || n, case when least_ is null then null else '  "s": {' || chr(10) || '    "least": ' || to_json(least_)::varchar || ',' || chr(10) || '    "many": ' || (n > 30) || chr(10) || '  }' end, '  "l": [' || chr(10) || '    1,' || chr(10) || '    2' || chr(10) || '  ]') || chr(10) || '}'"""


@query(f"""{GRAPH}, r as (select label, count(*) as n, min(name) as least_ from nodes group by label)
select 1 as qid, string_agg(i || '. ' || j, chr(10) order by i) as context from (select row_number() over (order by label) as i, {SPREAD} as j from r)
union all select 2, string_agg(i || '. ' || j, chr(10) order by i) from (select row_number() over (order by node_id) as i, to_json(struct_pack(node_id := node_id, name := name))::varchar as j from nodes where label = 'Nation' qualify i <= 10)""")
def statement_records(spark, d):
    """Rows of statements as JSON: spread over lines at every level, 15 of them; and ten compact ones of the plain pipeline."""
    g, one = stored(spark, d), lambda n: spark.createDataFrame([(n, "What?")], "qid int, question string")
    statement = "select label, n, if(least is null, null, named_struct('least', least, 'many', n > :many, 'embedding', array(1.0))) as s, array(1, 2) as l from (select labels[0] as label, count(*) as n, min(name) as least from nodes group by labels[0]) order by label"
    both = ask_statement(g, one(1), statement, {"many": 30}).unionByName(ask_statement(g, one(2), "select node_id, name from nodes where array_contains(labels, 'Nation') order by node_id", plain=True))
    return both.select("qid", "context")


@query(f"""{GRAPH}, {GIVEN.replace(ENTITY.replace("text", "question"), f"trim(list_filter({WORDS.replace('text', 'question')}, lambda w: length(w) > 4)[1], '?,.:;')")},
found as (select n.*, needle from nodes n, (select distinct entity as needle from q where entity is not null) where {sql_match('needle', 'n.')}),
hits as (select found.*, e.edge_id, e.type, m.label as target_label, {SHOWN.format('m.')} as target, {SHOWN.format('found.')} as shown from found left join edges e on e.src = found.node_id left join nodes m on m.node_id = e.dst qualify row_number() over (partition by needle order by found.node_id, e.edge_id nulls first) <= 5),
lines as (select needle, i, case when shown <> '' then i || '. ' || label || ': ' || {sql_clip('shown', 200)} end as node_line, case when edge_id is not null and target <> '' then '   → ' || type || ': ' || target_label || ' - ' || {sql_clip('target', 150)} end as edge_line
  from (select *, row_number() over (partition by needle order by node_id, edge_id nulls first) as i from hits)),
c as (select needle, coalesce(string_agg(s, chr(10) order by i), '') as context from (select needle, i, nullif(concat_ws(chr(10), node_line, edge_line), '') as s from lines) group by needle),
first as (select qid, question, case when entity is null then '{C.NO_ENTITY_PLAIN}' else coalesce(context, 'No results found for ''' || entity || '''.') end as context from q left join c on needle = entity)
select {RECORD.format(LINE, ANSWERED.format(sql_clip("context", 3000, "chr(10) || '... (truncated for length)'"), "question"))} from first""")
def plain_records(spark, d):
    """Answer records of the plain pipeline."""
    return ask_plain(stored(spark, d), asked(spark))


@query("select doc_id, cast(length(t) as int) as context_length, md5({}) as prompt_md5 from (select doc_id, coalesce(text, '-') as t from documents)".format(ANSWERED.format(sql_clip("t", 3000, "chr(10) || '... (truncated for length)'"), "'Why?'")))
def plain_prompts(spark, d):
    """Prompts of the plain pipeline, with whole documents as contexts: cut at 3,000 characters."""
    text = F.coalesce("text", F.lit("-"))
    return table(spark, d, "documents").select("doc_id", F.length(text).alias("context_length"), F.md5(C.prompt(F.lit("Why?"), text, 3000, C.CUT_PLAIN)).alias("prompt_md5"))


LATERAL = [(1, "red bolt"), (2, "Blue"), (3, "no such thing"), (4, "È d")]


@query(f"""{GRAPH}, asked as (select * from (values {', '.join(f"({i}, '{n}')" for i, n in LATERAL)}) v(qid, needle)),
found as (select qid, n.*, {sql_score('needle')} as relevance from nodes n, asked where {sql_match('needle', 'n.')} qualify row_number() over (partition by qid order by relevance desc, node_id) <= 15)
select qid, node_id, relevance, edge_id, type, dst from found join edges on src = node_id""")
def lateral_search(spark, d):
    """Search and expansion as table functions in one SELECT, for each row of a table of needles."""
    g = N.stored_index(spark, d)
    Z.register(g)
    spark.createDataFrame(LATERAL, "qid int, needle string").createOrReplaceTempView("asked_needles")
    return S.select(g, f"select f.qid, f.node_id, f.relevance, e.edge_id, e.type, e.dst from ({Z.SEARCH.format(asked='asked_needles', limit=15)}) f, lateral node_edges(f.node_id) e")


def many(*values):
    return F.array(*[F.lit(v) for v in values])


@query(f"""{GRAPH}, {WALKS.format("n.node_id = 'supplier:1'", 2)}, {SCORED.replace(f"'{NEEDLE}'", "'bolt'")},
v as (select vec_id, count(*) over (partition by label) as n from embeddings)
select 'by_key' as name, 'vec:' || vec_id || '|EntityCanonical' as line from embeddings where vec_id = 3
union all select 'typed_edges', count(*)::varchar from edges where type = 'IN_NATION' and src like 'customer:%'
union all select 'without_edges', count(*)::varchar from nodes where label = 'Part' and node_id not in (select src from edges) and node_id not in (select dst from edges)
union all select 'labels', string_agg(distinct label, ',' order by label) from nodes union all select 'types', string_agg(distinct type, ',' order by type) from edges
union all select 'given_rows', 'vec:' || vec_id || '|' || case vec_id when 1 then '0.5' else '0.25' end from embeddings where vec_id in (1, 2)
union all select 'merge', 'vec:1|vec:2|0.75|true' union all select 'merge', 'vec:2|vec:1|0.25|true'
union all select 'walks', start_id || '|' || end_id || '|' || path_length || '|' || array_to_string(ids, ',') from w
union all select 'ranked_then_optional', top.node_id || '|' || name || '|' || relevance || '|' || e.type || '|' || e.dst from top join edges e on e.src = top.node_id
union all (select 'label_expand', n.node_id || '|' || n.name || '|' || e.type || '|' || m.node_id || '|' || m.name from nodes n join edges e on e.src = n.node_id join nodes m on m.node_id = e.dst where n.label = 'Part' and contains(lower(n.name), 'red') order by n.node_id, e.edge_id limit 7)""")
def statement_templates(spark, d):
    """Every template of a statement, on the stored graph."""
    g = stored(spark, d)
    given = {
        "label_expand": {"label": "Part", "needle": "RED", "limit": 7}, "ranked_then_optional": {"needle": "bolt", "limit": 15}, "by_key": {"key": "3", "label": "EntityCanonical"},
        "typed_edges": {"type": "IN_NATION", "source": "Customer", "target": "Nation"}, "walks": {"start": "supplier:1", "hops": 2, "limit": 1000}, "without_edges": {"type": "SUPPLIED_BY", "label": "Part"},
        "labels": {}, "types": {}, "given_rows": {"keys": many("1", "2", "x"), "scores": many(0.5, 0.25, 1.0)}, "duplicate_keys": {"label": "EntityCanonical"},
        "merge": {"sources": many("1", "2", "1", "x"), "targets": many("2", "1", "2", "1"), "scores": many(0.5, 0.25, 0.75, 1.0), "type": "SIMILAR_TO"},
    }
    out = None
    for name, args in given.items():
        rows = S.select(g, Z.TEMPLATES[name], args)
        one = rows.select(F.lit(name).alias("name"), F.concat_ws("|", *[F.col(c).cast("string") for c in rows.columns]).alias("line"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""{GRAPH} select n.label, e.type, m.label as target_label, count(*) as n, count(distinct n.node_id) as n_sources, sum(length({SHOWN.format('m.')}))::bigint as shown
  from nodes n left join edges e on e.src = n.node_id left join nodes m on m.node_id = e.dst where contains(lower(coalesce(n.name, n.text)), 'e') group by all""")
def bucketed_expansion(spark, d):
    """Expansion of all nodes that a broad filter leaves: both tables lie in the same buckets, so neither is moved."""
    own = save_bucketed(stored(spark, d), 8)
    rows = own.expanded(own.nodes.filter(F.contains(F.lower(F.coalesce("name", "text")), F.lit("e"))))
    target = F.when(F.col("target_id").isNotNull(), X.label("target_labels"))
    return rows.groupBy(X.label().alias("label"), "type", target.alias("target_label")).agg(F.count("*").alias("n"), F.count_distinct("node_id").alias("n_sources"), F.sum(F.length(X.shown("target_"))).alias("shown"))


FIRST_MINUTE = 28_333_333  # of the first turn, since 1970
LAST_SECOND = 2 * 10**9  # of the row that ends the stream


@query(rf"""with {SPOKEN}, t as (select *, conv_id % 7 + 2 * turn + case when turn >= 3 then 100 else 0 end as m from spoken),
s as (select *, case when m - lag(m) over (partition by conv_id order by m, turn) <= 60 then 0 else 1 end as new from t),
g as (select *, sum(new) over (partition by conv_id order by m, turn rows unbounded preceding) as part from s),
f as (select *, min(m) over (partition by conv_id, part) as began, max(case when role = 'user' and lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) in ('quit', 'exit', 'bye') then 1 else 0 end) over (partition by conv_id, part order by m, turn rows unbounded preceding) as out_ from g),
h as (select *, case when out_ = 0 and role = 'assistant' and ({" or ".join(f"contains(lower(text), '{w}')" for w in D.DIAGNOSIS)}) then 1 else 0 end as hit from f)
select conv_id, turn, cast(began as bigint) as began, hit = 1 and coalesce(max(hit) over (partition by conv_id, part order by m, turn rows between unbounded preceding and 1 preceding), 0) = 0 as notice, out_ = 1 as gone from h""")
def stream_sessions(spark, d):
    """Sessions in event time over a stream whose turns come out of order, in several batches, until the stream's end. Of the
    first 200 minutes a few files make a batch, as folders 40 minutes apart are never later than the delay; all that comes after, of
    any length, is one batch behind a restart, because files of one folder over several batches would be late to each other."""
    own, here = session_for(spark), f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}"
    minute = F.col("conv_id") % 7 + 2 * F.col("turn") + F.when(F.col("turn") >= 3, 100).otherwise(0)
    turns = spoken(spark, d).select("conv_id", "turn", "role", "text", F.timestamp_seconds((minute + FIRST_MINUTE) * 60).alias("ts"))
    arrival = F.least(F.lit(5), F.floor((minute + F.pmod(F.xxhash64("conv_id", "turn"), F.lit(20))) / 40))
    end = spark.range(1).select(F.lit(None).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("end").alias("role"), F.lit("").alias("text"), F.timestamp_seconds(F.lit(LAST_SECOND)).alias("ts"))

    def run(**options):
        stream = own.readStream.schema(turns.schema).options(**options).parquet(f"{here}/in/*")
        sessions(stream, "90 minutes").writeStream.format("parquet").option("checkpointLocation", f"{here}/checkpoint").option("path", f"{here}/rows").trigger(availableNow=True).start().awaitTermination()

    for k in range(5):
        turns.filter(arrival == k).write.parquet(f"{here}/in/{k}")
    run(maxFilesPerTrigger=6)
    turns.filter(arrival == 5).unionByName(end).write.parquet(f"{here}/in/5")
    run()
    ended = F.col("conv_id").isNull() & (F.col("began") == LAST_SECOND * 10**6)
    out = spark.read.schema("conv_id long, began long, turn long, notice boolean, gone boolean").parquet(f"{here}/rows").filter(~ended)
    return out.withColumn("began", F.expr(f"began div 60000000 - {FIRST_MINUTE}"))


@query(f"""{GRAPH}, {GIVEN}, {CONTEXTS}, sent as (select *, case when qid % 2 = 0 then 'brief' else 'doubting' end as b from first)
select qid, question, case when b = 'brief' or {GOOD} then {LINE} else 'There is not enough information.' end as answer, context, b as backend, 'extract' as model, cast(length({PROMPT}) as int) as prompt_length, cast(length(context) as int) as context_length, 'ok' as status from sent""")
def routed_records(spark, d):
    """Answer records whose questions name their backends; what one run has been told, the next one doesn't ask for."""
    log = new_log(spark, "answers")
    questions = asked(spark).withColumns({"backend": F.when(F.col("qid") % 2 == 0, "brief").otherwise("doubting"), "model": F.lit(None).cast("string")})
    routes = {"brief": Route(lambda _: M.Extract(), 2), "doubting": Route(lambda _: M.Doubting(), 2, 1)}
    ask_routed(stored(spark, d), questions, routes, log)
    return ask_routed(stored(spark, d), questions, {k: Route(None, r.lanes) for k, r in routes.items()}, log)


@query("""select q.vec_id as query, v.vec_id as vec_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as score, cast(row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) desc, v.vec_id) as int) as rank
  from embeddings q join embeddings v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0 qualify rank <= 10""")
def nearest_exact(spark, d):
    """The ten nearest vectors of each whose id is divisible by 100, among all."""
    v = table(spark, d, "embeddings")
    return E.exact(v, v.filter("vec_id % 100 = 0"))


@query("select count(*) as n_queries, 10 * count(*) as n_true, true as enough from embeddings where vec_id % 100 = 0")
def nearest_recall(spark, d):
    """How many of these the index finds: nine of ten at least, by probing 40 of 64 cells and comparing 200 candidates exactly."""
    v = table(spark, d, "embeddings")
    book, queries = E.fit(v), v.filter("vec_id % 100 = 0")
    found = E.search(kept(E.index(v, book), "codes"), v, queries, book, probes=40, rerank=200)
    return E.recall(found, E.exact(v, queries)).select("n_queries", "n_true", (F.col("recall") >= 0.9).alias("enough"))


@query(ORACLE["label_substring_expand"])
def indexed_label_search(spark, d):
    """The nodes of a label, from its own folders, with a substring and the edges they must have."""
    return S.labelled(N.stored_index(spark, d), "Part", WIDE).select("node_id", "name", "edge_id", "target_id", "target_name")
