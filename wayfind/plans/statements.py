"""SQL for the patterns that questions about a graph are made of: templates over the views nodes and edges, and table functions
for use beside other tables.

A template is a SELECT statement with named parameters, for search.select(). A table function is used laterally, once for each
row of another table: `select * from asked, lateral node_edges(asked.node_id)`.
"""

from pyspark.sql import functions as F

from wayfind.operators.grams import GRAM, RAREST

#: Patterns by name; the parameters are named in each.
TEMPLATES = {
    # nodes of a label with a substring in a property, each with its outgoing edges and their ends
    "label_expand": """select n.node_id, n.name, e.type, m.node_id as target_id, m.name as target_name from nodes n join edges e on e.src = n.node_id join nodes m on m.node_id = e.dst
      where array_contains(n.labels, :label) and contains(lower(n.name), lower(:needle)) order by n.node_id, e.edge_id limit :limit""",
    # the most relevant nodes first, then their edges where there are some
    "ranked_then_optional": """with found as (select node_id, name, case when lower(name) = lower(:needle) or lower(canonical_name) = lower(:needle) then 10
        when contains(lower(name), lower(:needle)) or contains(lower(canonical_name), lower(:needle)) then 5 else 1 end as relevance from nodes
        where contains(lower(text), lower(:needle)) or contains(lower(name), lower(:needle)) or contains(lower(canonical_name), lower(:needle)) order by relevance desc, node_id limit :limit)
      select f.node_id, f.name, f.relevance, e.type, e.dst from found f left join edges e on e.src = f.node_id order by f.relevance desc, f.node_id, e.edge_id""",
    # a node by the value of a key
    "by_key": "select node_id, labels[0] as label from nodes where canonical_id = :key and array_contains(labels, :label)",
    # edges of a type between nodes of a label
    "typed_edges": """select count(*) as n from edges e join nodes a on a.node_id = e.src join nodes b on b.node_id = e.dst
      where e.type = :type and array_contains(a.labels, :source) and array_contains(b.labels, :target)""",
    # walks of up to some edges, each edge once; shorter ones first
    "walks": """with recursive w(start_id, end_id, path_length, edge_ids) as (
        select src, dst, 1, array(edge_id) from edges where src = :start
        union all select w.start_id, e.dst, w.path_length + 1, array_append(w.edge_ids, e.edge_id) from w join edges e on e.src = w.end_id where w.path_length < :hops and not array_contains(w.edge_ids, e.edge_id))
      select start_id, end_id, path_length, array_join(edge_ids, ',') as path from w order by path_length, path, end_id limit :limit""",
    # nodes without an edge of a type, going out or coming in: two anti joins
    "without_edges": """select count(*) as n from nodes n left anti join (select src from edges where type = :type) o on o.src = n.node_id left anti join (select dst from edges where type = :type) i on i.dst = n.node_id
      where array_contains(n.labels, :label)""",
    "labels": "select array_join(array_sort(collect_set(label)), ',') as labels from (select explode(labels) as label from nodes)",
    "types": "select array_join(array_sort(collect_set(type)), ',') as types from edges",
    # rows given with the statement, joined by key
    "given_rows": "select n.node_id, r.score from (select inline(arrays_zip(:keys, :scores))) r(k, score) join nodes n on n.canonical_id = r.k",
    # what a merge of given links would add, and what it would set anew
    "merge": """select a.node_id as src, b.node_id as dst, max_by(r.score, r.no) as score, max(e.edge_id) is null as new
      from (select no, x.`0` as s, x.`1` as t, x.`2` as score from (select posexplode(arrays_zip(:sources, :targets, :scores)) as (no, x))) r
      join nodes a on a.canonical_id = r.s join nodes b on b.canonical_id = r.t left join edges e on e.src = a.node_id and e.dst = b.node_id and e.type = :type group by a.node_id, b.node_id""",
    # keys that a uniqueness constraint would refuse
    "duplicate_keys": "select canonical_id, count(*) as n from nodes where array_contains(labels, :label) and canonical_id is not null group by canonical_id having count(*) > 1",
}


def code(text: str, at: str = "1") -> str:
    """SQL of the number of the three characters of a string from a place on."""
    return " + ".join(f"shiftleft(cast(ascii(substr({text}, {at} + {k}, 1)) as bigint), {21 * k})" for k in range(3))


def unpacked(places: str) -> str:
    """SQL of the 16-bit numbers in a binary value."""
    byte = lambda at: f"cast(conv(hex(substr({places}, {at}, 1)), 16, 10) as bigint)"
    return f"transform(sequence(1, length({places}) - 1, 2), i -> {byte('i')} + 256 * {byte('i + 1')})"


#: Ranked search for each row of a table asked (qid, needle), as search.top_scored() ranks: for an indexed graph, see register().
#: Each needle's rarest trigrams meet their postings by equality, block by block; only places that are in all of them fetch a node.
SEARCH = f"""with needles_ as (select distinct lower(needle) as q from {{asked}} where length(needle) >= {GRAM}),
wanted_ as (select q, explode(array_distinct(transform(sequence(1, length(q) - {GRAM - 1}), i -> {code("q", "i")}))) as gram from needles_),
sizes_ as (select w.q, w.gram, coalesce(sum(s.n), 0) as size from wanted_ w left join stored_grams s on s.gram = w.gram group by w.q, w.gram),
rarest_ as (select q, gram, count(*) over (partition by q) as wanted from (select *, row_number() over (partition by q order by size, gram) as r from sizes_) where r <= {RAREST}),
lists_ as (select q, layer, bucket, block, gram, max(wanted) as wanted, flatten(collect_list({unpacked("places")})) as list
  from (select r.q, r.gram, r.wanted, p.* from rarest_ r, lateral gram_places(r.gram) p) group by q, layer, bucket, block, gram),
places_ as (select q, layer, bucket, block, explode(reduce(lists, lists[0], (a, b) -> array_intersect(a, b))) as place
  from (select q, layer, bucket, block, collect_list(list) as lists from lists_ group by q, layer, bucket, block having count(*) = max(wanted))),
found_ as (select p.q, n.node_id, n.name, {{relevance}} as relevance from places_ p, lateral node_at(p.layer, p.bucket, p.block * 65536 + p.place) n)
select * from (select asked.qid, f.node_id, f.name, f.relevance, row_number() over (partition by asked.qid order by f.relevance desc, f.node_id) as rank
  from {{asked}} asked join found_ f on f.q = lower(asked.needle) where f.relevance is not null) where rank <= {{limit}}""".replace(
    "{relevance}", "case when lower(n.name) = p.q or lower(n.canonical_name) = p.q then 10 when contains(lower(n.name), p.q) or contains(lower(n.canonical_name), p.q) then 5 when contains(lower(n.text), p.q) then 1 end"
)


def register(graph) -> None:
    """Register the views nodes and edges of an indexed graph, and table functions over it:

    gram_places(gram): the packed places that hold a trigram, by layer, bucket and block of the stored nodes; node_at(layer, bucket,
    row): the node at a place. Both meet what calls them by equality; SEARCH tests for the needle behind these joins.
    node_edges(node): the edges that leave a node. node_walks(node): its walks of one or two edges.
    """
    spark = graph.log.spark
    graph.views()
    graph.rows("nodes").createOrReplaceTempView("stored_nodes")
    graph.rows("grams").select("gram", "node_layer", "node_bucket", "block", "n", "places").createOrReplaceTempView("stored_grams")
    graph.segments().select("src", F.explode("edges").alias("e")).select("src", "e.edge_id", "e.dst", "e.type").createOrReplaceTempView("stored_edges")
    spark.sql("""create or replace temporary function gram_places(wanted bigint) returns table(layer string, bucket int, block bigint, places binary) return
      select node_layer, node_bucket, block, places from stored_grams where gram = wanted""")
    spark.sql("""create or replace temporary function node_at(in_layer string, in_bucket int, at bigint) returns table(node_id string, name string, canonical_name string, text string) return
      select node_id, name, canonical_name, text from stored_nodes where layer = in_layer and bucket = in_bucket and _row = at""")
    spark.sql("create or replace temporary function node_edges(node string) returns table(edge_id string, type string, dst string) return select edge_id, type, dst from stored_edges where src = node")
    spark.sql("""create or replace temporary function node_walks(node string) returns table(path_length int, path string, end_id string) return
      select path_length, path, end_id from (select src, 1 as path_length, edge_id as path, dst as end_id from stored_edges
        union all select a.src, 2, a.edge_id || ',' || b.edge_id, b.dst from stored_edges a join stored_edges b on b.src = a.dst and b.edge_id <> a.edge_id) where src = node""")
