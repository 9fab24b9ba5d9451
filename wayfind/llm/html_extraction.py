"""HTML extraction by wrapper induction.

1. Each page becomes a tree of its block elements without texts. Equal trees of a host are counted, and all of them are merged
   into the host's template by simple tree matching, in rounds, so that no task merges many.
2. Each page is aligned with its host's template, again by simple tree matching, which gives every text a slot. Texts are
   counted by slot. One that is on CONSTANT of a host's pages, of which there must be LEAST, is constant: it is part of the
   template. Of the varying slots, the deepest node that holds MOST of the host's varying text is the content slot; slots
   whose text is mostly links are menus.
3. Each page is aligned again. Its text is what varies within its articles, or, if it has none with a text, within the
   content slot; on a page without that slot, within the deepest element of its own that holds MOST of its text.

What an element's name, role or class says is boilerplate is never content. Pages whose class names say so of all their text
are read again without regard to these. Texts that are all constant (copies of one page make up a host) are kept.

A null url, or one without a host, has no template, and its page is judged by itself, as is a host's only page; so what a page
gives depends on its host's pages, not on how they are dealt. A null or empty html, or one without text, gives an empty text.
Repeated rows get a row each; page_id and url are passed through as they are; other columns are ignored; an empty table gives
an empty result. Pages of any length are read whole.
"""

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import by_value, partitions, save, table, trimmed
from wayfind.llm.dom import ARTICLE, BOILER, FLOW, MAIN, Page, aligned, bare, grown, merge, numbered, skeleton

by_value(__name__)

LEAST, CONSTANT, MOST = 8, 0.8, 0.6
MERGED = 1000  # trees that one task merges in a round
NODES = 5000  # a template with more nodes forgets those of a single page
BROADCAST = 32 << 20  # bytes of wrappers up to which pages aren't dealt by host
HOT, SALTS = 1000, 64  # beyond that, a host with a thousandth of all pages goes to so many tasks


def host(url) -> F.Column:
    """The host of a url in lower case, without user and port; null if there is none."""
    found = F.regexp_extract(F.lower(url), r"^\s*[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(found, F.lit(""))


def strings(columns) -> list:
    return list(zip(*(c.to_pylist() for c in columns), strict=True))


def skeletons(batches):
    """mapInArrow function: (host, html) to (host, tree, n) of a batch's different trees."""
    for b in batches:
        seen: dict[tuple[str, str], int] = {}
        for h, html in strings(b.columns):
            key = h, json.dumps(bare(skeleton(Page(html or ""))), separators=(",", ":"))
            seen[key] = seen.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in seen], pa.string()), pa.array([t for _, t in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["host", "tree", "n"])


def pruned(tree: list) -> None:
    """Take out what a single page has, without its descendants being more frequent."""
    tree[2] = [c for c in tree[2] if c[1] > 1]
    for c in tree[2]:
        pruned(c)


def merged(first: bool):
    """mapInArrow function over rows (host, salt, tree, n), in order: (host, salt, tree, n) with one tree for each host and
    salt. ``first``: trees are still those of pages."""

    def run(batches):
        key, tree, pages = None, None, 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array([json.dumps(bare(tree, True), separators=(",", ":"))]), pa.array([pages], pa.int64())], ["host", "salt", "tree", "n"])

        for b in batches:
            for h, salt, raw, n in strings(b.columns):
                own = grown(json.loads(raw), n if first else None)
                if (h, salt) != key:
                    if key is not None:
                        yield row()
                    key, tree, pages = (h, salt), own, n
                    continue
                merge(tree, own)
                pages += n
                if len(numbered(tree)) > NODES:
                    pruned(tree)
        if key is not None:
            yield row()

    return run


def templates(rows: DataFrame) -> DataFrame:
    """(host, tree, n) of pages (host, html): the template and the number of pages of each host that has several."""
    p = partitions(rows.sparkSession)
    seen = rows.filter("host is not null").select("host", "html").mapInArrow(trimmed(skeletons), "host string, tree string, n long").groupBy("host", "tree").agg(F.sum("n").alias("n"))
    now, first = save(seen, "trees"), True
    while True:
        most = now.groupBy("host").count().agg(F.max("count")).first()[0] or 1
        salts = -(-most // MERGED)
        dealt = now.select("host", F.pmod(F.xxhash64("tree"), F.lit(salts)).alias("salt"), "tree", "n").repartition(p, "host", "salt").sortWithinPartitions("host", "salt", "tree")
        out = dealt.mapInArrow(merged(first), "host string, salt long, tree string, n long").select("host", "tree", "n")
        if salts == 1:
            return out.filter("n > 1")
        now, first = save(out, "trees"), False


def slots(page: Page, template: list, number: dict[int, int]) -> list[int]:
    """For each node of a page the number of its partner in the template, or -1."""
    out = [-1] * len(page.nodes)
    for node, k in aligned(template, skeleton(page), number):
        for i in node[3]:
            out[i] = k
    return out


class Wrapper:
    """A host's template, and what its pages' texts have shown."""

    def __init__(self, raw: str | None):
        at = json.loads(raw) if raw else {}
        self.template = grown(at["tree"]) if at else None
        nodes = numbered(self.template) if at else []
        self.number = {id(t): k for k, t in enumerate(nodes)}
        self.constant = {tuple(x) for x in at.get("constant", [])}
        self.menus, self.content = set(at.get("menus", [])), at.get("content")
        self.known: dict[tuple, list[int]] = {}

    def slots(self, page: Page) -> list[int]:
        if self.template is None:
            return [-1] * len(page.nodes)
        key = tuple((p, s, f & BOILER) for p, s, f in page.nodes)
        if key not in self.known:
            if len(self.known) > 1000:
                self.known.clear()
            self.known[key] = slots(page, self.template, self.number)
        return self.known[key]


def wrappers_of(raws: dict, raw: str | None) -> Wrapper:
    if raw not in raws:
        if len(raws) > 200:
            raws.clear()
        raws[raw] = Wrapper(raw)
    return raws[raw]


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def slot_texts(batches):
    """mapInArrow function: (host, html, wrapper) to (host, slot, digest, n, size, links) of the texts in a batch."""
    raws: dict = {}
    for b in batches:
        seen: dict[tuple, list[int]] = {}
        for h, html, raw in strings(b.columns):
            page, wrapper = Page(html or ""), wrappers_of(raws, raw)
            where, once = wrapper.slots(page), set()
            for node, text, links in page.blocks:
                key = h, where[node], digest(text)
                row = seen.setdefault(key, [0, 0, 0])
                row[0] += key not in once
                row[1] += len(text)
                row[2] += links
                once.add(key)
        columns = [pa.array([k[i] for k in seen], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array([v[i] for v in seen.values()], pa.int64()) for i in range(3))], ["host", "slot", "digest", "n", "size", "links"])


def flowing(sig: str) -> bool:
    """Whether an element is a paragraph or the like, and so no place for a whole text."""
    return sig.split(" ")[0] in FLOW | {"flow"}


def decided(batches):
    """mapInArrow function: (host, tree, slots) to (host, wrapper). slots: (slot, size, links, constant digests)."""
    for b in batches:
        out = []
        for h, raw, stats in strings(b.columns):
            tree = json.loads(raw)
            nodes = numbered(grown(tree))
            place = {id(t): k for k, t in enumerate(nodes)}
            own = {s["slot"]: s for s in stats or []}
            menus = sorted(k for k, s in own.items() if k >= 0 and 2 * s["links"] > s["size"])
            total = [own[k]["size"] if k in own and k not in menus else 0 for k in range(len(nodes))]
            for k in reversed(range(len(nodes))):
                total[k] += sum(total[place[id(c)]] for c in nodes[k][2])
            content = 0
            while best := next((place[id(c)] for c in nodes[content][2] if total[place[id(c)]] >= MOST * total[0] and not flowing(c[0])), None) if total[0] else None:
                content = best
            constant = sorted((k, d) for k, s in own.items() for d in s["constant"])
            out.append((h, json.dumps({"tree": tree, "content": content, "menus": menus, "constant": constant}, separators=(",", ":"))))
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in out], pa.string()), pa.array([w for _, w in out], pa.string())], ["host", "wrapper"])


def with_wrappers(rows: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """Pages with their host's ``column`` as wrapper, null where the host has none. ``found`` (host, column, n) is read from
    storage. It is broadcast if it is small; else pages are dealt by host, those of hot hosts, which are a thousand at
    most, to several tasks each."""
    size = found.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    short = found.select("host", F.col(column).alias("wrapper"), "n")
    if size[0] <= BROADCAST:
        return rows.join(F.broadcast(short.drop("n")), "host", "left")
    hot = short.filter(F.col("n") * HOT > size[1]).select("host", F.lit(SALTS).alias("salts"))
    salted = rows.join(F.broadcast(hot), "host", "left").withColumn("salt", F.when(F.col("host").isNull(), F.pmod(F.xxhash64("html"), F.lit(SALTS))).otherwise(F.pmod(F.xxhash64("html"), F.coalesce("salts", F.lit(1))))).drop("salts")
    copies = short.drop("n").join(F.broadcast(hot), "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)).cast("long") - 1))).drop("salts")
    return salted.join(copies.hint("shuffle_hash"), ["host", "salt"], "left").drop("salt")


def wrappers(rows: DataFrame) -> DataFrame:
    """(host, wrapper, n) of pages (host, html)."""
    found = save(templates(rows), "templates")
    bare_ = found.select("host", F.concat(F.lit('{"tree":'), "tree", F.lit("}")).alias("wrapper"), "n")
    known = with_wrappers(rows.filter("host is not null"), bare_, "wrapper").filter("wrapper is not null")
    texts = known.select("host", "html", "wrapper").mapInArrow(trimmed(slot_texts), "host string, slot long, digest long, n long, size long, links long")
    counted = texts.groupBy("host", "slot", "digest").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.sum("links").alias("links"))
    many = found.select("host", F.col("n").alias("pages"))
    judged = counted.join(many, "host").withColumn("fixed", (F.col("pages") >= LEAST) & (F.col("n") >= CONSTANT * F.col("pages")))
    by_slot = judged.groupBy("host", "slot").agg(F.sum(F.when(~F.col("fixed"), F.col("size")).otherwise(0)).alias("size"), F.sum(F.when(~F.col("fixed"), F.col("links")).otherwise(0)).alias("links"), F.array_sort(F.collect_list(F.when(F.col("fixed"), F.col("digest")))).alias("constant"))
    by_host = by_slot.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("slot", "size", "links", "constant"))).alias("slots"))
    done = found.join(by_host, "host", "left").select("host", "tree", "slots").mapInArrow(decided, "host string, wrapper string")
    return done.join(many.withColumnRenamed("pages", "n"), "host")


def below(page: Page, chosen: set[int]) -> list[bool]:
    """For each node whether it or one above it is chosen."""
    out: list[bool] = []
    for k, (parent, _, _) in enumerate(page.nodes):
        out.append(k in chosen or (parent >= 0 and out[parent]))
    return out


def heavy(page: Page, sizes: list[int]) -> int:
    """The deepest node that holds MOST of the text."""
    total = sizes[:]
    for k in reversed(range(1, len(total))):
        total[page.nodes[k][0]] += total[k]
    node = 0
    for k in range(1, len(total)):  # children come after their parents
        if page.nodes[k][0] == node and total[k] >= MOST * total[0] and not flowing(page.nodes[k][1]):
            node = k
    return node


def main_text(page: Page, wrapper: Wrapper) -> str | None:
    """The text of a page's blocks that are content; None if there is none."""
    if not page.blocks:
        return None
    where = wrapper.slots(page)
    flags = [f for _, _, f in page.nodes]
    for kind in (ARTICLE, MAIN):
        own = [x for x in page.blocks if flags[x[0]] & kind]
        if own:
            break
    else:
        inside = [False]
        if wrapper.content:
            inside = below(page, {k for k, slot in enumerate(where) if slot == wrapper.content})
        if not any(inside[x[0]] for x in page.blocks if len(inside) > 1):
            sizes = [0] * len(page.nodes)
            for node, text, links in page.blocks:
                sizes[node] += len(text) if 2 * links <= len(text) else 0
            inside = below(page, {heavy(page, sizes)})
        own = [x for x in page.blocks if inside[x[0]]]
        own = [x for x in own if where[x[0]] not in wrapper.menus and 2 * x[2] <= len(x[1])] or own
    own = [x for x in own if (where[x[0]], digest(x[1])) not in wrapper.constant] or own if wrapper.constant else own
    return "\n\n".join(text for _, text, _ in own)


def extracted(batches):
    """mapInArrow function: (page_id, url, html, wrapper) to (page_id, url, text, n_chars)."""
    raws: dict = {}
    for b in batches:
        texts = []
        for html, raw in strings(b.columns[2:]):
            wrapper = wrappers_of(raws, raw)
            text = main_text(Page(html or ""), wrapper)
            if text is None and html:
                text = main_text(Page(html, by_words=False), wrapper)
            texts.append((text or "").encode("utf-8", "replace").decode())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html): the main text, its blocks joined by two line ends."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host(F.col("url")).alias("host"), "html")
    known = save(wrappers(rows), "wrappers")
    return with_wrappers(rows, known, "wrapper").select("page_id", "url", "html", "wrapper").mapInArrow(trimmed(extracted), "page_id long, url string, text string, n_chars long")


def op12_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
