"""LM scoring with a weighted backoff automaton over words.

Tokens are the words of a lower-cased text (A-Z) and one end; a text begins after an end. All n-grams of the training
texts up to ``order`` tokens are counted, none is left out, so the model grows with the corpus. Probabilities are
smoothed with Dirichlet priors: p(w | h) = (c(hw) + m p(w | h')) / (c(h) + m), where h' is h without its first token and
m the order's ``mass``; a single token has (c + 0.1) / (N + 0.1 (V + 1)), which unknown words share.

The counted n-grams become an automaton. Its states are the empty history and every counted history of fewer than
``order`` tokens; an arc for each counted n-gram reads a token, weighs log10 p(w | h) and leads to the longest state that
ends with it; a state's failure arc drops the first token of its history and weighs log10(m / (c(h) + m)). A text is one
left-to-right traversal, which carries the state: take the arc, or failure arcs until there is one.

The automaton of a large corpus fits on no machine, but a block of texts reaches only the part that its own n-grams name:

1. Each task turns its texts into blocks (word numbers and the block's words), which executors keep on disk.
2. Each block sends its different n-grams with their training counts to buckets, single words as strings, longer ones as
   sorted 56-bit hashes. A bucket adds up what all blocks sent and answers each block with the sums, in the order asked.
   A block sends an n-gram once however often it occurs, so a frequent one is a short entry of each block.
3. Each block builds the part of the automaton that it can reach and traverses its texts. Long texts are cut in segments,
   which are traversed together; a segment starts ``order`` - 1 tokens early without adding, as the state depends on no more.

The number of buckets follows the counted tokens, and partitions are read sorted by bucket or block, so a task holds one
bucket or one block at a time. Two n-grams of two tokens or more with the same 56-bit hash share a count: of n different
n-grams about n / 2 ** 56 of all meet another one so.

Null texts are empty: just an end. Rows with a null doc_id are held out, as no checksum of theirs exists. Repeated rows
get a row each (and count as often). Other columns are ignored. Empty tables give empty results; without training
texts every count is zero.
"""

import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.cells import mix
from wayfind.llm.common import (
    LOWER,
    NO_ID,
    bucket_ids,
    bucket_of,
    by_bucket,
    by_value,
    edges,
    framed,
    groups,
    hold,
    keyed_rows,
    partitions,
    planes,
    table,
    trim,
    trimmed,
    unframed,
    unplanes,
)

by_value(__name__)

ORDER, MASS = 3, 16.0
BLOCK = 7 << 18  # tokens of a block; one text may have more
BUCKET = 1 << 21  # n-grams that a bucket should get
WORD_COST = 4  # n-grams that a word counts as there
NAME = 56  # bits of an n-gram's hash
SEGMENT = 256  # tokens of a text that are traversed on end
DOCS, WORDS, GRAMS = 0, 1, 2
ASKED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
ASKED_SQL = "bucket int, block long, kind int, blob binary"
COUNTED = pa.schema([*ASKED, ("types", pa.int64()), ("tokens", pa.int64())])
COUNTED_SQL = f"{ASKED_SQL}, types long, tokens long"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def text_of(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(b"\n".join(words))


def words_in(raw: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(raw).split(b"\n")


def held_out(doc: int) -> bool:
    return doc == NO_ID or zlib.crc32(str(doc).encode()) % 10 == 0


def blocks(most):
    """mapInArrow function over (doc_id, text): a row (block, blob, n_words) for each block. A block's numbers of words follow
    their frequency, then their spelling; 0 is the end."""

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        ids: dict[bytes, int] = {}
        docs, sizes, tokens, held = [], [], [], 0

        def flush():
            nonlocal ids, docs, sizes, tokens, block
            flat = np.concatenate(tokens)
            words = list(ids)
            spelt = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)  # neighbours compress together
            often = spelt[np.argsort(-np.bincount(flat, minlength=len(ids) + 1)[1:][spelt], kind="stable")]
            number = np.zeros(len(ids) + 1, np.uint32)
            number[1 + often] = np.arange(1, len(ids) + 1)
            n_words = len(ids)
            blob = framed(planes(np.array(docs, np.int64)), planes(np.array(sizes, np.int64)), planes(number[flat]), text_of([b"", *(words[i] for i in often.tolist())]))
            ids, docs, sizes, tokens = {}, [], [], []
            block += 1
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([blob], pa.binary()), pa.array([n_words])], ["block", "blob", "n_words"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = words_of(text.as_py())
                number = ids.setdefault
                tokens.append(np.array([*[number(w, len(ids) + 1) for w in words], 0], np.uint32))
                docs.append(doc)
                sizes.append(len(words) + 1)
                held += len(words) + 1
                if held >= most:
                    yield flush()
                    held = 0
        if docs:
            yield flush()

    return run


class Block:
    """A block's documents, tokens and words, and its n-grams."""

    def __init__(self, blob: bytes):
        docs, sizes, tokens, words = unframed(blob)
        self.docs, self.sizes, self.tokens = unplanes(docs, "<i8"), unplanes(sizes, "<i8"), unplanes(tokens, "<i4")
        self.words = words_in(words)  # the end has no letters, so its string is empty
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(len(self.tokens), dtype=np.int32) - np.repeat(self.begin.astype(np.int32), self.sizes)  # of each token in its text
        self.train = np.repeat([not held_out(d) for d in self.docs.tolist()], self.sizes) if len(self.docs) else np.zeros(0, bool)
        self.word_hash = np.array([xxhash.xxh64_intdigest(w) for w in self.words], np.uint64)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.train], minlength=len(self.words))

    def by_bucket(self, n: int):
        """The numbers of the words of each of n buckets, (bucket, numbers), in the order in which they are asked for."""
        bucket = bucket_of(self.word_hash, n)
        order = np.argsort(bucket, kind="stable")
        for k, s in groups(bucket[order]):
            yield int(k), np.array(sorted(order[s].tolist(), key=self.words.__getitem__), np.int64)

    def grams(self, order: int):
        """Of the n-grams of 2 to ``order`` tokens, for each length: the sorted hashes, for each of them a place of its last
        token, and for each token the number of the n-gram that ends there (-1: none does)."""
        own = self.word_hash[self.tokens]
        history = np.where(self.place > 0, np.r_[np.uint64(0), own[:-1]], self.word_hash[0])
        out = []
        for k in range(2, order + 1):
            here = joined(opened(history, k), own)
            at = np.flatnonzero(self.place >= k - 2).astype(np.int32)
            by = np.argsort(here[at]).astype(np.int32)
            at = at[by]
            name = here[at]
            new = np.r_[True, name[1:] != name[:-1]][: len(name)]
            number = np.full(len(here), -1, np.int32)
            number[at] = np.cumsum(new, dtype=np.int32) - 1
            out.append((name[new], at[new], number))
            history = np.r_[np.uint64(0), here[:-1]]
        return out


def opened(history: np.ndarray, k: int) -> np.ndarray:
    """Hash of a history of k - 1 tokens that awaits one more."""
    with np.errstate(over="ignore"):
        return mix(history + np.uint64(k))


def joined(history: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Hash of n-grams: NAME bits, the others are 0."""
    with np.errstate(over="ignore"):
        return mix(history + token) >> np.uint64(64 - NAME) << np.uint64(64 - NAME)


def ask_words(ids):
    """mapInArrow function over blocks: their words and training counts, by bucket."""

    def run(batches):
        for b in batches:
            for number, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                block = Block(blob.as_py())
                count = block.word_counts()
                rows = []
                for k, own in block.by_bucket(len(ids)):
                    rows.append((int(ids[k]), number, WORDS, framed(np.int64(k).tobytes(), text_of([block.words[i] for i in own.tolist()]), planes(count[own]))))
                yield keyed_rows(ASKED, rows)

    return run


def add_words(rows):
    """Of one bucket's questions the answers; the first row also has the bucket's types and tokens."""
    total: dict[bytes, int] = {}
    asked = []
    for _, block, _, blob in rows:
        head, words, count = unframed(blob)
        words, count = words_in(words), unplanes(count, "<i8")
        asked.append((block, head, words))
        for w, c in zip(words, count.tolist(), strict=True):
            total[w] = total.get(w, 0) + c
    out = [(rows[0][0], block, WORDS, framed(head, planes(np.array([total[w] for w in words], np.int64))), 0, 0) for block, head, words in asked]
    return [(*out[0][:4], sum(c > 0 for c in total.values()), sum(total.values())), *out[1:]]


def ask_grams(order, ids):
    """mapInArrow function over blocks: hashes and training counts of their n-grams of two tokens or more, by bucket."""

    def run(batches):
        for b in batches:
            for number, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                block, parts = Block(blob.as_py()), []
                for name, _, of in block.grams(order):
                    own = of[block.train]
                    parts.append((name, np.bincount(own[own >= 0], minlength=len(name)).astype(np.uint32), edges(name, len(ids))))
                rows = []
                for k in range(len(ids)):
                    own = [(name[e[k] : e[k + 1]] >> np.uint64(64 - NAME), count[e[k] : e[k + 1]]) for name, count, e in parts]
                    if any(len(name) for name, _ in own):
                        blobs = [x for name, count in own for x in (planes(np.diff(name, prepend=np.uint64(0))), planes(count))]
                        rows.append((int(ids[k]), number, GRAMS, framed(np.int64(k).tobytes(), *blobs)))
                yield keyed_rows(ASKED, rows)

    return run


def add_grams(rows):
    """Of one bucket's questions the answers: the sums of the counts, in the order asked."""
    names, counts, sizes, heads = [], [], [], []
    for _, _, _, blob in rows:
        head, *parts = unframed(blob)
        heads.append(head)
        names += [np.cumsum(unplanes(x, "<u8"), dtype=np.uint64) for x in parts[::2]]
        counts += [unplanes(x, "<u4") for x in parts[1::2]]
        sizes.append(sum(map(len, counts[-len(parts) // 2 :])))
    name, count = np.concatenate(names), np.concatenate(counts).astype(np.int64)
    by = np.argsort(name)
    new = np.r_[True, name[by][1:] != name[by][:-1]]
    total = np.empty(len(name), np.int64)
    total[by] = np.add.reduceat(count[by], np.flatnonzero(new))[np.cumsum(new) - 1]
    ends = np.cumsum(sizes).tolist()
    return [(bucket, block, GRAMS, framed(head, planes(total[e - n : e]))) for (bucket, block, _, _), head, n, e in zip(rows, heads, sizes, ends, strict=True)]


class Automaton:
    """States, arcs and failure arcs for the n-grams of a block. State 0 is the empty history, then come the histories
    of one token by word, of two by number, and so on. Arcs lie in the order of their hashes, which state and token give,
    with a table of where each leading part of the hash begins."""

    def __init__(self, block: Block, words: np.ndarray, grams: list, counts: list[np.ndarray], tokens: int, types: int, mass: float):
        """words: counts of the block's words in all training texts; grams, counts: what block.grams() gives and the counts
        of it; tokens, types: of all training texts."""
        chance = (words + 0.1) / (tokens + 0.1 * (types + 1))
        self.root, self.known, self.word_hash = np.log10(chance), words > 0, block.word_hash
        back = lambda count: np.log10(mass / (count + mass))
        keys = [np.zeros(1, np.uint64), opened(block.word_hash, 2)]
        failure, weight = [np.zeros(1 + len(words), np.int32)], [np.zeros(1), back(words)]
        names, logs, targets = [], [], []
        count, number, first = words, block.tokens, 1  # of the histories: counts, the one that ends at each token, the first's state
        for k, ((name, here, of), own) in enumerate(zip(grams, counts, strict=True)):
            shorter = number[here]
            history = np.where(block.place[here] > 0, number[here - 1], 0)  # a text begins after an end
            chance = (own + mass * chance[shorter]) / (count[history] + mass)
            met = own > 0
            names.append(name[met])
            logs.append(np.log10(chance[met]))
            after, last = first + len(count), k == len(grams) - 1
            targets.append((first + shorter[met] if last else after + np.flatnonzero(met)).astype(np.int32))
            if not last:
                failure.append(first + shorter)
                weight.append(back(own))
                keys.append(opened(name, k + 3))
                count, number, first = own, of, after
        self.keys, self.failure, self.weight = np.concatenate(keys), np.concatenate(failure), np.concatenate(weight)
        del chance
        name = np.concatenate(names)
        names.clear()
        order = np.argsort(name).astype(np.int32)
        bits = max(1, len(name).bit_length() - 1)
        self.shift = np.uint64(64 - bits)
        self.begin = np.r_[0, np.cumsum(np.bincount((name >> self.shift).astype(np.int64), minlength=1 << bits), dtype=np.int32)]
        self.names = name[order]
        del name
        for parts, held in ((logs, "logs"), (targets, "targets")):
            whole = np.concatenate(parts)
            parts.clear()
            setattr(self, held, whole[order])

    def arc(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The number of each arc, or -1."""
        name = joined(self.keys[state], self.word_hash[token])
        part = (name >> self.shift).astype(np.int64)
        at, end = self.begin[part], self.begin[part + 1]
        out = np.full(len(name), -1, np.int64)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            i = at[open_]
            hit = self.names[i] == name[open_]
            out[open_[hit]] = i[hit]
            at[open_] = i + 1
            open_ = open_[~hit & (i + 1 < end[open_])]
        return out

    def step(self, state: np.ndarray, token: np.ndarray):
        """The next state and the log-probability of each token in its state: an arc, or failure arcs until there is one."""
        after, log = np.empty(len(state), np.int64), np.zeros(len(state))
        open_ = np.arange(len(state))
        while len(open_):
            root = state == 0
            at, read = open_[root], token[root]
            log[at] += self.root[read]
            after[at] = np.where(self.known[read], 1 + read, 0)
            open_, state, token = open_[~root], state[~root], token[~root]
            arc = self.arc(state, token)
            hit = arc >= 0
            log[open_[hit]] += self.logs[arc[hit]]
            after[open_[hit]] = self.targets[arc[hit]]
            open_, state, token = open_[~hit], state[~hit], token[~hit]
            log[open_] += self.weight[state]
            state = self.failure[state]
        return after, log

    def traverse(self, block: Block, order: int, segment: int) -> np.ndarray:
        """Log-probability of each text. A segment but a text's first one starts at the empty history ``order`` - 1 tokens
        early: then its state is the longest one that ends with these tokens, as it would be on the way from the text's begin."""
        parts = -(-block.sizes // segment)
        text = np.repeat(np.arange(len(block.sizes)), parts)
        rank = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        early = np.where(rank > 0, order - 1, 0)
        begin = block.begin[text] + rank * segment - early
        size = np.minimum(block.sizes[text] - rank * segment, segment) + early
        way = np.argsort(-size, kind="stable")
        text, rank, early, begin, size = (a[way] for a in (text, rank, early, begin, size))
        state = np.where((rank == 0) & self.known[0], 1, 0)
        total = np.zeros(len(text))
        for t in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t))  # segments that have more than t tokens
            state, log = self.step(state[:n], block.tokens[begin[:n] + t])
            total[:n] += np.where(early[:n] <= t, log, 0.0)
        return np.bincount(text, total, len(block.sizes))


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(order, mass, segment, tokens, types, n_words, n_grams):
    """mapInArrow function over blocks and the answers to them, sorted by block: a RESULT row for each text.
    n_words, n_grams: numbers of the buckets for words and n-grams."""
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in RESULT.split(", ")]

    def one(rows):
        block = next(Block(blob) for _, kind, blob in rows if kind == DOCS)
        answers = lambda kind: sorted(((int(np.frombuffer(x[0], np.int64)[0]), unplanes(x[1], "<i8")) for x in (unframed(blob) for _, k, blob in rows if k == kind)), key=lambda x: x[0])
        words = np.zeros(len(block.words), np.int64)
        for (_, own), (_, count) in zip(block.by_bucket(n_words), answers(WORDS), strict=True):
            words[own] = count
        grams = block.grams(order)
        cut = [edges(name, n_grams) for name, _, _ in grams]
        parts: list[list] = [[] for _ in cut]
        for k, count in answers(GRAMS):
            for own, e in zip(parts, cut, strict=True):
                n = e[k + 1] - e[k]
                own.append(count[:n])
                count = count[n:]
        counts = [np.concatenate([np.zeros(0, np.int64), *own]) for own in parts]
        base = np.log10((words + 0.1) / (tokens + 0.1 * (types + 1)))
        automaton = Automaton(block, words, grams, counts, tokens, types, mass)
        del grams, counts, parts
        trim()
        log = automaton.traverse(block, order, segment)
        known = np.add.reduceat((words > 0)[block.tokens].astype(np.int64), block.begin)
        out = [None if d == NO_ID else d for d in block.docs.tolist()]
        held = [held_out(d) for d in block.docs.tolist()]
        columns = [out, held, block.sizes, known, np.full(len(out), tokens, np.int64), np.add.reduceat(base[block.tokens], block.begin), log]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches):
        held: list = []
        for b in batches:
            for row in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("block", "kind", "blob")), strict=True):
                if held and held[0][0] != row[0]:
                    yield one(held)
                    held = []
                held.append(row)
        if held:
            yield one(held)

    return run


def score(docs: DataFrame, order: int = ORDER, mass: float = MASS, block: int = BLOCK, bucket: int = BUCKET, segment: int = SEGMENT) -> DataFrame:
    """RESULT of each document (doc_id, text). Training texts are those whose crc32(doc_id as text) mod 10 isn't 0.
    order: tokens of the longest n-grams, at least 2; mass: of the priors. block, bucket, segment: sizes in which the work
    is done, which change no result."""
    spark = docs.sparkSession
    p = partitions(spark)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    held = hold(rows.mapInArrow(trimmed(blocks(block)), "block long, blob binary, n_words long"))
    dealt = lambda df, key: df.repartition(p, key).sortWithinPartitions(key)
    # Every text's tokens are counted by its block, so the buckets follow the number of tokens, and those of words the blocks'
    # different words.
    n_words = p * max(1, -(-WORD_COST * int(held.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]) // (bucket * p)))
    words = hold(dealt(held.mapInArrow(trimmed(ask_words(bucket_ids(p, n_words))), ASKED_SQL), "bucket").mapInArrow(trimmed(by_bucket(add_words, COUNTED)), COUNTED_SQL))
    types, tokens = words.agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    n = p * max(1, -(-(order - 1) * int(tokens) // (bucket * p)))
    grams = dealt(held.mapInArrow(trimmed(ask_grams(order, bucket_ids(p, n))), ASKED_SQL), "bucket").mapInArrow(trimmed(by_bucket(add_grams, ASKED)), ASKED_SQL)
    texts = held.select(F.lit(-1).alias("bucket"), "block", F.lit(DOCS).alias("kind"), "blob")
    all_ = texts.unionByName(words.select("bucket", "block", "kind", "blob")).unionByName(grams)
    return dealt(all_, "block").mapInArrow(trimmed(scores(order, mass, segment, int(tokens), int(types), n_words, n)), RESULT)


def op5_lm_scoring(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))
