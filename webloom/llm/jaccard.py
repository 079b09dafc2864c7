"""Exact Jaccard joins of word n-gram sets by prefix filters under several global token orders.

1. Each document's set of distinct k-word shingles is digested (128 bits and the set's size); documents of
   equal sets form a class, and one of each class goes on.
2. Order 1 is a hash of the shingles. A class of sizes cuts the order into ranges of a few shingles each; the
   shingles that a set has in one range are one compound token. Sets x and y of similarity t or more differ
   in at most H = |x| (1 - t) / t shingles, so among the first H + 1 compound tokens of the one whose prefix
   ends first at least one is the other's too, and within its prefix. Compound tokens of a few shingles are
   shared by hardly any other texts, even where a common passage is in a third of all documents. Sets are
   tied to another set with the same token, never pair by pair, and the ties' components are the first cells.
   (Tokens of one shingle, rare ones first, were tried: passages tied two thirds of the documents into one cell.)
   Sets that have too few compound tokens for the bound are tied among themselves by single shingles.
3. Order 2, another hash, ties the sets of each cell again, so that only sets that both filters tie meet.
4. Sets meet in the tasks of their cell. A pair is a candidate if it shares a token under order 1 and one under order 2:
   the filters are intersected pair by pair, and only candidates are compared, by all their shingles. A cell of more than
   BLOCK sets or BLOCK_BYTES is cut into blocks, and each pair of blocks is a task, so no task holds an unbounded cell
   and no pair is lost. Links are counted there and reduced to trees before they leave the task.
5. The trees' components give each class its component and its links.

Shingles are compared as 64-bit hashes and equal sets found by 128 bits, so that a link could only be wrong where hashes collide.
Tokens are packed by hash partition before they are exchanged, each with one set of the partition that has
it, so a token of any frequency costs a row a map task. Nothing is broadcast but ids behind a check of their
number. Nothing is capped: large cells cost more tasks.

Defined results: words are runs of anything but space and U+0009 to U+000D, A-Z folded; a document with
fewer than k words has its whole sequence as one shingle; null and empty texts and texts without words have
no shingles, link with nothing and are their own component; rows that repeat an id are one document, linked
through any of its texts (each row has the shingles and links of its own text, all have one component); null ids come out with a null component unless their class has another id; an empty table gives an
empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint, limit_batches, read, tidy, written
from .components import MOST_SENT, components, contract, roots
from .wordhash import mix, word_slices

BLOCK, BLOCK_BYTES = 2048, 8 << 20
#: Beyond so many candidates for each set of a task the shingles are counted by matrix products.
MOST_BY_PAIR = 24
MOST_BROADCAST = 2_000_000
_SALT = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707345, 0xA4093822299F31D1, 0x082EFA98EC4E6C89)]


def set_digests(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, first and second half of the digest) of each document's set."""
    size = np.bincount(doc, minlength=n_docs)
    at = np.cumsum(size) - size
    out = []
    for salt in _SALT[:2]:
        total = np.zeros(n_docs, dtype=np.uint64)
        if len(h):
            total[size > 0] = np.add.reduceat(mix(h ^ salt), at[size > 0])
        out.append(mix(total + size.astype(np.uint64)).view(np.int64))
    return size, out[0], out[1]


def prefix_length(size: np.ndarray, percent: int) -> np.ndarray:
    return np.where(size > 0, size + (-percent * size) // 100 + 1, 0)


def compound_tokens(h: np.ndarray, doc: np.ndarray, size: np.ndarray, order: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(token, set) for the prefix of each set under a global order; h by set, size of each set.

    least: shingles that make a compound token; mean: shingles a range holds on average for the least size of its
    class; ratio: greatest to least size of a class, no less than that of two similar sets. A set also takes part in the next class if a set of that
    class may be similar to it."""
    least, mean, ratio = (3, 3.5, 2.0) if percent >= 90 else (2, 1.6, 2.0**0.5) if percent >= 75 else (1, 1.0, max(2.0**0.5, 100 / max(percent, 1)))
    value = mix(h ^ _SALT[1 + order])
    by = np.lexsort((value, doc))
    value, owner = value[by], doc[by]
    n_class = np.floor(np.log(np.maximum(size, 1)) / np.log(ratio) + 1e-9).astype(np.int64)
    allowed = size * (100 - percent) // percent
    tokens, sets = [], []
    for step in (0, 1):
        class_ = n_class + step
        takes = size > 0
        if step:
            takes &= size * 100 >= percent * np.floor(ratio**class_)
        mine = takes[owner]
        v, d = value[mine], owner[mine]
        if not len(v):
            continue
        ranges = np.maximum(1, np.round(ratio ** class_.astype(float) / mean)).astype(np.uint64)
        cell = ((v >> np.uint64(32)) * ranges[d]) >> np.uint64(32)
        first = np.flatnonzero((np.diff(d, prepend=-1) != 0) | (np.diff(cell.astype(np.int64), prepend=-1) != 0))
        count = np.diff(first, append=len(v))
        whole = np.add.reduceat(mix(v ^ _SALT[0]), first)
        usable = count >= least
        at, whole, own = first[usable], whole[usable], d[first[usable]]
        have = np.bincount(own, minlength=len(size))
        place = np.arange(len(own)) - np.repeat(np.cumsum(have) - have, have)
        taken = place <= allowed[own]
        tokens.append(mix(whole[taken] + mix(cell[at[taken]] ^ mix(class_[own[taken]].astype(np.uint64)))))
        sets.append(own[taken])
        short = takes & (have <= allowed)  # too few: single shingles, among sets that are short as well
        if short.any():
            mine = short[d]
            v, d = v[mine], d[mine]
            n = np.bincount(d, minlength=len(size))
            place = np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n)
            taken = place < prefix_length(size, percent)[d]
            tokens.append(mix(v[taken] ^ mix(class_[d[taken]].astype(np.uint64) + np.uint64(1 << 32))))
            sets.append(d[taken])
    if not tokens:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(tokens), np.concatenate(sets)


def _signatures(k: int):
    @tidy
    def run(batches):
        for batch in batches:
            for a, words in word_slices(batch.column(1)):
                h, doc = words.shingle_sets(k)
                size, d1, d2 = set_digests(h, doc, words.n_docs)
                yield pa.record_batch([batch.column(0).slice(a, words.n_docs), pa.array(size), pa.array(d1), pa.array(d2)], names=["doc_id", "n", "d1", "d2"])

    return run


class _Packer:
    """Collects (token, node) and packs them by hash partition; of one token it sends one node, and links the others to it."""

    def __init__(self, parts: int, most: int = 1 << 18):
        self.parts, self.most, self.held, self.rows = parts, most, [], 0

    def add(self, token: np.ndarray, node: np.ndarray):
        self.held.append((token, node))
        self.rows += len(token)
        if self.rows >= self.most:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        token, node = (np.concatenate(x) for x in zip(*self.held)) if self.held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.held, self.rows = [], 0
        token, node, a, b = ties(token, node)
        if len(a):
            # Sets that are tied here already are sent as one: their tokens go out under the least of them.
            a, b = roots(a, b)
            at = np.minimum(np.searchsorted(a, node), len(a) - 1)
            node = np.where(a[at] == node, b[at], node)
            other = a != b
            a, b = a[other], b[other]
        part = (token >> np.uint64(40)).astype(np.int64) % self.parts
        order = np.argsort(part, kind="stable")
        both = np.stack([token[order].view(np.int64), node[order]], axis=1).astype("<i8")
        cuts = np.searchsorted(part[order], np.arange(self.parts + 1))
        parts = [p for p in range(self.parts) if cuts[p] < cuts[p + 1]]
        packs = [both[cuts[p] : cuts[p + 1]].tobytes() for p in parts]
        links = np.stack([a, b], axis=1).astype("<i8").tobytes()
        return pa.record_batch([pa.array([*parts, -1], pa.int32()), pa.array([*packs, links], pa.binary())], names=["part", "pack"])


def ties(token: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, least node) for each token, and links (a, b) from its other nodes to that one."""
    order = np.lexsort((node, token))
    token, node = token[order], node[order]
    first = np.ones(len(token), dtype=bool)
    first[1:] = token[1:] != token[:-1]
    hub = node[np.maximum.accumulate(np.where(first, np.arange(len(token)), 0))] if len(token) else node
    other = node != hub
    a, b = np.unique(np.stack([node[other], hub[other]], axis=1), axis=0).T if other.any() else (node[:0], node[:0])
    return token[first], node[first], a, b


def _prefix_ties(k: int, percent: int, parts: int, most_seen: int = 100_000):
    """Packed (token, node) under order 1; the node is half of the set's digest. Copies that a partition has
    already seen add nothing."""

    @tidy
    def run(batches):
        seen: set[int] = set()
        packer = _Packer(parts)
        for batch in batches:
            for _, words in word_slices(batch.column(0)):
                h, doc = words.shingle_sets(k)
                size, node, _ = set_digests(h, doc, words.n_docs)
                fresh = np.zeros(words.n_docs, dtype=bool)
                for d, x in enumerate(node.tolist()):
                    fresh[d] = x not in seen
                    seen.add(x)
                if len(seen) > most_seen:
                    seen.clear()
                own = fresh[doc]
                token, at = compound_tokens(h[own], doc[own], np.where(fresh, size, 0), 1, percent)
                yield from packer.add(token, node[at])
        yield packer.flush()

    return run


def _cell_sets(k: int):
    @tidy
    def run(batches):
        names = ["cell", "rep", "weight", "d1", "d2", "n", "tokens"]
        for batch in batches:
            for a, words in word_slices(batch.column(0)):
                h, doc = words.shingle_sets(k)
                size, d1, d2 = set_digests(h, doc, words.n_docs)
                ends = np.searchsorted(doc, np.arange(words.n_docs + 1))
                raw = h.astype("<u8").tobytes()
                sets = [raw[8 * x : 8 * y] for x, y in zip(ends.tolist(), ends[1:].tolist())]
                rest = [batch.column(c).slice(a, words.n_docs) for c in range(1, 7)]
                out = pa.record_batch([*rest, pa.array(sets, pa.binary())], names=names)
                # Another text may bear the same id.
                yield out.filter(pa.array((rest[3].to_numpy() == d1) & (rest[4].to_numpy() == d2) & (rest[5].to_numpy() == size)))

    return run


def _cell_ties(percent: int, parts: int):
    """Packed (token, node) under order 2; a token counts within its cell only."""

    @tidy
    def run(batches):
        packer = _Packer(parts)
        for batch in batches:
            cells, reps, raws = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for a in range(0, len(raws), 256):
                sets = [np.frombuffer(r, "<u8") for r in raws[a : a + 256]]
                size = np.array([len(s) for s in sets])
                token, at = compound_tokens(np.concatenate(sets), np.repeat(np.arange(len(sets)), size), size, 2, percent)
                own = at + a
                yield from packer.add(mix(token ^ mix(cells[own].view(np.uint64))), reps[own])
        yield packer.flush()

    return run


@tidy
def _stars(batches):
    """The links of a partition as stars: one worker a task does both steps."""
    yield from contract(_links(batches))


def _links(batches):
    """Packs of a partition -> links; a pack of part -1 holds links already."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for part, pack in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if part < 0:
                both = np.frombuffer(pack, "<i8").reshape(-1, 2)
                yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])
            else:
                held.setdefault(part, []).append(pack)
    for part in list(held):
        both = np.frombuffer(b"".join(held.pop(part)), "<i8").reshape(-1, 2)
        _, _, a, b = ties(both[:, 0].view(np.uint64), both[:, 1])
        yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])


def _tied(packs: DataFrame, parts: int) -> DataFrame:
    """Components of the links between sets that share a token. Links made on the map side stay there."""
    salt = F.when(F.col("part") < 0, F.pmod(F.xxhash64("pack"), F.lit(parts))).otherwise(F.col("part")).cast("int")
    stars = packs.withColumn("to", salt).repartition(parts, "to").select("part", "pack").mapInArrow(_stars, "a bigint, b bigint")
    return components(stars, contracted=True)


def share_tokens(h: np.ndarray, doc: np.ndarray, size: np.ndarray, order: int, percent: int) -> np.ndarray:
    """Which pairs of sets share a token of their prefixes under an order."""
    token, owner = compound_tokens(h, doc, size, order, percent)
    by = np.argsort(token, kind="stable")
    token, owner = token[by], owner[by]
    edges = np.flatnonzero(np.diff(token, prepend=token[:1] ^ np.uint64(1))) if len(token) else np.zeros(0, dtype=np.int64)
    many = np.diff(edges, append=len(token))
    out = np.zeros((len(size), len(size)), dtype=bool)
    pairs = edges[many == 2]
    out[owner[pairs], owner[pairs + 1]] = out[owner[pairs + 1], owner[pairs]] = True
    for a, n in zip(edges[many > 2].tolist(), many[many > 2].tolist()):
        own = owner[a : a + n]
        out[own[:, None], own] = True
    return out


def shared_counts(h: np.ndarray, doc: np.ndarray, m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many shingles the sets i[n] and j[n] share; h ascends within each set."""
    if len(i) <= MOST_BY_PAIR * m:
        ends = np.searchsorted(doc, np.arange(m + 1))
        cut = lambda n: h[ends[n] : ends[n + 1]]
        return np.array([len(np.intersect1d(cut(a), cut(b), assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())], dtype=np.int64)
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    token = np.cumsum(new) - 1
    several = np.bincount(token) > 1
    keep = several[token]
    token, doc = (np.cumsum(several) - 1)[token[keep]], doc[keep]
    shared, width = np.zeros((m, m), dtype=np.float32), max(256, (1 << 23) // m)
    for a in range(0, int(several.sum()), width):
        x, y = np.searchsorted(token, [a, a + width])
        block = np.zeros((m, width), dtype=np.float32)
        block[doc[x:y], token[x:y] - a] = 1
        shared += block @ block.T
    return shared[i, j].astype(np.int64)


def similar_pairs(sets: list[np.ndarray], percent: int, left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of the sets with 100 * shared >= percent * union; left: pairs must differ in it."""
    m, size = len(sets), np.array([len(s) for s in sets], dtype=np.int64)
    h, doc = np.concatenate(sets), np.repeat(np.arange(m), size)
    both = np.triu(share_tokens(h, doc, size, 1, percent) & share_tokens(h, doc, size, 2, percent), 1)
    i, j = np.nonzero(both)
    near = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
    if left is not None:
        near &= left[i] != left[j]
    i, j = i[near], j[near]
    shared = shared_counts(h, doc, m, i, j)
    ok = 100 * shared >= percent * (size[i] + size[j] - shared)
    return i[ok], j[ok]


def _verify(percent: int):
    """Rows sorted by task: (task, own block or -1 if the task is of one block, rep, weight, tokens). Gives trees (a, b, null) and link counts (a, null, links)."""

    def group(task, rows):
        left = None if rows[0][0] < 0 else np.array([r[0] for r in rows])
        i, j = similar_pairs([np.frombuffer(r[3], "<u8") for r in rows], percent, left)
        other = np.array([r[1] for r in rows])
        i, j = i[other[i] != other[j]], j[other[i] != other[j]]  # texts of one id are tied anyway
        rep, weight = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        node, root = roots(rep[i], rep[j]) if len(i) else (rep[:0], rep[:0])
        links = np.bincount(i, weights=weight[j], minlength=len(rows)) + np.bincount(j, weights=weight[i], minlength=len(rows))
        has = links > 0
        return [*zip(node.tolist(), root.tolist(), [None] * len(node))] + [*zip(rep[has].tolist(), [None] * int(has.sum()), links[has].astype(int).tolist())]

    @tidy
    def run(batches):
        task, rows, out = None, [], []
        for batch in batches:
            for t, b, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if t != task:
                    if len(rows) > 1:
                        out += group(task, rows)
                    task, rows = t, []
                if not rows or rows[-1] != (b, *row):  # else the same row once more
                    rows.append((b, *row))
            if len(out) > 10_000:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b", "links"])
                out = []
        if len(rows) > 1:
            out += group(task, rows)
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b", "links"])

    return run


def jaccard_components(df: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """A row for each row of df: doc_id, n_shingles, component_id, n_links (other rows linked to it)."""
    limit_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = written(docs.mapInArrow(_signatures(k), "doc_id bigint, n bigint, d1 bigint, d2 bigint"), "signatures")
    # A tied set is linked once a part that holds tokens of it: few, large parts make fewer links.
    parts = max(16, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 3)

    classes = own.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    # Counted by what all hold: tables of ids are joined by sorting beyond the limit of broadcasts, not by the size of their compressed files.
    sent = (lambda df: df.hint("merge")) if own.count() > MOST_SENT else (lambda df: df)
    cells = _tied(docs.select("text").mapInArrow(_prefix_ties(k, percent, parts), "part int, pack binary"), parts)
    members = classes.where("rep IS NOT NULL").join(sent(cells.select(F.col("node").alias("d1"), F.col("root").alias("cell"))), "d1")
    members = checkpoint(members.select("cell", "rep", "weight", "d1", "d2", "n"))
    wanted = broadcast_if_small(members, members.count(), MOST_BROADCAST)
    texts = docs.join(wanted, F.col("doc_id") == F.col("rep")).select("text", "cell", "rep", "weight", "d1", "d2", "n")
    sets = written(texts.mapInArrow(_cell_sets(k), "cell bigint, rep bigint, weight bigint, d1 bigint, d2 bigint, n bigint, tokens binary"), "cells")

    second = checkpoint(_tied(sets.select("cell", "rep", "tokens").mapInArrow(_cell_ties(percent, parts), "part int, pack binary"), parts))
    # Blocks are cut by number and by bytes, so a task holds two of BLOCK_BYTES, or two sets.
    weighed = second.join(sent(members.groupBy(F.col("rep").alias("node")).agg((8 * F.sum("n")).alias("bytes"))), "node")
    crowd = weighed.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    placed = second.join(sent(crowd), "root").select(F.col("node").alias("rep"), "root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"))
    tasks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = placed.select("*", tasks.alias("other"))
    placed = placed.select("rep", F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("own"), F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("task"))
    parts = sets.select("rep", "weight", "tokens").join(placed, "rep").select("task", "own", "rep", "weight", "tokens")
    found = written(parts.repartition("task").sortWithinPartitions("task", "rep").mapInArrow(_verify(percent), "a bigint, b bigint, links bigint"), "links")

    edges = found.where("b IS NOT NULL").select("a", "b")
    several = written(own.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("d1", "d2", "n")).alias("lo"), F.max(F.struct("d1", "d2", "n")).alias("hi")).where("lo <> hi").select("doc_id"), "repeated")
    repeated = several.count()
    several = broadcast_if_small(several, repeated, MOST_BROADCAST)
    if repeated:  # an id with different texts ties their classes
        held = own.join(several, "doc_id").join(classes, ["d1", "d2", "n"]).select("doc_id", "rep").distinct()
        edges = edges.union(held.join(held.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").select("rep", "b"))
    trees = components(edges)
    links = found.where("links IS NOT NULL").groupBy("a").agg(F.sum("links").alias("links"))
    grouped = classes.join(sent(trees.select(F.col("node").alias("rep"), "root")), "rep", "left").join(sent(links.select(F.col("a").alias("rep"), "links")), "rep", "left")
    grouped = grouped.where("root IS NOT NULL OR weight > 1").select("d1", "d2", "n", F.coalesce("root", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = own.join(grouped, ["d1", "d2", "n"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    if repeated:  # its rows without words too
        of_id = out.join(several, "doc_id").groupBy("doc_id").agg(F.min("component_id").alias("of_id"))
        out = out.join(of_id, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("of_id", "component_id").alias("component_id"), "n_links")
    return out


def op3_multi_order_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"), 3, 90)


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
t AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, any_value(n.n) AS n_shingles, min(r.b) AS component_id, (SELECT count(*) FROM l WHERE l.a = n.doc_id) AS n_links
FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id
"""
