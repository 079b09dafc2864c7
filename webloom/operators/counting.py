"""Words and runs of words counted within their documents.

A document's words are in one row, so its counts need no exchange: a map over Arrow batches numbers the batch's words and counts
(document, number) by sorting. Exploding first and aggregating afterwards held a row for each word in hash tables that outgrow a task's memory on
large inputs, and made the optimiser evaluate the words once more for each filter that it infers below an explode."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows with repeated ids are sent to each task up to so many.
MOST_SENT = 100_000


def one_row_an_id(df: DataFrame, id_col: str, words: Column) -> DataFrame:
    """(id, words): rows that repeat an id (nulls are one id) are one row, with a null word after each so that no run of words spans two. Only the ids are exchanged where none is repeated."""
    rows = df.select(F.col(id_col), words.alias("words"))
    again = df.groupBy(F.col(id_col).alias("cn_id")).agg(F.count(F.lit(1)).alias("cn_n")).where("cn_n > 1").select("cn_id")
    n = again.count()
    if not n:
        return rows
    again = F.broadcast(again) if n <= MOST_SENT else again
    same = F.col(id_col).eqNullSafe(F.col("cn_id"))
    parted = F.concat(F.coalesce("words", F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))
    merged = rows.join(again, same, "left_semi").groupBy(id_col).agg(F.flatten(F.collect_list(parted)).alias("words"))
    return rows.join(again, same, "left_anti").unionByName(merged)


def _numbered(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(document, number of the word or -1 for null) of each word in order, and the words by number."""
    coded = pc.list_flatten(lists).dictionary_encode()
    return pc.list_parent_indices(lists).to_numpy().astype(np.int64), pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _runs(doc: np.ndarray, code: np.ndarray, size: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first place, class) of each run of `size` words of one document without nulls; equal runs are of one class."""
    at = np.arange(max(len(code) - size + 1, 0))
    ok = (doc[at] == doc[at + size - 1]) if len(at) else np.zeros(0, dtype=bool)
    for k in range(size):
        ok &= code[at + k] >= 0
    at = at[ok]
    kind = code[at]
    for k in range(1, size):  # numbered anew, so that products stay small
        _, kind = np.unique(kind * n_words + code[at + k], return_inverse=True)
    return at, kind


def _best(doc: np.ndarray, n: np.ndarray, ranks: list[np.ndarray], top: int) -> np.ndarray:
    """Which runs are among the `top` of their document by count and then by their words in byte order: a space is less than any letter, so this is the order of the joined strings too."""
    order = np.lexsort((*reversed(ranks), -n, doc))
    own = doc[order]
    place = np.arange(len(own)) - np.searchsorted(own, own)
    return order[place < top]


def counted(df: DataFrame, id_col: str, words: Column, sizes: tuple[int, ...] = (1,), least: int = 1, out: str = "frequency", parts: bool = False, top: int | None = None) -> DataFrame:
    """(id, term, count): how often each run of as many words as one of `sizes` stands in a document, if `least` times or more; the `top` most frequent, ties by the term, if given.
    parts: of runs of two also n_a and n_b, how often its words stand there, and vocabulary, the document's distinct words."""
    rows = one_row_an_id(df, id_col, words)
    names = [id_col, "term", out, *(("n_a", "n_b", "vocabulary") if parts else ())]

    def run(batches):
        for batch in batches:
            doc, code, text = _numbered(batch.column(1))
            if not len(text):
                continue
            if parts:
                single, often = np.unique(doc[code >= 0] * len(text) + code[code >= 0], return_counts=True)
                vocabulary = np.bincount(single // len(text), minlength=batch.num_rows)
                n_of = lambda at: often[np.searchsorted(single, doc[at] * len(text) + code[at])]
            found = []
            for size in sizes:
                at, kind = _runs(doc, code, size, len(text))
                _, first, n = np.unique(doc[at] * (int(kind.max(initial=0)) + 1) + kind, return_index=True, return_counts=True)
                at, n = at[first[n >= least]], n[n >= least]
                found.append((at, n, np.full(len(at), size)))
            at, n, size = (np.concatenate(x) for x in zip(*found))
            if top is not None:
                rank = np.empty(len(text), dtype=np.int64)
                rank[pc.array_sort_indices(text).to_numpy()] = np.arange(1, len(text) + 1)
                of = lambda k: np.where(size > k, rank[code[np.minimum(at + k, len(code) - 1)]], 0)
                best = _best(doc[at], n, [of(k) for k in range(max(sizes))], top)
                at, n, size = at[best], n[best], size[best]
            for one in sizes:
                own, often_own = at[size == one], n[size == one]
                each = [text.take(pa.array(code[own + k])) for k in range(one)]
                term = pc.binary_join_element_wise(*each, " ") if one > 1 else each[0]
                more = [pa.array(n_of(own)), pa.array(n_of(own + 1)), pa.array(vocabulary[doc[own]])] if parts else []
                yield pa.record_batch([batch.column(0).take(pa.array(doc[own])), term, pa.array(often_own), *more], names=names)

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join([f"`{id_col}` {kind}", "term string", *(f"`{c}` bigint" for c in names[2:])]))


def counted_lists(df: DataFrame, id_col: str, words: Column) -> DataFrame:
    """(id, terms, tf): each document's words and how often they stand in it, in one row; none for documents without words."""
    rows = one_row_an_id(df, id_col, words)

    def run(batches):
        for batch in batches:
            doc, code, text = _numbered(batch.column(1))
            single, n = np.unique(doc[code >= 0] * max(len(text), 1) + code[code >= 0], return_counts=True)
            ends = np.searchsorted(single, np.arange(batch.num_rows + 1) * max(len(text), 1))
            offsets = pa.array(ends, pa.int32())
            terms = pa.ListArray.from_arrays(offsets, text.take(pa.array(single % max(len(text), 1))))
            out = pa.record_batch([batch.column(0), terms, pa.ListArray.from_arrays(offsets, pa.array(n, pa.int32()))], names=[id_col, "terms", "tf"])
            yield out.filter(pa.array(np.diff(ends) > 0))

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, terms array<string>, tf array<int>")


def joined_runs(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, term, frequency) from (id, words, phrases): how often each phrase of two words stands when words are joined from the left and none is in two phrases."""

    def run(batches):
        for batch in batches:
            ids, terms, counts = [], [], []
            for n, (words, phrases) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                found, at, wanted = {}, 0, set(map(tuple, (p.split(" ") for p in phrases)))
                while at < len(words) - 1:
                    pair = (words[at], words[at + 1])
                    if pair in wanted:
                        found[pair] = found.get(pair, 0) + 1
                        at += 1
                    at += 1
                ids += [n] * len(found)
                terms += [" ".join(p) for p in found]
                counts += found.values()
            yield pa.record_batch([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(terms, pa.string()), pa.array(counts, pa.int64())], names=[id_col, "term", "frequency"])

    return rows.select(id_col, "words", "phrases").mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, term string, frequency bigint")
