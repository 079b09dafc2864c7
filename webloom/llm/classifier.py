"""A quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text are word n-grams, hashed into 2**BITS places: its words and word pairs (case matters), and the same over
the words' classes (how many marks a word carries, whether it is in capitals, its last byte; of pairs only whether
both words are one), so that junk shows that was never seen. Each text's vector is scaled to length one. Training is
FTRL-proximal (per-coordinate rates, L1 and L2), one pass after the other
over a sample of labelled texts that is bounded by a documented parameter (MOST_LABELLED, the rows with the
least hash of their id), in a fixed order. Its rates were picked by compare_rates() on a part of the learning rows of the
0.1 GB check table, never on held-out rows. The weights (2**BITS numbers) are the only thing that goes to the
executors; a score is one sparse dot product, computed for whole batches by array operations.

Only the text is ever a feature. Defined results: null and empty texts have no features and score by the
intercept alone; rows that repeat an id are scored alike by their texts; without labelled rows every score is
0.5; an empty table gives an empty result. In score() extra columns pass through, but for one of the output's name (in any
case), which is replaced; the query's columns are its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, limit_batches, read, release, tidy
from .wordhash import Words, mix, word_slices

BITS, MOST_LABELLED, EPOCHS = 18, 8_000, 5
ALPHA, BETA, L1, L2 = 4.0, 1.0, 0.001, 0.0005
ACCEPT = 0.7
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def features(words: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, value, document), ascending by document: counts damped and scaled to length one."""
    n = len(words.hash)
    letters = np.zeros(len(words.data) + 1, dtype=np.int64)
    np.cumsum(_LETTER[words.data], out=letters[1:])
    upper = np.zeros(len(words.data) + 1, dtype=np.int64)
    np.cumsum(_UPPER[words.data], out=upper[1:])
    size, plain, caps = words.end - words.start, letters[words.end] - letters[words.start], upper[words.end] - upper[words.start]
    # The word's shape: how many marks it carries, whether all its letters are capitals, which byte ends it.
    shape = np.minimum(size - plain, 4) * 4 + (caps > 1) * 2 + (plain == 0)
    shape = mix((shape * 256 + words.data[words.end - 1] if n else shape).astype(np.uint64) + np.uint64(1 << 40))
    pair, at = words.grams(2)
    same = np.flatnonzero((words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1]))  # a word said twice
    again = np.full(len(same), mix(np.array([1 << 41], dtype=np.uint64))[0], dtype=np.uint64)
    h = np.concatenate([words.hash, shape, pair, again])
    doc = np.concatenate([words.doc, words.doc, words.doc[at], words.doc[same]])
    place = (h >> np.uint64(64 - bits)).astype(np.int64)
    key, count = np.unique((doc << bits) | place, return_counts=True)
    doc, place, value = key >> bits, key & ((1 << bits) - 1), np.log1p(count)
    norm = np.sqrt(np.bincount(doc, weights=value * value, minlength=words.n_docs))
    return place, value / norm[doc], doc


class Ftrl:
    """FTRL-proximal for sparse logistic regression; the last place is the intercept."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, place: np.ndarray, value: np.ndarray, label: int) -> None:
        at, x = np.append(place, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(at)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _sparse(bits: int):
    @tidy
    def run(batches):
        for batch in batches:
            for a, words in word_slices(batch.column(2), fold=False):
                place, value, doc = features(words, bits)
                ends = np.searchsorted(doc, np.arange(words.n_docs + 1))
                p, v = place.astype("<i4").tobytes(), value.astype("<f4").tobytes()
                cut = lambda raw: [raw[4 * x : 4 * y] for x, y in zip(ends.tolist(), ends[1:].tolist())]
                yield pa.record_batch([batch.column(0).slice(a, words.n_docs), batch.column(1).slice(a, words.n_docs), pa.array(cut(p), pa.binary()), pa.array(cut(v), pa.binary())], names=["rank", "label", "places", "values"])

    return run


def _rank(doc_id: Column) -> Column:
    return F.xxhash64(F.lit("train"), doc_id)


def bounded(df: DataFrame, rank: str, most: int) -> DataFrame:
    """At most `most` rows: those of the least hashes. A cut by the count leaves few to be sorted."""
    n = df.count()
    if n <= most:
        return df
    cut = min(1.0, 1.1 * most / n + 1e-6)
    return df.where(F.shiftrightunsigned(rank, 1).cast("double") < cut * float(1 << 63)).orderBy(rank).limit(most)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", most: int = MOST_LABELLED, bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights from at most `most` labelled rows; as many numbers as hashed places, and the intercept."""
    limit_batches(labelled.sparkSession)
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).withColumn("_rank", _rank(F.col(id_col)))
    rows = rows.select(F.col("_rank").alias("rank"), F.col(label_col).cast("int").alias("label"), F.col(text_col).alias("text"))
    sample = bounded(rows, "rank", most).mapInArrow(_sparse(bits), "rank bigint, label int, places binary, `values` binary").toArrow().sort_by([("rank", "ascending"), ("places", "ascending")])
    if not sample.num_rows:
        return np.zeros((1 << bits) + 1)
    weights = fitted(sparse_rows(sample), bits, epochs).weights()
    del sample
    release()  # the driver runs on after the training
    return weights


def sparse_rows(sample: pa.Table) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(places, values, label) of each row."""
    columns = (sample.column(c).to_pylist() for c in ("places", "values", "label"))
    return [(np.frombuffer(p, "<i4"), np.frombuffer(v, "<f4"), int(y)) for p, v, y in zip(*columns)]


def fitted(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int, epochs: int, **rates: float) -> Ftrl:
    model = Ftrl(bits, **rates)
    for _ in range(epochs):
        for row in rows:
            model.learn(*row)
    return model


def compare_rates(spark, sf_dir: str, settings: list[dict], bits: int = BITS, epochs: int = EPOCHS) -> list[tuple[float, dict]]:
    """(mean log loss, setting), best first, on the fourth of the learning rows that the other three do not learn from."""
    sample = labelled_sample(spark, sf_dir, MOST_LABELLED)
    rows = sparse_rows(sample.where("text IS NOT NULL").select(_rank(F.col("doc_id")).alias("rank"), F.col("label").cast("int"), "text").mapInArrow(_sparse(bits), "rank bigint, label int, places binary, `values` binary").orderBy("rank").toArrow())
    out = []
    for setting in settings:
        w = fitted([r for n, r in enumerate(rows) if n % 4], bits, epochs, **setting).weights()
        p = np.array([1 / (1 + np.exp(-np.clip(w[places] @ values + w[-1], -35, 35))) for places, values, _ in rows[::4]])
        y = np.array([label for _, _, label in rows[::4]])
        out.append((float(-np.mean(np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-12, 1)))), setting))
    return sorted(out, key=lambda x: x[0])


def score(df: DataFrame, weights: np.ndarray, text_col: str = "text", out: str = "score") -> DataFrame:
    """df with the probability of label 1."""
    limit_batches(df.sparkSession)
    bits = (len(weights) - 1).bit_length() - 1
    weights = weights.astype(np.float32)
    names = [c for c in df.columns if c.lower() != out.lower()]
    k = names.index(text_col)

    @tidy
    def run(batches):
        for batch in batches:
            logits = []
            for _, words in word_slices(batch.column(k), fold=False):
                place, value, doc = features(words, bits)
                logits.append(np.bincount(doc, weights=weights[place] * value, minlength=words.n_docs))
            p = 1.0 / (1.0 + np.exp(-np.clip(np.concatenate(logits or [np.zeros(0)]) + weights[-1], -35, 35)))
            yield pa.record_batch([*batch.columns, pa.array(p, pa.float64())], names=[*names, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[df[c] for c in names]).schema.fields)
    return df.select(*[df[c] for c in names]).mapInArrow(run, f"{kinds}, `{out}` double")


def labelled_sample(spark, sf_dir: str, most: int, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, label) of at most `most` labelled rows that are not held out."""
    labels = read(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    # Only the sample's labels meet the texts.
    sample = bounded(labels.where("label IS NOT NULL").withColumn("_rank", _rank(F.col("doc_id"))), "_rank", most).drop("_rank")
    docs = read(spark, sf_dir, "documents") if docs is None else docs
    return docs.select("doc_id", "text").join(F.broadcast(checkpoint(sample)), "doc_id")


def quality_weights(spark, sf_dir: str, docs: DataFrame | None = None, most: int = MOST_LABELLED) -> np.ndarray:
    """Learns labels.quality from rows that are not held out, with the texts of documents."""
    return train(labelled_sample(spark, sf_dir, most, docs), most=most)


def op10_ftrl_quality(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, quality_weights(spark, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
