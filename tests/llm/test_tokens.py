"""Encoding, token files and packing against the tokenizers library and exact round trips."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from webloom.llm import packing, tokenfile
from webloom.llm.tokens import END_ID, Encoder, vocabulary_path
from webloom.llm.wordhash import word_slices


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


OWN = Encoder()


def encoded(texts, end=None):
    out = []
    for _, words in word_slices(pa.array(texts, pa.string()), fold=False):
        ids, ends = OWN.encode(words, end)
        out += [x.tolist() for x in np.split(ids, ends[:-1])]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab Zé.,!'\n\t 　日1<|>_-", max_size=40), min_size=1, max_size=5))
def test_ids_are_the_library_s(texts):
    full = Tokenizer.from_file(vocabulary_path()) if not hasattr(test_ids_are_the_library_s, "t") else test_ids_are_the_library_s.t
    test_ids_are_the_library_s.t = full
    assert encoded(texts) == [full.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_of_awkward_texts(library, awkward):
    texts = [r[1] for r in awkward]
    assert encoded(texts, END_ID) == [library.encode(t or "", add_special_tokens=False).ids + [END_ID] for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1200))
def test_random_access(ids):
    ids = np.array(ids, dtype="<u4")
    block = tokenfile.Block(tokenfile.encode_block(ids, np.array([len(ids)])))
    assert (block.ids() == ids).all()
    assert all(block.token(i) == ids[i] for i in range(0, len(ids), 7))
    with pytest.raises(IndexError):
        block.token(len(ids))


def test_token_file(spark, docs, none, awkward, library):
    got = sorted(tuple(r) for r in tokenfile.read_tokens(tokenfile.write_tokens(docs, block_tokens=1000)).collect())
    want, start = [], 0
    for doc_id, text in sorted((r[0], r[1]) for r in awkward):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [END_ID], dtype="<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert tokenfile.read_tokens(tokenfile.write_tokens(none)).isEmpty()


def test_tokens_by_place(spark, docs, awkward, library):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several blocks
    try:
        files = tokenfile.write_tokens(docs, block_tokens=1000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ids = [x for _, text in sorted((r[0], r[1]) for r in awkward) for x in library.encode(text or "", add_special_tokens=False).ids + [END_ID]]
    places = [*range(0, len(ids), 997), len(ids) - 1, len(ids), -1, 5, 5]
    got = tokenfile.token_at(files, spark.createDataFrame([(p,) for p in places], "place long")).collect()
    assert sorted((r["place"], r["token"]) for r in got if r["token"] is not None) == sorted((p, ids[p]) for p in places if 0 <= p < len(ids))
    assert len(got) == len(places) and files.count() > 1


def test_packing(docs, none, awkward, library):
    rows = packing.pack_documents(docs).toPandas()
    for doc_id, text in {(r[0], r[1]) for r in awkward}:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [END_ID], dtype="<u4")
        own = rows[rows.doc_id == doc_id].sort_values(["start", "sequence_id"]).drop_duplicates("start")
        assert own.length.sum() == len(ids) and (own.length[1:] == 1024).all() and own.length.max() <= 1024
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length)] == own.ids_crc32.tolist()
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist() and s.length.sum() <= 1024
    assert len(rows) == len(rows.drop_duplicates(["sequence_id", "offset"]))
    assert packing.pack_documents(none).isEmpty()


def best(lengths, capacity):
    """The fewest bins, by trying every way."""
    lengths, least = sorted(lengths, reverse=True), [len(lengths)]

    def place(k, bins):
        if len(bins) >= least[0]:
            return
        if k == len(lengths):
            least[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[k] <= capacity and bins[b] not in bins[:b]:
                place(k + 1, bins[:b] + [bins[b] + lengths[k]] + bins[b + 1 :])
        place(k + 1, bins + [lengths[k]])

    place(0, [])
    return least[0]


@pytest.mark.parametrize("seed", range(25))
def test_bin_completion_is_best_on_small_sets(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 30) for _ in range(rng.randint(1, 11))]
    histogram = {s: lengths.count(s) for s in lengths}
    plan = packing.complete_bins(histogram, 30)
    used = [s for bin_, times in plan for s in list(bin_) * times]
    assert sorted(used) == sorted(lengths) and all(sum(b) <= 30 for b, _ in plan)
    assert sum(t for _, t in plan) <= best(lengths, 30)


def test_bin_completion_on_many():
    rng = random.Random(1)
    histogram = {s: rng.randint(1, 300) for s in range(1, 1024)}
    plan = packing.complete_bins(histogram)
    assert sum(t for _, t in plan) <= 1.001 * packing.lower_bound([histogram.get(s, 0) for s in range(1025)], 1024)
    assert packing.complete_bins({}) == []


def used_lengths(plan, capacity):
    assert all(sum(b) <= capacity for b, _ in plan)
    return collections.Counter({s: n for s, n in sum((collections.Counter({s: t * b.count(s) for s in b}) for b, t in plan), collections.Counter()).items()})


@pytest.mark.parametrize("pieces,bins", [(3, 15), (4, 40), (5, 40)])
def test_search_beats_best_fit(pieces, bins):
    """Planted perfect packings that best fit misses."""
    rng, missed = random.Random(pieces), 0
    while missed < 4:
        histogram = collections.Counter()
        for _ in range(bins):
            cuts = sorted(rng.sample(range(1, 1024), pieces - 1))
            histogram.update(b - a for a, b in zip([0, *cuts], [*cuts, 1024]))
        if sum(t for _, t in packing.best_fit([histogram[s] for s in range(1025)], 1024)) > bins:
            missed += 1
            plan = packing.complete_bins(histogram)
            assert sum(t for _, t in plan) == bins and used_lengths(plan, 1024) == histogram


@pytest.mark.parametrize("seed", range(10))
def test_fillings_are_the_undominated_ones(seed):
    """Against all multisets of the lengths; each that is left out gives way to one that wastes no more."""
    rng = random.Random(seed)
    counts = [0] + [rng.choice((0, 0, 1, 2)) for _ in range(14)]
    room = rng.randrange(5, 14)
    got = list(packing.fillings(counts, room, room))

    def every(k, left):
        if k == 0:
            yield ()
            return
        for n in range(min(counts[k], left // k) + 1):
            for rest in every(k - 1, left - n * k):
                yield (k,) * n + rest

    all_ = set(every(14, room))
    assert set(got) <= all_ and len(got) == len(set(got)) and max(map(sum, all_)) == max(map(sum, got), default=0)
    for f in all_ - set(got):
        assert packing.dominated(counts, f, room - sum(f))


def test_full_pieces_and_groups(spark):
    rows = [(i, 0, 0, (1024, 600, 424, 300, 124)[i % 5], i) for i in range(500)]
    pieces = spark.createDataFrame(rows, packing.PIECES)
    got = packing.pack(pieces, group_rows=7).toPandas()
    assert len(got) == 500 and got.groupby("sequence_id").length.sum().max() <= 1024 and got.sequence_id.nunique() == 100 + 100 + 100 * 424 // 1024 + 1
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist()
