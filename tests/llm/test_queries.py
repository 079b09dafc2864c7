"""The queries of operators 2, 7 and 8 as they are registered, row by row against plain code."""

import zlib
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

from webloom.llm import queries
from webloom.llm.tokens import vocabulary_path

from .conftest import SCHEMA

LIBRARY = Tokenizer.from_file(vocabulary_path())


def plain_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def folder(spark, awkward, prose, tmp_path_factory):
    """Unique ids: the contract's results are by document."""
    passage = prose(80, 71)
    rows = list({r[0]: r for r in awkward}.values())
    rows += [(100 + i, f"{prose(30 + i, 80 + i)} {passage} {prose(20, 90 + i)}", "en", "s1", 1) for i in range(4)]
    path = str(tmp_path_factory.mktemp("documents"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path, rows


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def test_op2_query(spark, folder):
    path, rows = folder
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.QUERIES["op2_directly_addressable"](spark, path).collect()}
    at, want = 0, {}
    for doc, text, *_ in sorted(rows, key=lambda r: r[0]):
        ids = [*plain_ids(text or ""), 2]
        want[doc] = at, len(ids), crc(ids)
        at += len(ids)
    assert got == want


def test_op8_query(spark, folder):
    path, rows = folder
    got = queries.QUERIES["op8_bin_completion"](spark, path).collect()
    texts, pieces, sequences = {r[0]: r[1] or "" for r in rows}, defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, text in texts.items():
        ids = [*plain_ids(text), 2]
        assert [p[0] for p in sorted(pieces[doc])] == list(range(len(pieces[doc]))) and (len(ids) > 1024 or len(pieces[doc]) == 1)
        at = 0
        for n, (_, start, length, digest) in enumerate(sorted(pieces[doc])):
            assert start == at and digest == crc(ids[at : at + length]) and (length == 1024 or n == 0 or len(ids) <= 1024)
            at += length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_op7_query(spark, folder):
    path, rows = folder
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    got = queries.QUERIES["op7_collinear_chaining"](spark, path).collect()
    assert {r["doc_id"] for r in got} >= {101, 102, 103} and all(r["partner_id"] < r["doc_id"] for r in got)
    for r in got:
        if r["identity"] == 1:
            own, other = texts[r["doc_id"]][r["start"] : r["end"]], texts[r["partner_id"]][r["partner_start"] : r["partner_end"]]
            assert own.lower().split() == other.lower().split()
    assert {8, 12} <= {r["doc_id"] for r in got}  # copies of document 7, one in capitals
