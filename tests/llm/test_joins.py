"""The Jaccard join and the passages against brute force."""

import random
import re

import numpy as np
import pytest

from webloom.llm import jaccard, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = dict.fromkeys(range(len(rows)), 0)
    for a, (i, x) in enumerate(sets):
        for b, (j, y) in enumerate(sets[:a]):
            shared = len(x & y)
            if shared and 100 * shared >= percent * (len(x) + len(y) - shared):
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return sorted((i, len(s), find(i), links[a]) for a, (i, s) in enumerate(sets))


@pytest.fixture(scope="module")
def copies(prose):
    """Groups of edited copies of texts of many lengths, shared passages, and texts of their own."""
    rng, rows = random.Random(5), []
    passage = prose(60, 999)
    for g in range(30):
        base = prose(rng.choice((2, 3, 5, 8, 13, 20, 40, 80, 160, 400)), g).split(" ")
        for c in range(rng.choice((1, 2, 3, 6, 12))):
            w = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3, len(w) // 20))):
                w[rng.randrange(len(w))] = f"zz{rng.randrange(10**6)}"
            rows.append(" ".join(w))
        rows.append(prose(50, 1000 + g) + " " + passage)
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (2, 60)])
def test_components(spark, copies, k, percent):
    df = spark.createDataFrame(copies, "doc_id long, text string")
    got = jaccard.jaccard_components(df, k, percent, block=4)
    assert sorted(map(tuple, got.collect())) == brute(copies, k, percent)


def test_ids_with_several_texts(spark, prose):
    """All rows of one id have one component, through whichever of its texts."""
    rows = [(3, prose(30, 1)), (5, prose(30, 1)), (5, prose(30, 2)), (9, prose(30, 2)), (5, None), (9, "one"), (7, prose(30, 3)), (7, prose(40, 4)), (7, prose(30, 3)), (8, prose(40, 4)), (6, prose(30, 5))]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(i, {5: 3, 9: 3, 8: 7}.get(i, i)) for i, _ in sorted(rows, key=lambda r: r[0])]


@pytest.mark.parametrize("percent", [60, 70, 75, 80, 90, 95])
def test_contained_texts(spark, percent):
    """Pairs whose sizes differ as much as links allow: a text and its beginning."""
    rng, rows = random.Random(percent), []
    for n in range(120):
        w = [f"w{rng.randrange(10**9)}" for _ in range(rng.randrange(4, 120))]
        rows += [(2 * n, " ".join(w)), (2 * n + 1, " ".join(w[: -(-len(w) * percent // 100) + rng.randrange(-1, 2)]))]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, percent)
    assert sorted(map(tuple, got.collect())) == brute(rows, 1, percent)


@pytest.mark.parametrize("by_pair", [0, 10**6])
def test_verification_counts_alike(monkeypatch, by_pair):
    monkeypatch.setattr(jaccard, "MOST_BY_PAIR", by_pair)
    rng = np.random.default_rng(by_pair)
    pool = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = [np.sort(rng.choice(pool, int(rng.integers(50, 60)), replace=False)) for _ in range(60)]
    i, j = jaccard.similar_pairs(sets, 80)
    want = {(a, b) for b in range(60) for a in range(b) if 100 * (n := len(np.intersect1d(sets[a], sets[b]))) >= 80 * (len(sets[a]) + len(sets[b]) - n)}
    assert set(zip(i.tolist(), j.tolist())) == want and len(want) > 100


def test_awkward_rows(docs, none, awkward):
    got = sorted({tuple(r)[:3] for r in jaccard.jaccard_components(docs).collect()})
    rows = sorted({(r[0], r[1]) for r in awkward})
    assert got == sorted({x[:3] for x in brute(rows, 3, 90)})
    assert jaccard.jaccard_components(none).isEmpty()


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_similar_sets_share_a_compound_token(percent):
    rng = np.random.default_rng(percent)
    for n in (1, 2, 3, 7, 20, 61, 150, 700):
        for _ in range(40):
            x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            y = np.concatenate([x[: n - int(rng.integers(0, n // 4 + 1))], rng.integers(0, 1 << 63, int(rng.integers(0, n // 5 + 1)), dtype=np.uint64)])
            x, y = np.unique(x), np.unique(y)
            shared = len(np.intersect1d(x, y))
            if not len(y) or 100 * shared < percent * (len(x) + len(y) - shared):
                continue
            for order in (1, 2):
                token, at = jaccard.compound_tokens(np.concatenate([x, y]), np.repeat([0, 1], [len(x), len(y)]), np.array([len(x), len(y)]), order, percent)
                assert set(token[at == 0].tolist()) & set(token[at == 1].tolist())


@pytest.mark.parametrize("percent", [30, 50, 60, 70])
def test_subsets_share_a_compound_token(percent):
    """The least similar sizes: a set within another."""
    rng = np.random.default_rng(percent)
    for n in (10, 100, 113, 128, 300, 1000):
        for _ in range(20):
            y = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            x = np.sort(rng.choice(y, -(-n * percent // 100), replace=False))
            for order in (1, 2):
                token, at = jaccard.compound_tokens(np.concatenate([x, y]), np.repeat([0, 1], [len(x), len(y)]), np.array([len(x), len(y)]), order, percent)
                assert set(token[at == 0].tolist()) & set(token[at == 1].tolist())


def test_passages(spark, prose):
    passage, other = prose(80, 1), prose(70, 2)
    fuzzy = passage.split(" ")
    fuzzy[20], fuzzy[41] = "changed", "changed"
    del fuzzy[60]
    rows = [(1, f"{prose(50, 3)} {passage} {prose(40, 4)}"), (2, f"{prose(90, 5)} {' '.join(fuzzy)}"), (3, prose(300, 6)), (4, f"{passage} {prose(20, 7)}\n{other}"), (5, f"{prose(30, 8)} {other}"), (6, None), (7, ""), (8, " ".join(prose(30, 1).split(" ")))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substrings.repeated_passages(df)
    texts = {i: (t or "").encode() for i, t in rows}
    got = {}
    for r in found.collect():
        got[(r["doc_id"], r["partner_id"])] = r
        own, partner = texts[r["doc_id"]][r["start"] : r["end"]], texts[r["partner_id"]][r["partner_start"] : r["partner_end"]]
        assert r["identity"] == 1.0 and own == partner or r["identity"] < 1.0
    assert set(got) == {(2, 1), (4, 1), (5, 4)}
    assert got[(4, 1)]["n_words"] == 80 and got[(5, 4)]["n_words"] == 70 and 0.9 < got[(2, 1)]["identity"] < 1 and got[(2, 1)]["n_words"] == 79
    left = {r["doc_id"]: r["text"] for r in substrings.cut_passages(df, found).collect()}
    assert left[1] == rows[0][1] and left[2] == prose(90, 5) and left[5] == prose(30, 8) and left[6] is None and left[3] == rows[2][1]


def test_passages_that_lesser_documents_hold_in_parts(spark, prose):
    """Excerpts under the least length in documents of lesser id cover the passage; it is found all the same."""
    rows = []
    for n in range(6):
        passage, i = prose(110, 600 + n).split(" "), 10 * n
        own = lambda k, m=40: prose(m, 1000 + 10 * i + k)
        for k, part in enumerate((passage[:45], passage[34:79], passage[68:])):
            rows.append((i + k, f"{own(k)} {' '.join(part)} {own(k + 3)}"))
        rows += [(i + 3, f"{own(6)} {' '.join(passage)} {own(7, 30)}"), (i + 4, f"{own(8, 70)} {' '.join(passage)} {own(9)}")]
    found = substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    seen = {i: {tuple(w[a : a + 50]) for a in range(len(w) - 49)} for i, w in ((i, WORD.findall(t.lower())) for i, t in rows)}
    want = {(i, j) for i in seen for j in seen if j < i and seen[i] & seen[j]}
    assert want == {(10 * n + 4, 10 * n + 3) for n in range(6)} == {(r["doc_id"], r["partner_id"]) for r in found}
    assert all(r["n_words"] == 110 and texts[r["doc_id"]][r["start"] : r["end"]] == texts[r["partner_id"]][r["partner_start"] : r["partner_end"]] for r in found)


def test_repeats_that_a_lesser_document_covers_in_part(spark, prose):
    """One document holds the words before a passage and its first words, one the rest, at every cut; two later ones hold the passage, one of them with the words before."""
    rows, want = [], {}
    for cut in range(10, 58):
        passage, before, i = prose(60, 3000 + cut).split(" "), prose(30, 4000 + cut), 100 * cut
        texts = (f"{before} {' '.join(passage[:cut])} {prose(20, 5000 + cut)}", f"{prose(20, 6000 + cut)} {' '.join(passage[cut:])}", " ".join(passage), f"{before} {' '.join(passage)}")
        rows += [(i + k, t) for k, t in enumerate(texts)]
        want[i + 3] = set(range(90)) if cut >= 20 else set(range(30, 90))
        want[i + 2] = set(range(60))
    found = substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    covered = {}
    for r in found:
        covered.setdefault(r["doc_id"], set()).update(range(r["first_word"], r["first_word"] + r["n_words"]))
    for i, words in want.items():
        if i % 100 == 3:
            assert words <= covered.get(i, set()), (i, sorted(words - covered.get(i, set())))


@pytest.mark.parametrize("seed,most_packed", [(1, 1 << 19), (2, 2000), (3, 300)])
def test_exact_repeats_against_brute_force(spark, prose, seed, most_packed):
    """Corpora of stock lines, quoted parts, whole passages and long words: every exact repeat is reported where a lesser document holds it."""
    rng = random.Random(seed)
    lines = [prose(rng.randrange(4, 14), 100 * seed + k) for k in range(25)]
    passages = [[f"{w}{'x' * rng.choice((0, 0, 30))}" for w in prose(rng.choice((52, 60, 90, 140)), 5000 * seed + k).split(" ")] for k in range(8)]
    rows = []
    for i in range(120):
        parts = []
        for k in range(rng.randrange(3, 9)):
            p, kind = rng.choice(passages), rng.random()
            if kind < 0.35:
                parts.append(rng.choice(lines))
            elif kind < 0.55:
                a = rng.randrange(len(p) - 20)
                parts.append(" ".join(p[a : a + rng.randrange(10, 30)]))
            elif kind < 0.7:
                parts.append(" ".join(p))
            else:
                parts.append(prose(rng.randrange(10, 60), 10**6 * seed + 100 * i + k))
        rows.append((i, "\n".join(parts)))
    found = substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), most_packed=most_packed).collect()
    words, least, want, covered = {i: WORD.findall(t.lower()) for i, t in rows}, {}, set(), set()
    for i, w in sorted(words.items()):
        for a in range(len(w) - 49):
            gram = tuple(w[a : a + 50])
            if least.setdefault(gram, i) != i:
                want |= {(i, k) for k in range(a, a + 50)}
    texts = dict(rows)
    for r in found:
        covered |= {(r["doc_id"], k) for k in range(r["first_word"], r["first_word"] + r["n_words"])}
        own = WORD.findall(texts[r["doc_id"]].encode()[r["start"] : r["end"]].decode().lower())
        assert own == words[r["doc_id"]][r["first_word"] : r["first_word"] + r["n_words"]] and r["partner_id"] < r["doc_id"]
        other = WORD.findall(texts[r["partner_id"]].encode()[r["partner_start"] : r["partner_end"]].decode().lower())
        assert r["identity"] < 1 or own == other
    assert len(want) > 1000 and want <= covered
    assert {i for i, _ in want} <= {r["doc_id"] for r in found}


@pytest.mark.parametrize("identity,least", [(0.95, 0.95), (0.9, 0.9), (0.85, 0.85), (0.8, 0.7)])
def test_edited_passages(spark, identity, least):
    """Recall of passages with random replaced words, by length."""
    rng, rows, sizes = random.Random(round(100 * identity)), [], {}
    text = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    for n in (51, 60, 80, 100):
        for _ in range(50):
            passage = text(n)
            edited = list(passage)
            for at in rng.sample(range(n), int(n * (1 - identity) + 1e-9)):
                edited[at] = text(1)[0]
            i = len(rows)
            sizes[i + 1] = n
            rows += [(i, " ".join(text(90) + passage + text(60))), (i + 1, " ".join(text(70) + edited + text(80)))]
    got = {(r["doc_id"], r["partner_id"]) for r in substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(j == i - 1 for i, j in got)
    recall = {n: sum(sizes[i] == n for i, _ in got) / 50 for n in (51, 60, 80, 100)}
    assert min(recall.values()) >= least and min(recall[n] for n in (60, 80, 100)) >= 0.9


def test_inserted_words_and_quotations(spark, prose):
    """45 words, 15 put in, 45 words; and a passage of 60 words of which lesser documents quote 19 each."""
    rng = random.Random(9)
    text = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    whole, quoted = text(90), text(60)
    rows = [(101, text(60) + whole + text(60)), (102, text(50) + whole[:45] + text(15) + whole[45:] + text(60))]
    rows += [(k, text(50) + quoted[14 * k : 14 * k + 19] + text(50)) for k in range(4)] + [(10, text(80) + quoted + text(50)), (20, text(60) + quoted + text(80))]
    got = substrings.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["partner_id"], r["n_words"], round(r["identity"], 3)) for r in got) == [(20, 10, 60, 1.0), (102, 101, 105, 0.857)]


@pytest.mark.parametrize("size", [16, 30, 60])
def test_passages_of_long_words(spark, size):
    """Exact passages of 51 words are found whatever the words' bytes."""
    rng = random.Random(size)
    text = lambda n: [f"{rng.randrange(10**9):0{size}d}" for _ in range(n)]
    rows = []
    for i in range(0, 40, 2):
        passage = text(51)
        rows += [(i, " ".join(text(60) + passage + text(60))), (i + 1, " ".join(text(80) + passage + text(70)))]
    got = {(r["doc_id"], r["partner_id"], r["n_words"]) for r in substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i + 1, i, 51) for i in range(0, 40, 2)}


def test_passages_of_awkward_rows(docs, none):
    found = substrings.repeated_passages(docs)
    assert {(r["doc_id"], r["partner_id"]) for r in found.collect()} == {(8, 7), (12, 7)}
    kept = substrings.cut_passages(docs, found)
    assert kept.columns == docs.columns and {8, 12}.isdisjoint(r["doc_id"] for r in kept.collect()) and kept.count() == docs.count() - 2
    assert substrings.repeated_passages(none).isEmpty() and substrings.cut_passages(none, found).isEmpty()


@pytest.mark.parametrize("seed", range(20))
def test_chains_are_best(seed):
    """The best chain's score equals that of trying every predecessor."""
    rng = random.Random(seed)
    pos, at = zip(*sorted((rng.randrange(300), rng.randrange(300)) for _ in range(25)))
    score = []
    for i in range(25):
        before = [score[j] - 0.25 * (pos[i] - pos[j] + at[i] - at[j]) for j in range(i) if pos[j] < pos[i] and at[j] < at[i]]
        score.append(60.0 + max([0.0, *before]))
    found = substrings.chains(np.array(pos), np.array(at), 60.0, 0.25, 1)
    first = found[0]
    assert all(pos[a] < pos[b] and at[a] < at[b] for a, b in zip(first, first[1:]))
    total = 60.0 * len(first) - 0.25 * (pos[first[-1]] - pos[first[0]] + at[first[-1]] - at[first[0]])
    assert abs(total - max(score)) < 1e-9 and sorted(i for c in found for i in c) == list(range(25))
