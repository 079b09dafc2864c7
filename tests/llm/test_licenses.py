import random
import time

import pytest

from webloom.llm import licenses


def by_brute_force(text, scanner):
    """Every template at every word, without hints and without counts of words: what stands first and is worth most."""
    lower, done, out = text.lower(), 0, []
    words = [(m[0], m.start(), m.end()) for m in licenses.WORDS.finditer(lower)]
    for _, at, _ in words:
        if at < done:
            continue
        best = None
        for gain, k in scanner.ranked(lower, at, range(len(scanner.templates))):
            got = scanner.confirm(words, at, k, done) if gain > 0 else None
            if got:
                worth = len(scanner.words[k]) - 3 * len(got[3]) - 2 * len(got[4])
                if best is None or (worth, gain) > best[:2]:
                    best = worth, gain, k, got
        if best:
            done = best[3][2]
            out.append((scanner.templates[best[2]][0], best[3]))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_scan_equals_brute_force(prose, seed):
    rng, scanner = random.Random(seed), licenses.Scanner()
    parts = []
    for n in range(7):
        parts.append(prose(rng.randrange(3, 40), 100 * seed + n))
        words = rng.choice(licenses.TEMPLATES)[1].split(" ")
        kind = rng.random()
        if kind < 0.3 and len(words) > 12:
            words[rng.randrange(len(words))] = "changed"
        elif kind < 0.4:
            words = words[: len(words) // 2]  # no notice
        parts.append(" ".join(words) if kind < 0.8 else "The driver showed a licence. " * 3)
    text = "\n".join(parts)
    got = [(license, (coverage, start, end, missing, extra)) for license, _, start, end, _, coverage, missing, extra in scanner.scan(text)]
    assert got == by_brute_force(text, scanner) and got


def test_a_text_of_many_hints_costs_little():
    scanner = licenses.Scanner()
    for text in ("The driver showed a licence. " * 2000, " ".join(w for ws in scanner.words for w in ws) + " The driver showed a licence. " * 2000):
        began = time.process_time()
        list(scanner.scan(text))
        assert time.process_time() - began < 2


def test_notices_side_by_side_are_reported_each():
    notice = "Licensed under the Apache License, Version 2.0."
    found = list(licenses.Scanner().scan(f"{notice} " * 50))
    assert len(found) == 50 and {f[0] for f in found} == {"Apache-2.0"} and [f[2] for f in found] == [48 * n for n in range(50)]
