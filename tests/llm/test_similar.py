"""Groups of similar shingle sets: keys that miss nothing, bounds that drop nothing, brute force on awkward groups."""

import random
from collections import Counter

import numpy as np
import pytest

from pixelweft.llm import simhash

from .test_operators import frame, words


def similar_pair(rng, n, differences):
    """Two sets of about n hashes that differ in so many."""
    base = [rng.getrandbits(64) for _ in range(n)]
    gone = rng.randint(0, min(differences, n - 1))
    a, b = set(base), set(base[gone:])
    while len(a ^ b) < differences:
        b.add(rng.getrandbits(64))
    return [np.array(sorted(s), np.uint64) for s in (a, b)]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 9, 12, 17, 20, 31, 40, 64, 90, 200, 700])
def test_similar_sets_share_a_key(n):
    rng, bounds = random.Random(n), simhash.size_bounds(0.8)
    tried = 0
    for differences in range(1 + 2 * n // 9):
        for _ in range(60 if n < 50 else 3):
            a, b = similar_pair(rng, n, differences)
            if 9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b)):
                tried += 1
                assert set(simhash.search_keys(a, 0.8, bounds, None)) & set(simhash.search_keys(b, 0.8, bounds, None))
    assert tried


def test_bounded_parts_miss_almost_nothing():
    rng, bounds, hit = random.Random(1), simhash.size_bounds(0.8), Counter()
    for _ in range(1500):
        a, b = similar_pair(rng, 400, rng.randint(70, 88))
        if 9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b)):
            hit[bool(set(simhash.search_keys(a, 0.8, bounds, simhash.PARTS)) & set(simhash.search_keys(b, 0.8, bounds, simhash.PARTS)))] += 1
    assert hit[False] == 0 and hit[True] > 1000


def test_parity_bits_never_exceed_the_difference():
    rng = random.Random(2)
    for n in (1, 30, 33, 100, 1000):
        for differences in (0, 1, n // 5, n):
            a, b = similar_pair(rng, n, differences)
            x, y = simhash.parity_bits(a), simhash.parity_bits(b)
            for size in range(int(np.log2(min(len(x), len(y)))) + 1):
                d = int(np.bitwise_count(simhash.fold(x, 1 << size) ^ simhash.fold(y, 1 << size)).sum())
                assert d <= len(np.setxor1d(a, b))
    a, b = similar_pair(rng, 400, 40)
    assert int(np.bitwise_count(simhash.parity_bits(a) ^ simhash.parity_bits(b)).sum()) >= 30


def groups_by_force(texts):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return set(root)


def test_unlike_short_texts_that_share_a_passage(spark):
    rng, passage = random.Random(7), words(17, 70)
    texts = [f"{passage} {words(6, 100 + k)}" for k in range(80)]
    for k in range(0, 60, 3):  # one word behind the passage is another
        own = texts[k].split()
        own[-1] = words(1, 500 + k)
        texts.append(" ".join(own))
    texts += [words(rng.randint(5, 12), 900 + k) for k in range(20)]
    texts += [" ".join(t.split()[:-1] + [words(1, 2000)]) for t in texts[-20:]]
    rng.shuffle(texts)
    kept = {r.doc_id for r in simhash.keep_one(frame(spark, [(k, t, "s") for k, t in enumerate(texts)])).collect()}
    assert kept == groups_by_force(texts) and len(kept) < len(texts)


def test_loose_group_in_several_blocks(spark):
    """Copies so far from each other that half of them link to nobody, in blocks smaller than the group."""
    rng, base = random.Random(8), words(120, 80).split()
    texts = [" ".join(w if rng.random() > rng.choice([0.005, 0.02, 0.04]) else words(1, rng.random()) for w in base) for _ in range(150)]
    docs = frame(spark, [(k, t, "s") for k, t in enumerate(texts)])
    real = simhash.open_pairs
    simhash.open_pairs = lambda *a: real(*a, room=16)
    try:
        kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    finally:
        simhash.open_pairs = real
    assert kept == groups_by_force(texts) and 1 < len(kept) < 150
