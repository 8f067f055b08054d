"""Near copies by MinHash against brute force."""

import math
import random

import numpy as np
import pytest

from redpen.llm import minhash, set_links
from tests.llm.conftest import AWKWARD
from tests.llm.test_free import brute_components

SMALL = minhash.Plan(gram=4, leaders=1)


def check(spark, extra, plan):
    docs = spark.createDataFrame(extra, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_copies(docs, plan).collect()}
    assert got == brute_components(extra, plan.gram, plan.percent)


def groups(seed, members, lengths, change):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (3, "  "), (4, "One two"), (5, "one TWO"), (6, "one two three")]
    for g, size in enumerate(lengths):
        base = [rnd.choice(words) for _ in range(size)]
        for m in range(members):
            own = base[:]
            for _ in range(rnd.randint(0, max(1, size // change))):
                own[rnd.randrange(size)] = rnd.choice(words)
            rows.append((1000 * (g + 1) + m, " ".join(own)))
    return rows


@pytest.mark.parametrize("plan", [minhash.Plan(), SMALL])
def test_near_copies(spark, plan):
    check(spark, groups(plan.gram, 20, (5, 12, 20, 40, 80, 150, 400), 20), plan)


@pytest.mark.parametrize("block", [16, 1024])
def test_many_about_the_threshold(spark, monkeypatch, block):
    """A large group whose sets are now above, now below the share, as one group and in blocks of keys."""
    monkeypatch.setattr(set_links, "BLOCK", block)
    check(spark, groups(9, 150, (60,), 12), SMALL)


def test_odd_rows(spark, awkward, empty):
    rows = minhash.near_copies(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert all(r.kept for r in rows if r.doc_id in (1, 2, 3)) and {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1, 2, 3}
    assert [r.kept for r in rows if r.doc_id is None] == [True, True]
    assert minhash.near_copies(empty).collect() == []


def test_posterior_bound():
    """The least numbers of equal hashes are where the posterior of a uniform prior, integrated, falls below the miss probability."""
    plan = minhash.Plan(miss=1e-3)
    x = (np.arange(200_000) + 0.5) / 200_000
    for n, least in plan.least_matches():
        def chance(m):
            density = np.exp(m * np.log(x) + (n - m) * np.log(1 - x) - math.lgamma(m + 1) - math.lgamma(n - m + 1) + math.lgamma(n + 2))
            return density[x >= 0.8].sum() / len(x)
        assert chance(least) >= plan.miss * 0.999 and (least == 0 or chance(least - 1) < plan.miss * 1.001)


def test_signatures_estimate_similarity():
    rnd = np.random.default_rng(2)
    plan = minhash.Plan(hashes=1024)
    a = np.sort(rnd.integers(0, 1 << 63, 1000).astype(np.uint64))
    b = np.sort(np.concatenate([a[:700], rnd.integers(0, 1 << 63, 300).astype(np.uint64)]))
    x, y = minhash.signatures([a, b], plan)
    assert abs((x == y).mean() - 700 / 1300) < 0.06
    assert set_links.similar(a, a[:800], 80) and not set_links.similar(a, a[:799], 80)
