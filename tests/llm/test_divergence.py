"""Vocabulary divergence and the galloping search against brute force."""

import collections
import random
import re

import numpy as np
import pytest

from redpen.llm import divergence, gallop

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_gallop():
    rnd = np.random.default_rng(1)
    for _ in range(300):
        a = np.unique(rnd.integers(0, 400, rnd.integers(0, 120)))
        b = np.unique(rnd.integers(0, rnd.choice([5, 400, 100_000]), rnd.integers(0, 300)))
        assert gallop.places(a, b).tolist() == np.searchsorted(b, a).tolist()
        i, j = gallop.common(a, b)
        assert a[i].tolist() == b[j].tolist() == np.intersect1d(a, b).tolist()


def brute(rows, least_docs, top):
    rows = [(x or "", y or "", [t.translate(FOLD) for t in TERM.findall(z or "")]) for x, y, z in rows]
    out = []
    for lang in {x for x, _, _ in rows}:
        own = [(s, t) for x, s, t in rows if x == lang]
        held = collections.Counter(t for _, ts in own for t in set(ts))
        kept = sorted(t for t, n in held.items() if n >= least_docs)
        counts = {s: collections.Counter() for s, _ in own}
        for s, ts in own:
            counts[s].update(t for t in ts if held[t] >= least_docs)
        whole = sum(counts.values(), collections.Counter())

        def share(c, t):
            return 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))

        def price(a, b, t):
            p, q = share(a, t), share(b, t)
            return (p - q) ** 2 // (p + q)

        for s, c in counts.items():
            pairs = [(-sum(price(c, counts[o], t) for t in kept), o.encode(), o) for o in counts if o != s]
            terms = [(-price(c, whole, t), t.encode(), t) for t in kept if c[t] and share(c, t) > share(whole, t)]
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("audit", [divergence.Audit(), divergence.Audit(least_docs=2, top=3, block_terms=5, tile_groups=2)])
def test_divergence(spark, awkward, audit):
    rnd = random.Random(3)
    words = [f"{a}{b}" for a in ("Ab", "é", "Zz", "ÉÉ", "q") for b in ("x", "yy", "ö", "K")]
    rows = [(rnd.choice(("en", "de", None)), rnd.choice(("s1", "s2", "s3", "É", "", None)), " ".join(rnd.choices(words, k=rnd.randint(0, 30))) + "\x00b1c!é") for _ in range(120)]
    rows += [("xx", "lone", "few words"), ("xx", "other", None), ("yy", "only", "")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").unionByName(awkward.select("lang", "source", "text"))
    got = sorted(map(tuple, divergence.divergence(docs, audit).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == brute(docs.collect(), audit.least_docs, audit.top)


def test_empty_and_clashing(spark, empty, awkward):
    assert divergence.divergence(empty).collect() == []
    odd = awkward.selectExpr("doc_id", "text", "lang", "source", "doc_id as term", "1 as no", "2 as value", "'x' as item")
    assert divergence.divergence(odd).columns == ["lang", "source", "part", "item", "value", "rank"]


def test_shares_of_large_counts():
    counts = np.array([0, 1, 10**12, 10**15 + 7])
    m = 10**16 + 3
    assert divergence.shares(counts, m, 2).tolist() == [1 + 10**9 * (int(c) + 2) // m for c in counts]


def test_a_task_hands_counts_on_before_it_has_read_many():
    import pyarrow as pa

    from redpen.llm import divergence

    read = []

    def batches():
        for k in range(60):
            read.append(k)
            text = " ".join("".join(chr(97 + (n // 26**d) % 26) for d in range(5)) for n in range(k * 25_000, (k + 1) * 25_000))
            yield pa.record_batch([pa.array(["en"]), pa.array(["web"]), pa.array([text])], ["lang", "source", "text"])

    out = divergence._counted(batches())
    rows = next(out).num_rows
    assert len(read) < 30
    assert rows + sum(b.num_rows for b in out) == 1_500_000
