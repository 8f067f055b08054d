"""Token alignment against whole-text encoding and a plain search for common ends."""

import collections
import hashlib
import random

import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from redpen.llm import alignment  # noqa: E402
from tests.llm.conftest import AWKWARD  # noqa: E402

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    " ", "  ", "\n", "a ", " a", "  a  b ", "a\n\nb \n c", "x  y  z", "x▁y", "a\x00b\x7f c", "퟿ é ǘ ﬁ",
    "<s> </s> <|endoftext|> <0x0A> <unk>", "it's  we'll\tdon't \r\n end", "日本語 テキスト　空白", "😀 😀😀 a", "1234 56,78.9\n#$%", " a b", "\x1c a b \x85 c",
]


def encoded(own, text):
    """Ids and byte ends of both tokenizers over whole texts."""
    a = own.a.encode(" " + text, add_special_tokens=False).ids if text else []
    b = own.b.encode(text) if text else []
    sides = [[own.a_bytes[i] for i in a], [own.b_bytes[i] for i in b]]
    if any(b"".join(x) != (" " + text).encode() for x in sides):
        return [], [], [], []
    ends = [[sum(map(len, x[: i + 1])) for i in range(len(x))] if len(x) < 400 else None for x in sides]
    for k, x in enumerate(sides):
        if ends[k] is None:
            total, ends[k] = 0, []
            for t in x:
                total += len(t)
                ends[k].append(total)
    return a, b, *ends


def brute(own, rows):
    found, links, counts = [], [], collections.Counter()
    for doc_id, text in rows:
        a, b, a_ends, b_ends = encoded(own, text or "")
        both = sorted(set(a_ends) & set(b_ends))
        groups, i, j = [], 0, 0
        for end in both:
            i2, j2 = a_ends.index(end, i) + 1, b_ends.index(end, j) + 1
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            i, j = i2, j2
        pairs = [(a[x], b[y]) for x, end in enumerate(a_ends) if end in set(both) for y in [b_ends.index(end)]]
        counts.update(pairs)
        links.append(pairs)
        found.append((doc_id, len(a), len(b), len(both), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = collections.Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    out = []
    for (doc_id, n_a, n_b, n_groups, digest), pairs in zip(found, links, strict=True):
        out.append((doc_id, n_a, n_b, n_groups, len(pairs), sum(counts[p] == most[p[1]] for p in pairs), sum(counts[p] for p in pairs), digest))
    return out


def test_linked(spark, sf_dir, monkeypatch):
    own = alignment.aligner(*PATHS)
    rows = [(r[0], r[1]) for r in AWKWARD] + [(100 + i, x) for i, x in enumerate(ODD)] + [(200 + i, f"one two {x} three\nfour five {x}") for i, x in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60").select("doc_id", "text"))
    got = alignment.linked(docs, *PATHS).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    expected = brute(own, [(r.doc_id, r.text) for r in docs.collect()])
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


def test_pieces_join_as_whole_texts():
    """Whatever the texts, cutting changes no token."""
    own = alignment.Aligner(*PATHS)
    rnd = random.Random(5)
    signs = [" ", " ", " ", "\n", "\t", "a", "the", "Ing", "é", "ß", ".", ",", "'s", "7", "42", "日", " ", "\x1f", "😀", "_", "  ", "\r\n"]
    texts = ["".join(rnd.choices(signs, k=rnd.randint(0, 40))) for _ in range(1500)]
    x = own.align(pa.array(texts, pa.large_string()))
    for i, text in enumerate(texts):
        a, b, _, _ = encoded(own, text)
        assert x.a[x.a_first[i] : x.a_first[i + 1]].tolist() == a, text
        assert x.b[x.b_first[i] : x.b_first[i + 1]].tolist() == b, text


def test_overlaps(spark):
    own = alignment.aligner(*PATHS)
    texts = ["unbelievable tokenization, naïve 日本", "", "x", "a  b\n\nc"]
    rows = alignment.alignments(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), *PATHS).collect()
    for r in rows:
        a, b, a_ends, b_ends = encoded(own, texts[r.doc_id])
        assert (r.a_ids, r.b_ids) == (a, b)
        assert [(a_ends[i - 1], b_ends[j - 1]) for i, j in zip(r.a_stops, r.b_stops)] == [(e, e) for e in sorted(set(a_ends) & set(b_ends))]
        for i, (end, low, high) in enumerate(zip(a_ends, r.overlap_from, r.overlap_to, strict=True)):
            begin = a_ends[i - 1] if i else 0
            assert list(range(low, high)) == [j for j, e in enumerate(b_ends) if e > begin and (b_ends[j - 1] if j else 0) < end]


def test_cleared_cache_and_bad_pieces(monkeypatch):
    own = alignment.Aligner(*PATHS)
    texts = pa.array(["one two three", "four five", "two one"], pa.large_string())
    whole = own.align(texts)
    monkeypatch.setattr(alignment, "KNOWN_PIECES", 0)
    again = own.align(texts)
    assert whole.a.tolist() == again.a.tolist() and whole.b_last.tolist() == again.b_last.tolist()
    # a tokenizer that loses a piece loses the text that holds it, no other
    own.b_bytes = [x.replace(b"five", b"5ive") for x in own.b_bytes]
    own.clear()
    x = own.align(texts)
    assert x.a_first.tolist()[1] == x.a_first.tolist()[2] < x.a_first.tolist()[3]


def test_empty(spark, empty):
    assert alignment.linked(empty, *PATHS).collect() == []
    assert alignment.alignments(empty, *PATHS).collect() == []
