"""Joins, dedup, tokens, archives, scores and decontamination against brute force."""

import collections
import hashlib
import itertools
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from redpen.llm import decontaminate, jaccard_join, lines, part_enum, set_links, substring, token_files, toxicity, warc, wordhash
from tests.llm.conftest import AWKWARD, WORD

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, sf_dir, extra):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))


def test_word_hashes():
    texts = ["a b  c", "", None, " Ab\tcd x é", "x", " ", "tail end", "end a"]
    for piece in wordhash.pieces(pa.array(texts), fold=True):
        expected = [w.translate(FOLD) for t in texts for w in WORD.findall(t or "")]
        assert piece.counts().tolist() == [len(WORD.findall(t or "")) for t in texts]
        assert len({*zip(expected, piece.words.tolist())}) == len(set(expected)) == len(set(piece.words.tolist()))


# --- 1 ---

def shingles(text, gram):
    words = WORD.findall((text or "").translate(FOLD))
    return frozenset(zip(*(words[k:] for k in range(gram)))) if len(words) >= gram else frozenset([tuple(words)] if words else [])


def brute_components(rows, gram, percent):
    sets = {k: shingles(t, gram) for k, t in rows}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for k in sorted(sets):
        common = collections.Counter(other for s in sets[k] for other in holders[s])
        for other, n in common.items():
            if 100 * n >= percent * (len(sets[k]) + len(sets[other]) - n):
                a, b = find(k), find(other)
                parent[max(a, b)] = min(a, b)
        for s in sets[k]:
            holders[s].append(k)
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("gram, percent", [(4, 85), (5, 80)])
def test_jaccard_join(spark, sf_dir, gram, percent):
    rnd = random.Random(gram)
    words = [f"w{i}" for i in range(300)]
    extra = [(20000, None), (20001, ""), (20002, "  "), (20003, "One two"), (20004, "one TWO"), (20005, "one two three")]
    for group in range(8):
        base = [rnd.choice(words) for _ in range(rnd.choice((12, 20, 40, 80, 150, 400)))]
        for member in range(20):
            own = base[:]
            for _ in range(rnd.randint(0, max(1, len(own) // 25))):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            extra.append((30000 + group * 100 + member, " ".join(own)))
    docs = documents(spark, sf_dir, extra)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.joined(docs, gram, percent).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()], gram, percent)


def test_jaccard_join_of_a_group_just_below_the_share(spark, monkeypatch):
    """Many texts about the threshold: some pairs link, most do not; they meet in blocks."""
    monkeypatch.setattr(set_links, "BLOCK", 32)
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    base = [rnd.choice(words) for _ in range(90)]
    rows = []
    for member in range(300):
        own = base[:]
        for _ in range(rnd.randint(1, 4)):
            own[rnd.randrange(len(own))] = rnd.choice(words)
        rows.append((member, " ".join(own)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.joined(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == brute_components(rows, 4, 85)


def test_rows_of_keys_that_several_sets_have():
    rnd = random.Random(3)
    for _ in range(200):
        rows = sorted((rnd.randrange(6), rnd.randrange(4)) for _ in range(rnd.randrange(40)))
        cut = sorted(rnd.randrange(len(rows) + 1) for _ in range(4))
        parts = [rows[a:b] for a, b in zip([0, *cut], [*cut, len(rows)])]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in p], pa.int64()) for k in range(2)], ["key", "h1"]) for p in parts]
        got = sorted(x for b in set_links._shared(batches) for x in zip(*(c.to_pylist() for c in b.columns)))
        want = sorted({r for r in rows if len({h for k, h in rows if k == r[0]}) > 1})
        assert got == want


def test_representatives_keep_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 5, "x"), (2, "a b c d e f", 6, "y"), (None, "a b c d e f", 7, "z"), (3, None, 8, "q")], "doc_id long, text string, d long, tie string")
    docs = docs.selectExpr("*", "d as near_d", "tie as near_tie", "doc_id as comp", "text as whole")
    kept = jaccard_join.representatives(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted(map(tuple, docs.where("doc_id in (1, 3)").collect()))


def test_jaccard_join_odd_rows(spark, awkward, empty):
    rows = jaccard_join.joined(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1, 2, 3}
    kept = jaccard_join.representatives(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(AWKWARD) - 1
    assert jaccard_join.joined(empty).count() == 0


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_similar_sets_share_a_signature(percent):
    bands, rng = part_enum.Bands(percent), np.random.default_rng(percent)
    for _ in range(800):
        x = np.unique(rng.integers(0, 2**64, int(np.exp(rng.uniform(0, 7))), dtype=np.uint64))
        lost, new = rng.integers(0, len(x) // 6 + 1), rng.integers(0, len(x) // 6 + 1)
        if (len(x) - lost) * 100 < percent * (len(x) + new):
            lost = new = 0
        y = np.unique(np.concatenate([rng.permutation(x)[lost:], rng.integers(0, 2**64, new, dtype=np.uint64)]))
        a, b = ({s for p in bands.plans(len(z)) if p for s in part_enum.signatures(z, p).tolist()} for z in (x, y))
        assert a & b
        assert part_enum.apart(part_enum.sketch(x), part_enum.sketch(y)) <= len(np.setxor1d(x, y))


def test_components_of_long_chains(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 101)]
    got = {r.node: r.comp for r in set_links.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}


# --- 2 ---

def test_loser_tree_merges():
    rnd = random.Random(2)
    for k in range(0, 9):
        runs = [sorted(rnd.randrange(50) for _ in range(rnd.randrange(20))) for _ in range(k)]
        if runs:
            assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    big, other = "<p>" + "é" * 600, "<b>" + "x" * 2000
    rows = [(1, "http://www.b.org/x?q=1", big), (2, "https://a.org/", big), (3, None, big), (4, "bad\r\nurl", ""), (5, "http://[x", None), (6, "http://a.org/Z", other), (None, "http://c.org", other), (7, "http://d.org", "small"), (8, "http://d.org", "small")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, record_id string")
    monkeypatch.setattr(warc, "FAN_IN", 2)
    folder = f"file://{tmp_path}/archive"
    runs = warc.write(pages.repartition(5), folder)
    index = warc.merged_index(spark, folder, runs, ranges=3)
    history = sorted(index.collect(), key=lambda r: r.part)
    keys = [(r.url_key, r.captured, r.record_id) for r in history]
    assert len(keys) == len(rows) and keys == sorted(keys)
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(index, folder).collect()}

    def row(page_id, html, kind="response", refers=None):
        data = (html or "").encode()
        return page_id, len(data), hashlib.sha1(data).hexdigest(), kind, refers

    assert got == {row(1, big, "revisit", 3), row(2, big, "revisit", 3), row(3, big), row(4, ""), row(5, None), row(6, other), row(None, other, "revisit", 6), row(7, "small"), row(8, "small")}
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- 4 ---

def brute_cut(rows, width):
    words = {k: WORD.findall(t or "") for k, t in rows}
    first, out = {}, {}
    for k in sorted(words):
        for i in range(len(words[k]) - width + 1):
            first.setdefault(tuple(words[k][i : i + width]), (k, i))
    for k, own in words.items():
        gone = {i + j for i in range(len(own) - width + 1) if first[tuple(own[i : i + width])] != (k, i) for j in range(width)}
        out[k] = (len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone))
    return out


@pytest.mark.parametrize("width, core, hot", [(20, 6, 5000), (20, 6, 3), (7, 3, 2)])
def test_substring(spark, sf_dir, width, core, hot):
    period = "a b " * 40
    docs = documents(spark, sf_dir, [(9001, None), (9002, ""), (9003, period), (9004, period + "x " + period), (9005, " é \x0b" + "é ü z " * 30)])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.deduplicated(docs.repartition(5), width, core, hot).collect()}
    assert got == brute_cut([(r.doc_id, r.text) for r in docs.collect()], width)


def test_substring_odd_rows(spark, awkward, empty):
    rows = substring.deduplicated(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert {(r.n_words, r.n_removed) for r in rows if r.doc_id == 6} == {(3000, 2999)}
    assert substring.deduplicated(empty).count() == 0


# --- 6 ---

def test_toxicity(spark, sf_dir, awkward, empty):
    rnd = random.Random(6)
    plain = ["river", "stone", "garden", "winter", "letter", "window", "orange", "market", "silver", "summer"]
    insults = ["idiot", "moron", "stupid"]
    train = []
    for n in range(600):
        words = [rnd.choice(plain) for _ in range(30)]
        toxic = int(n % 4 == 0)
        if toxic:
            words.insert(rnd.randrange(30), rnd.choice(insults))
        train.append((n, " ".join(words), toxic))
    docs = spark.createDataFrame(train, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    tests = ["the m0r0n came", "an 1diot here", "so stuuuupid now", "you i d i o t then", "the st.up.id one", "clean garden text", "numbers 10 and 2020", ""]
    scores = {r.doc_id: r.score for r in toxicity.scored(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), model).collect()}
    assert all(scores[k] >= 0.7 for k in range(5)) and all(scores[k] < 0.3 for k in range(5, 8))
    judged = {r.doc_id: r for r in toxicity.predicted(docs.select("doc_id", "text"), labels).collect()}
    held = [k for k in judged if zlib.crc32(str(k).encode()) % 3 == 1]
    assert {k for k, r in judged.items() if r.held_out} == set(held)
    assert sum(judged[k].predicted == train[k][2] for k in held) / len(held) > 0.98
    # labels of held-out rows change nothing
    other = labels.withColumn("toxic", (toxicity.crc_third(labels.doc_id) == 1).cast("int") + labels.toxic * (toxicity.crc_third(labels.doc_id) != 1).cast("int"))
    assert {r.doc_id: r.score for r in toxicity.predicted(docs, other).collect()} == {k: r.score for k, r in judged.items()}
    assert toxicity.predicted(awkward, labels).count() == len(AWKWARD)
    assert toxicity.clean(awkward, labels).columns == awkward.columns
    assert toxicity.predicted(empty, labels.limit(0)).count() == 0


def test_decoding_equals_the_best_of_all_lattice_paths():
    rnd = random.Random(6)
    model = np.log(np.random.default_rng(6).dirichlet(np.ones(toxicity.ALPHABET), (toxicity.ALPHABET, toxicity.ALPHABET)))
    decoder = toxicity.Decoder(model)
    signs = "abelost" + "".join(toxicity.SIGNS) + "é-"

    def score(path):
        x = y = 0
        total = 0.0
        for letters, cost in path:
            total += cost
            for c in letters:
                z = int(toxicity._TABLE[ord(c)]) if ord(c) < len(toxicity._TABLE) else 27
                total += model[x][y][z]
                x, y = y, z
        return total + model[x][y][0]

    for _ in range(400):
        token = "".join(rnd.choice(signs) * rnd.choice((1, 1, 1, 2, 3)) for _ in range(rnd.randint(1, 5)))
        choices = decoder._choices(token)
        if np.prod([len(c) for c in choices]) > 20_000:
            continue
        paths = sorted(((score(p), "".join(x for x, _ in p)) for p in itertools.product(*choices)), reverse=True)
        found = decoder._viterbi(token)
        assert any(text == found and value > paths[0][0] - 1e-9 for value, text in paths)
        # a reading is only left out if no path begins with an opening
        openings = {"".join(rnd.choices("abelost", k=rnd.choice((2, 3)))) for _ in range(4)}
        opened = any(text[:3] in openings for _, text in paths)
        assert toxicity.Decoder(model, openings).word(token) == (found if opened else "")


def test_toxicity_of_other_disguises(spark):
    rnd = random.Random(7)
    plain = ["river", "stone", "garden", "winter", "letter", "window", "orange", "market", "silver", "summer"]
    rows = [(n, " ".join([rnd.choice(plain) for _ in range(30)] + [rnd.choice(["idiot", "stupid", "ass"])] * (n % 4 == 0)), int(n % 4 == 0)) for n in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    disguised = ["river 455 stone", "the @55 came", "an a$$ here", "so stuupid now", "an idiiot, then", "you i  d  i  o  t now", "you i. d. i. o. t. Then", "what an i - d - i - o - t"]
    clean = ["letter, summer!! winter", "numbers 10, 2020 and 1.500", "a  b  c of the garden", "$$ and !!! and --", "river@stone.market"]
    scores = {r.doc_id: r.score for r in toxicity.scored(spark.createDataFrame([*enumerate(disguised + clean)], "doc_id long, text string"), model).collect()}
    assert [t for k, t in enumerate(disguised + clean) if scores[k] >= 0.7] == disguised


@pytest.mark.parametrize("clean, toxic", [([0] * 20000, [10] * 2000), ([0] * 20000 + [3] * 50, [8] * 5 + [10] * 2000), ([0] * 12291 + [4.6] * 69 + [10], [8.2] * 5 + [10] * 1280)])
def test_fit_of_separate_classes(clean, toxic):
    x, y = np.array(clean + toxic, float), np.repeat([0.0, 1.0], [len(clean), len(toxic)])
    slope, offset = toxicity._logistic(x, y)
    score = 1 / (1 + np.exp(-(slope * np.array([0, 3, 8, 10]) + offset)))
    assert score[0] < 0.1 and score[1] < 0.3 and score[2] > 0.7 and score[3] > 0.9


# --- 7 ---

def test_decontamination(spark, sf_dir, awkward, empty):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = {r.item_id: WORD.findall(r.text.translate(FOLD)) for r in bench.collect()}
    rnd, extra = random.Random(3), []
    for n in range(30):
        k, words = rnd.choice([*items.items()])
        own = [w if rnd.random() > 0.12 else f"zz{rnd.randrange(99)}" for w in words]
        extra.append((51000 + n, " ".join(["lorem"] * rnd.randint(0, 30) + own + ["ipsum"] * rnd.randint(0, 30))))
    docs = documents(spark, sf_dir, extra)
    expected = {}
    for r in docs.collect():
        words = WORD.findall((r.text or "").translate(FOLD))
        places = collections.defaultdict(list)
        for i, w in enumerate(words):
            places[w].append(i)
        for k, item in items.items():
            shifts = collections.Counter(i - j for j, w in enumerate(item) for i in places.get(w, ()))
            for shift in (s for s, n in shifts.items() if n >= 8):
                low, high = max(0, -shift), min(len(item), len(words) - shift)
                same = decontaminate._best(np.array([words[shift + j] == item[j] for j in range(low, high)]))[2]
                if same >= min(len(item), 13, max(8, int(np.ceil(0.7 * len(item))))):
                    expected[r.doc_id, k] = max(same, expected.get((r.doc_id, k), 0))
    got = {(r.d, r.item_id): r.same_words for r in decontaminate.overlaps(docs, bench).collect()}
    assert got == expected and len(got) > 25
    assert decontaminate.overlaps(awkward, bench).count() == 0
    assert decontaminate.overlaps(empty, bench).count() == 0
    assert decontaminate.overlaps(awkward, bench.limit(0)).count() == 0
    assert decontaminate.clean(awkward, bench).count() == len(AWKWARD)
    assert decontaminate.clean(docs, bench).count() == docs.count() - len({k for k, _ in got})


def brute_passage(words, item):
    """Whether any stretch of any alignment has enough equal words and 70 % of its words equal."""
    needed = min(len(item), 13, max(8, -(-7 * len(item) // 10)))
    for shift in range(-len(item), len(words)):
        equal = [0 <= j + shift < len(words) and words[j + shift] == w for j, w in enumerate(item)]
        for a in range(len(item)):
            for b in range(a + needed, len(item) + 1):
                same = sum(equal[a:b])
                if same >= needed and 10 * same >= 7 * (b - a):
                    return True
    return False


def test_decontamination_finds_short_items_whole(spark):
    bench = spark.createDataFrame([(1, "What is TWO plus two"), (2, "three words only"), (3, "  "), (4, None), (5, "one two three four five six")], "item_id long, text string")
    texts = ["so what is two plus two then", "what is two plus three", "Three words only", "three words", "two", "", None, "x one two three four five six"]
    docs = spark.createDataFrame([(k, t, "l", k) for k, t in enumerate(texts)], "doc_id long, text string, leak_d string, d long")
    found = {(r.d, r.item_id, r.start, r.length) for r in decontaminate.overlaps(docs, bench).collect()}
    assert found == {(0, 1, 1, 5), (2, 2, 0, 3), (7, 5, 1, 6)}
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [tuple(r) for r in docs.orderBy("doc_id").collect() if r.doc_id not in (0, 2, 7)]


def test_decontamination_counts_whole_alignments(spark):
    items = {1: [f"a{k}" for k in range(15)], 2: [f"b{k}" for k in range(59)], 3: [f"c{k}" for k in range(40)]}
    swap = lambda words, at: [f"z{k}" if k in at else w for k, w in enumerate(words)]
    texts = [
        swap(items[1], {2, 12}),
        swap(items[2], set(range(3, 59, 4))),
        swap(items[2], set(range(3, 59, 4)))[10:40],
        swap(items[2], set(range(0, 59, 2))),
        items[3][:6] + ["x"] * 20 + items[3][26:33],
        swap(items[1], {0, 3, 7, 10, 13}),
        items[3][:12],
    ]
    texts = [["lorem"] * 9 + t + ["ipsum"] * 9 for t in texts]
    docs = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in items.items()], "item_id long, text string")
    got = {(r.d, r.item_id): r for r in decontaminate.overlaps(docs, bench).collect()}
    assert set(got) == {(n, k) for n, t in enumerate(texts) for k, item in items.items() if brute_passage(t, item)} == {(0, 1), (1, 2), (2, 2)}
    assert [(r.start, r.length, r.same_words) for r in (got[0, 1], got[1, 2])] == [(9, 15, 13), (9, 59, 45)]


# --- 8 ---

def _tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(_tokenizer()), token_files.Encoder(_tokenizer(), 2)
    rnd = random.Random(8)
    texts = ["", "İstanbul ΣΑΣ ς ǅ", "it's I'LL 'S ''s x'd 12½²³ ª", "­ soft­hy \x85 \x1c a\x1fb", "é é ŉ ſt ﬁ 😀👍🏽", "<|endoftext|> x <|startoftext|>", "Ÿ ß K \xa0 z"]
    texts += ["".join(rnd.choice("abcÀéß'sStT l0९²½#*-–\n\t\r\x0b İſ́ \xad ") for _ in range(60)) for _ in range(400)]
    texts += ["".join(rnd.choice("abcÀéßÞ'sStTlLdDvVrReE019²½#*-\n\t\x0b_ ſŸ") for _ in range(60)) for _ in range(400)]
    ids, ends = own.encode(texts)
    begins = np.concatenate([[0], ends[:-1]])
    for text, a, b in zip(texts, begins, ends, strict=True):
        assert ids[a:b].tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


def test_encoder_keeps_the_words_met_most_often(monkeypatch):
    monkeypatch.setattr(token_files, "CACHED_WORDS", 400)
    own, whole = token_files.Encoder(_tokenizer(), 2), token_files.Encoder(_tokenizer(), 2)
    for n in range(12):
        texts = [" often said, ÉTÉ\n" * 20 + f" rare{chr(97 + n)}{chr(97 + k % 26)}{chr(97 + k // 26)}x " for k in range(90)] + ["", "  ", "漢字 text"]
        ids, ends = own.encode(texts)
        monkeypatch.setattr(token_files, "CACHED_WORDS", 1 << 30)
        expected, expected_ends = whole.encode(texts)
        monkeypatch.setattr(token_files, "CACHED_WORDS", 400)
        assert ids.tolist() == expected.tolist() and ends.tolist() == expected_ends.tolist()
        assert len(own.words.codes) < 600
    own.words.trim(100)
    assert {"often", "said,", "été"} <= own.words.codes.keys() and len(own.words.codes) == 100


def test_token_files(spark, sf_dir, awkward, empty, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(_tokenizer())
    docs = documents(spark, sf_dir, [(9001, None), (9002, "")])
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.round_trip(docs.repartition(6), _tokenizer(), path=f"{tmp_path}/t").collect()}
    at, expected = 0, {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        expected[r.doc_id] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == expected
    import pyarrow.parquet as pq

    files = sorted(f for f in os.listdir(f"{tmp_path}/t") if f.endswith(".parquet"))
    group = pq.ParquetFile(f"{tmp_path}/t/{files[0]}").metadata.row_group(0)
    kinds = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
    assert all(c.has_offset_index for c in kinds.values())
    assert "RLE_DICTIONARY" in kinds["ids.list.element"].encodings and "DELTA_BINARY_PACKED" in kinds["doc_id"].encodings
    rows = token_files.round_trip(awkward, _tokenizer()).collect()
    assert len(rows) == len(AWKWARD) and len({r.start for r in rows}) == len(AWKWARD)
    assert token_files.round_trip(empty, _tokenizer()).count() == 0


# --- 9 ---

def brute_lines(rows, least):
    white = " \t\n\x0b\x0c\r"
    first, holders = {}, collections.defaultdict(set)
    for k, t in rows:
        for line in (t or "").split("\n"):
            key = line.strip(white).translate(FOLD)
            holders[key].add(k)
            first[key] = min(k, first.get(key, k))
    out = {}
    for k, t in rows:
        own = (t or "").split("\n")
        keep = [x for x in own if len(x.strip(white)) < least or first[x.strip(white).translate(FOLD)] == k]
        out[k] = (len(own), len(own) - len(keep), "\n".join(keep))
    return out


@pytest.mark.parametrize("batches, fanout", [(1, 3), (4, 2), (7, 3)])
def test_lines(spark, sf_dir, batches, fanout):
    docs = documents(spark, sf_dir, [(9001, None), (9002, ""), (9003, "The Same Line\n\n  the same line \nshort\nshort"), (9004, "the same LINE\nshort\n"), (9005, "ÉÉÉÉÉÉÉÉÉÉ\néééééééééé")])
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in lines.deduplicated(docs, 10, batches, fanout).collect()}
    assert got == brute_lines([(r.doc_id, r.text) for r in docs.collect()], 10)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_runs")]


def test_lines_odd_rows(spark, awkward, empty):
    rows = lines.deduplicated(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert all(r.n_dropped == 0 for r in rows if r.doc_id == 4)
    assert lines.deduplicated(empty).count() == 0
