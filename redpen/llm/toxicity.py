"""Toxicity scores of texts restored by a noisy-channel decoder.

Tokens that may be disguised (digits or signs for letters, doubled or drawn out letters, letters
spaced apart) become lattices of what each character may stand for.  A Viterbi search over pairs of
letters finds the likeliest reading under a character trigram model counted over the whole
corpus.  Words and word beginnings of the restored text are then weighed by how their document
frequencies differ between labelled toxic and clean documents.
"""

from __future__ import annotations

import math
import re
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redpen.llm.common import of_worker, written

#: Which letters a sign may stand for, with the share each takes; "" drops the sign.
SIGNS = {
    "0": {"o": 0.95, "": 0.01},
    "1": {"i": 0.5, "l": 0.45, "": 0.01},
    "2": {"z": 0.6, "": 0.02},
    "3": {"e": 0.95, "": 0.01},
    "4": {"a": 0.95, "": 0.01},
    "5": {"s": 0.95, "": 0.01},
    "6": {"g": 0.6, "b": 0.3, "": 0.02},
    "7": {"t": 0.95, "": 0.01},
    "8": {"b": 0.9, "": 0.02},
    "9": {"g": 0.8, "": 0.05},
    "@": {"a": 0.8, "": 0.05},
    "$": {"s": 0.8, "": 0.05},
    "!": {"i": 0.6, "l": 0.2, "": 0.05},
    "|": {"i": 0.4, "l": 0.4, "": 0.05},
    "+": {"t": 0.7, "": 0.05},
    "(": {"c": 0.5, "": 0.2},
    "€": {"e": 0.8, "": 0.05},
    "*": {"": 0.5, "a": 0.1, "e": 0.1, "i": 0.1, "o": 0.1, "u": 0.1},
}
#: What a drawn-out letter costs for each letter dropped, and for the second one kept.
DROP_REPEAT, KEEP_REPEAT = math.log(0.5), math.log(0.3)

#: Letters of the model: 0 is a word's edge, 1 to 26 are a to z, 27 is any other letter.
ALPHABET = 28
_TABLE = np.zeros(0x250, np.int64)
for _c in range(0x250):
    _low = chr(_c).lower()[0]
    _TABLE[_c] = ord(_low) - 96 if "a" <= _low <= "z" else (27 if chr(_c).isalpha() else 0)


@dataclass(frozen=True)
class Settings:
    """``train_rows``: labelled rows that the word weights are fitted on, at most (a sample by hash).
    ``least_evidence``: likelihood ratio (natural logarithm) below which a feature is chance.
    ``least_share``: share of toxic documents among those with a feature.
    ``threshold``: score from which a document counts as toxic."""

    train_rows: int = 12_000
    least_evidence: float = 15.0
    least_share: float = 0.9
    threshold: float = 0.7
    seed: int = 11


def _trigrams(batches):
    """Texts to (code, n): how often each run of three letters or edges occurs."""
    total = np.zeros(ALPHABET**3, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
            codes = np.where(points < len(_TABLE), _TABLE[np.minimum(points, len(_TABLE) - 1)], 27)
            codes = np.concatenate([[0], codes, [0]])
            total += np.bincount(codes[:-2] * (ALPHABET * ALPHABET) + codes[1:-1] * ALPHABET + codes[2:], minlength=len(total))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["code", "n"])


def letter_model(docs: DataFrame) -> np.ndarray:
    """Log-probabilities [a, b, c] of letter c after a and b, from the counts of all texts.

    One row per kind of trigram reaches the driver: 28^3 at most, whatever the corpus holds.
    """
    rows = docs.select("text").mapInArrow(_trigrams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(ALPHABET**3)
    for row in rows:
        counts[row["code"]] = row["n"]
    counts = counts.reshape(ALPHABET, ALPHABET, ALPHABET)
    counts[:, 0, 0] = 0  # gaps between words say nothing
    pairs = counts.sum(axis=0) + 0.1
    backed = pairs / pairs.sum(axis=1, keepdims=True)
    return np.log((counts + 5.0 * backed[None]) / (counts.sum(axis=2, keepdims=True) + 5.0))


#: Letters that tell whether a word can begin a weighed feature.
_SHORTEST = 3


class Decoder:
    """Restores tokens; keeps those it has met, up to ``most`` of them.

    With ``openings`` only readings that begin with one of them (or are one) are sought: tokens whose lattice has no path that does
    are not decoded.
    """

    same = re.compile(r"([^\w\s])\1+$|^([^\w\s])\2+")
    plain_edges = re.compile(r"^[\"'(\[{,.;:?]+|[\"')\]},.;:?!]+$")
    doubled = re.compile(r"([^\W\d_])\1")
    spaced = re.compile(r"(?<!\S)[^\s.\-_](?:[\s.\-_]+[^\s.\-_]){2,}(?![^\s.,;:!?\-_])")

    def __init__(self, model: np.ndarray, openings: set[str] | None = None, most: int = 300_000):
        self.model, self.openings = model.tolist(), openings
        self.most, self.met = most, {}

    def parts(self, token: str) -> set[str]:
        """The parts of a token that may be a disguised word: with and without signs that may be punctuation."""
        bare = self.plain_edges.sub("", self.same.sub("", token))
        full = token.strip(_OUTER)
        return {x for x in (bare, full, full.rstrip("!")) if x and (not x.isalpha() or self.doubled.search(x))}

    def readings(self, token: str) -> tuple[str, ...]:
        """What a token may say besides its plain letters."""
        found = self.met.get(token)
        if found is None:
            if len(self.met) >= self.most:
                self.met.clear()
            plain = token.isalpha() and not self.doubled.search(token)
            found = self.met[token] = () if plain else tuple({w for x in self.parts(token) if (w := self.word(x))})
        return found

    def word(self, letters: str) -> str:
        """The likeliest reading of letters and signs; empty if it cannot begin with an opening."""
        return self._viterbi(letters) if self.openings is None or self._may_open(letters) else ""

    def _may_open(self, token: str) -> bool:
        begun = {""}
        for choices in self._choices(token):
            longer = {b + letters for b in begun for letters, _ in choices}
            if any(x[:_SHORTEST] in self.openings for x in longer if len(x) >= _SHORTEST):
                return True
            begun = {x for x in longer if len(x) < _SHORTEST}
            if not begun:
                return False
        return any(x in self.openings for x in begun)

    def _choices(self, token: str) -> list[list[tuple[str, float]]]:
        out, k = [], 0
        while k < len(token):
            c, run = token[k], 1
            while k + run < len(token) and token[k + run] == c:
                run += 1
            if c.isalpha():
                if run == 1:
                    out.append([(c, 0.0)])
                else:
                    out.append([(c, 0.0 if run == 2 else DROP_REPEAT), (c + c, KEEP_REPEAT if run > 2 else 0.0)])
            else:
                ways = SIGNS.get(c, {"": 1.0})
                out += [[(w, math.log(p)) for w, p in ways.items()]] * run
            k += run
        return out

    def _viterbi(self, token: str) -> str:
        model = self.model
        best = {(0, 0): (0.0, "")}
        for choices in self._choices(token):
            now: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, text) in best.items():
                for letters, cost in choices:
                    x, y, s = a, b, score + cost
                    for letter in letters:
                        c = int(_TABLE[ord(letter)]) if ord(letter) < len(_TABLE) else 27
                        s += model[x][y][c]
                        x, y = y, c
                    if (x, y) not in now or now[x, y][0] < s:
                        now[x, y] = (s, text + letters)
            best = now
        # the end of the word counts too
        return max((s + model[a][b][0], t) for (a, b), (s, t) in best.items())[1]


#: Signs that are punctuation at the ends of a token.
_OUTER = ".,;:?\"')[]{}"
_WORD = re.compile(r"[^\W\d_]+")
_APART = re.compile(r"[\s.\-_]+")


def _features(text: str, decoder: Decoder) -> set[str]:
    """Words and word beginnings of a text and of its restored tokens."""
    low = text.lower()
    words = set(_WORD.findall(low))
    for token in set(low.split()):
        words.update(decoder.readings(token))
    for run in decoder.spaced.finditer(low):
        words.add(decoder.word(_APART.sub("", run[0])))
    return words


#: Lengths of the word beginnings that are features.
BEGINNINGS = range(_SHORTEST, 11)


def _expanded(words: set[str]) -> set[str]:
    return words | {f"^{w[:n]}" for w in words for n in BEGINNINGS if len(w) >= n}


def _counted(model: np.ndarray):
    """(toxic, text) to (feature, in toxic, in all): partial document counts."""
    def run(batches):
        decoder, counts = Decoder(model), {}
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in _expanded(_features(text or "", decoder)):
                    x = counts.setdefault(f, [0, 0])
                    x[0] += toxic
                    x[1] += 1
            if len(counts) > 500_000:
                yield _count_batch(counts)
                counts = {}
        if counts:
            yield _count_batch(counts)

    return run


def _count_batch(counts: dict[str, list[int]]) -> pa.RecordBatch:
    toxic, every = zip(*counts.values(), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(toxic, pa.int64()), pa.array(every, pa.int64())], ["feature", "toxic", "every"])


def crc_third(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3


@dataclass
class Model:
    letters: np.ndarray
    weights: dict[str, float]
    slope: float
    offset: float
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def decoder(self) -> Decoder:
        return of_worker(("decoder", self.name), lambda: Decoder(self.letters, {f.removeprefix("^")[:_SHORTEST] for f in self.weights}))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """The letter model of all ``docs``, and word weights from labelled rows that are not held out.

    The labelled rows are a sample of ``train_rows`` by hash, so its ids are small enough to
    broadcast.  Conflicting labels of one id count as toxic; null labels and ids are left out.
    """
    letters = letter_model(docs)
    usable = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = usable.where(crc_third(F.col("doc_id")) != 1)
    sample = usable.orderBy(F.xxhash64(F.lit(settings.seed), "doc_id"), "doc_id").limit(settings.train_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample.withColumnRenamed("doc_id", "l_id")), F.col("doc_id") == F.col("l_id"))
    # one row for each sampled id, however many rows have it
    rows = written(rows.groupBy("l_id").agg(F.max("toxic").cast("long").alias("toxic"), F.min("text").alias("text")).select("toxic", "text"), "toxicity-sample")
    n_toxic, n = rows.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    if not n or not n_toxic or n_toxic == n:
        return Model(letters, {}, 0.0, math.log(((n_toxic or 0) + 0.5) / ((n or 0) - (n_toxic or 0) + 0.5)))
    counts = rows.mapInArrow(_counted(letters), "feature string, toxic long, every long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("every").alias("every"))
    base = n_toxic / n
    share = F.col("toxic") / F.col("every")
    evidence = F.col("toxic") * F.log(share / base) + F.when(share < 1, (F.col("every") - F.col("toxic")) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    # far fewer features than training rows can reach this much evidence; the share of toxic rows bounds their number
    chosen = counts.where(share >= F.greatest(F.lit(settings.least_share), F.lit(base))).where(evidence >= settings.least_evidence).collect()
    weights = {r["feature"]: math.log((r["toxic"] + 0.5) / (n_toxic + 1)) - math.log((r["every"] - r["toxic"] + 0.5) / (n - n_toxic + 1)) for r in chosen}
    model = Model(letters, weights, 1.0, 0.0)
    sums = rows.mapInArrow(_summed(model, 1), "toxic long, evidence double").collect()
    y, x = np.array([r[0] for r in sums], float), np.array([r[1] for r in sums])
    model.slope, model.offset = _logistic(x, y)
    return model


#: Keeps the fit finite where the evidence separates the classes; more of it would blur the boundary.
LEAST_SHRINKAGE = 0.002


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a lightly regularised logistic fit, by Newton steps that never make it worse."""
    design, beta = np.column_stack([x / ENOUGH, np.ones_like(x)]), np.zeros(2)

    def loss(b: np.ndarray) -> float:
        z = design @ b
        return float(np.sum(np.logaddexp(0.0, z) - y * z) + LEAST_SHRINKAGE / 2 * b @ b)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        grad = design.T @ (y - p) - LEAST_SHRINKAGE * beta
        hess = (design * (p * (1 - p))[:, None]).T @ design + LEAST_SHRINKAGE * np.eye(2)
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-9 and loss(beta + size * step) > loss(beta):
            size /= 2
        beta = beta + size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return float(beta[0] / ENOUGH), float(beta[1])


#: Evidence beyond this adds nothing: a few mislabelled documents with very much of it would tilt the fit.
ENOUGH = 10.0


def _evidence(text: str, decoder: Decoder, weights: dict[str, float]) -> float:
    """The sum over words of the largest weight of the word and its beginnings, flattened for large sums."""
    total, openings = 0.0, decoder.openings
    for w in _features(text, decoder):
        if w[:_SHORTEST] in openings:
            total += max((weights[f] for f in (w, *(f"^{w[:n]}" for n in BEGINNINGS)) if f in weights), default=0.0)
    return min(total, ENOUGH)


def _summed(model: Model, text_at: int):
    """Batches with a text column to their first columns and the evidence."""
    def run(batches):
        decoder = model.decoder()
        for batch in batches:
            sums = [_evidence(t or "", decoder, model.weights) for t in batch.column(text_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:text_at], pa.array(sums, pa.float64())], [*batch.schema.names[:text_at], "evidence"])

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: doc_id and score, from the text alone.

    Null and empty texts have no evidence and get the score of that.  Every row is scored for
    itself, so repeated ids and rows do no harm; an empty table gives no rows.
    """
    sums = docs.select("doc_id", "text").mapInArrow(_summed(model, 1), "doc_id long, evidence double")
    return sums.select("doc_id", (1 / (1 + F.exp(-(F.col("evidence") * model.slope + model.offset)))).alias("score"))


def predicted(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted; a null id is not held out."""
    rows = scored(docs, train(docs, labels, settings))
    held_out = F.coalesce(crc_third(F.col("doc_id")) == 1, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= settings.threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below the threshold."""
    model = train(docs, labels, settings)
    at = docs.columns.index("text")

    def run(batches):
        decoder = model.decoder()
        for batch in batches:
            sums = np.array([_evidence(t or "", decoder, model.weights) for t in batch.column(at).to_pylist()])
            score = 1 / (1 + np.exp(-(sums * model.slope + model.offset)))
            yield batch.filter(pa.array(score < settings.threshold))

    return docs.mapInArrow(run, docs.schema)


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redpen.llm.common import table

    return predicted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
