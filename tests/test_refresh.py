"""Incremental refresh: what is read, what is kept, and that totals stay those of a full rebuild."""

import os

import pytest
from pyspark.sql import functions as F

from redpen.operators import learning
from redpen.plans import refresh

TEXTS = {1: "The tested device unit. Stay here now.", 2: "The tested unit. Stay here now. New one.", 3: "The tested unit. Stay here now.", 4: "All new words here."}
PAIRS = [("p1", "f", 1, 2), ("p2", "f", 2, 3), ("p3", "f", 3, 4)]


class Store:
    """Reports with sizes and texts that tests change, refreshed into one folder."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.texts, self.sizes, self.pairs = spark, folder, dict(TEXTS), {d: d for d in TEXTS}, PAIRS
        self.read = []

    def docs(self):
        return self.spark.createDataFrame(list(self.texts.items()), "doc_id long, text string")

    def pair_rows(self):
        return self.spark.createDataFrame(self.pairs, "pair_id string, family string, old_doc long, new_doc long")

    def hashes(self, files):
        def ask(chosen):
            self.read.append(sorted(r.doc_id for r in chosen.collect()))
            return refresh.hashed_rows(files)(chosen)

        return ask

    def refresh(self, **more):
        rows = [(d, self.sizes[d], t.encode()) for d, t in self.texts.items()]
        files = self.spark.createDataFrame(rows, "doc_id long, size long, content binary").withColumn("modified", F.timestamp_seconds("size"))
        build = {"sentences": lambda todo: learning.sentence_counts(self.docs(), todo, per_pair=True)}
        return dict(refresh.refresh(self.spark, self.folder, refresh.pair_stats(self.pair_rows(), files), self.hashes(files), build, **more).collect())

    def agree(self):
        whole = sorted(map(tuple, learning.sentence_counts(self.docs(), self.pair_rows()).collect()))
        assert sorted(map(tuple, refresh.totals(self.spark, self.folder, "sentences").collect())) == whole
        stored = refresh.contributions(self.spark, self.folder, "sentences").select("phrase", "old", "new")
        assert sorted(map(tuple, learning.merge_counts(stored).collect())) == whole
        return True


def test_only_changed_reports_are_read_and_totals_follow(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.refresh() == {"recomputed": 3} and s.agree()
    assert s.refresh() == {"reused_stat": 3}
    s.sizes[4] = 99
    assert s.refresh() == {"reused_stat": 2, "reused_hash": 1}
    s.sizes[4], s.texts[4] = 100, "Other words. Stay here now."
    assert s.refresh() == {"reused_stat": 2, "recomputed": 1} and s.agree()
    s.pairs = PAIRS[:1]
    assert s.refresh() == {"reused_stat": 1, "stale": 2} and s.agree()
    s.pairs = PAIRS
    assert s.refresh() == {"reused_stat": 1, "recomputed": 2} and s.agree()
    assert s.read == [[1, 2, 3, 4], [], [3, 4], [3, 4], [], [2, 3, 4]]
    assert s.refresh(settings={"ngram_max": 4}) == {"recomputed": 3} and s.agree()
    assert s.refresh(settings={"ngram_max": 4}, full=True) == {"recomputed": 3} and s.agree()


def test_generations_are_gathered_and_removed(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    for turn in range(6):
        s.sizes[1 + turn % 4] += 10
        s.texts[1 + turn % 4] += f" Turn {turn} here."
        s.refresh(keep=2)
        assert s.agree()
        for part in ("contributions/sentences", "totals/sentences", "state", "status"):
            assert len([x for x in os.listdir(tmp_path / part) if "=" in x]) <= (5 if part.startswith("contributions") else 2)


def test_a_refresh_that_dies_leaves_the_last_one_in_force(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.refresh()
    before, texts = sorted(map(tuple, refresh.totals(spark, s.folder, "sentences").collect())), dict(s.texts)
    s.texts[1], s.sizes[1] = "Changed. Stay here now.", 50

    def fail(todo):
        raise RuntimeError("lost")

    files = spark.createDataFrame([(d, s.sizes[d], t.encode()) for d, t in s.texts.items()], "doc_id long, size long, content binary").withColumn("modified", F.timestamp_seconds("size"))
    with pytest.raises(RuntimeError):
        refresh.refresh(spark, s.folder, refresh.pair_stats(s.pair_rows(), files), refresh.hashed_rows(files), {"sentences": fail})
    assert sorted(map(tuple, refresh.totals(spark, s.folder, "sentences").collect())) == before and texts != s.texts
    assert s.refresh() == {"reused_stat": 2, "recomputed": 1} and s.agree()


def test_hashes_of_listed_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(refresh, "PATHS", 2)
    for i in range(5):
        (tmp_path / f"r{i}.docx").write_bytes(b"x" * i)
    from redpen.sources import packages

    listed = packages.list_packages(spark, str(tmp_path))
    chosen = listed.filter("file_name <> 'r3.docx'").select("doc_id")
    got = {tuple(r) for r in refresh.hashed_paths(listed)(chosen).collect()}
    assert got == {tuple(r) for r in refresh.hashed(listed.filter("file_name <> 'r3.docx'")).collect()}
    assert refresh.hashed_paths(listed)(chosen.filter("false")).count() == 0
