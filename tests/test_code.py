"""Operators beyond SQL: against brute force, published values and round trips."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from anchorite.functions.text import jaro_winkler, likeness, long_entities, stem, stem_of
from anchorite.functions import titles
from anchorite.operators.relations import choose, link_jointly
from anchorite.operators.spans import claim, resolve_overlaps
from anchorite.sources import files


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("nationalization", "nation"), ("hopeful", "hope"), ("adoption", "adopt"), ("controll", "control"), ("be", "be"), ("", "")])
def test_stems(word, want):
    assert stem(word) == want


def test_likeness_of_published_pairs(spark):
    assert round(jaro_winkler("MARTHA", "MARHTA"), 4) == 0.9611
    assert round(jaro_winkler("DIXON", "DICKSONX"), 4) == 0.8133
    assert round(jaro_winkler("DWAYNE", "DUANE"), 4) == 0.84
    assert jaro_winkler("", "a") == 0.0 and jaro_winkler("", "") == 1.0
    rows = spark.createDataFrame([("a", "a"), (None, "a"), ("ab", None)], "a string, b string").select(likeness("a", "b").alias("x"), stem_of("a").alias("s")).collect()
    assert [r.x for r in rows] == [1.0, None, None] and [r.s for r in rows] == ["a", None, "ab"]


@pytest.mark.parametrize(("text", "want"), [
    ("He is President of the United Kingdom now", ["President of the United Kingdom", "United Kingdom"]),
    ("in Washington, D.C. today", ["Washington, D.C."]),
    ("Milosevic's Socialist Party won", ["Milosevic's Socialist Party", "Socialist Party"]),
    ("no capitals", []), ("", []), ("One", []),
])
def test_long_entities(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(long_entities(F.col("t")).alias("e")).first().e == want


def test_overlaps(spark):
    rng = random.Random(3)
    for _ in range(30):
        spans = pd.DataFrame([(i, s, s + rng.randint(1, 4)) for i, s in enumerate(rng.choices(range(12), k=8))], columns=["mention_id", "start", "end"])
        got, order = claim(spans), sorted(spans.itertuples(index=False), key=lambda r: (r.start - r.end, r.start, r.mention_id))
        kept = []
        for r in order:
            if all(r.end <= k.start or k.end <= r.start for k in kept):
                kept.append(r)
        assert set(spans.mention_id[got]) == {k.mention_id for k in kept}
    rows = spark.createDataFrame([(1, 0, 0, 2, "A"), (1, 1, 1, 2, "B"), (1, 2, 5, 8, None), (1, 3, 6, 7, "C"), (2, 0, 1, 2, "B")], "doc_id long, mention_id long, start long, end long, title string")
    assert sorted((r.doc_id, r.mention_id, r.title) for r in resolve_overlaps(rows).collect()) == [(1, 0, "A"), (1, 1, None), (1, 2, None), (1, 3, None), (2, 0, "B")]
    assert resolve_overlaps(rows.limit(0)).count() == 0


def test_joint_choice_against_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        scores = {m: [round(rng.uniform(-0.5, 2), 3) for _ in range(rng.randint(1, 3))] for m in range(5)}
        relations = []
        for _ in range(rng.randint(0, 7)):
            a, b = rng.choices(range(5), k=2)
            relations.append((a, rng.randrange(len(scores[a])), b, rng.randrange(len(scores[b])), round(rng.uniform(-1, 2), 3)))

        def value(pick):
            return sum(scores[m][c] for m, c in pick.items() if c is not None) + sum(w for a, i, b, j, w in relations if pick[a] == i and pick[b] == j)

        best = max(value(dict(enumerate(p))) for p in itertools.product(*([None, *range(len(scores[m]))] for m in range(5))))
        assert value(choose(scores, relations)) == pytest.approx(best)


def test_joint_linking(spark):
    cands = spark.createDataFrame([(1, 0, "Nick_Saban", 1.8378), (1, 1, "Saban_Entertainment", 1.0932), (1, 1, "Saban_of_Baekje", 0.036), (1, 1, "Nick_Saban", 0.0), (2, 0, "X", 0.4), (2, 0, "Y", 0.6), (3, 0, "Z", -1.0)], "doc_id long, mention_id long, title string, score double")
    relations = spark.createDataFrame([(1, 0, "Nick_Saban", 1, "Nick_Saban", 1.1), (1, 0, "Unknown", 1, "Nick_Saban", 9.0)], "doc_id long, m1 long, t1 string, m2 long, t2 string, weight double")
    got = {(r.doc_id, r.mention_id): r.title for r in link_jointly(cands, relations).collect()}
    assert got == {(1, 0): "Nick_Saban", (1, 1): "Nick_Saban", (2, 0): "Y", (3, 0): None}


def test_files(spark, tmp_path):
    links = spark.createDataFrame([("Saban", 3, 5, "Nick_Saban"), ("a < b", 10, 5, None)], "surface string, char_start int, char_len int, title string")
    files.write_gold(links, str(tmp_path / "gold"))
    got = files.read_gold(spark, str(tmp_path / "gold")).drop("path")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, links.collect()))

    (tmp_path / "t.ttl").write_text('# <http://x/A> <http://x/p> <http://x/B> .\n<http://x/A> <http://x/p> <http://x/B> .\n<http://x/A> <http://x/id> "12"^^<http://x/int> .\nshort line .\n')
    assert sorted(map(tuple, files.read_triples(spark, str(tmp_path / "t.ttl")).collect())) == [("A", "id", "12"), ("A", "p", "B")]

    (tmp_path / "dump.xml").write_text('<w><page><title>A b</title><id>7</id></page><page><title>C</title><id>8</id><redirect title="A b" /></page></w>')
    assert sorted(map(tuple, files.read_dump(spark, str(tmp_path / "dump.xml")).collect())) == [(7, "A b", None), (8, "C", "A b")]

    (tmp_path / "pred.txt").write_text("f1\tT|0.5|s\tbroken\nf2\n")
    assert list(map(tuple, files.read_predictions(spark, str(tmp_path / "pred.txt")).collect())) == [("f1", "T", 0.5, "s")]

    texts = tmp_path / "texts"
    texts.mkdir()
    (texts / "a.txt").write_text("it�s\nso")
    (texts / "b.txt~").write_text("no")
    assert [r.text for r in files.read_texts(spark, str(texts)).collect()] == ["it's\nso"]


def test_title_parts(spark):
    rows = {"National_Party_(UK,_1976)": "UK", "Chicago,_Illinois": "Illinois", "List_of_Atlas_Shrugged_characters": "Atlas_Shrugged", "Duke_of_York": "York", "Plain": None, "Year_(1976)": None, "": None}
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", F.expr(titles.secondary("t")).alias("s")).collect()
    assert {r.t: r.s for r in got} == rows
    rows = {"Supreme Court in Florida": "Court", "Chicago_(Font)": "Chicago", "Amgen Inc.": "Inc.", "": ""}
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", F.expr(titles.head("t")).alias("h")).collect()
    assert {r.t: r.h for r in got} == rows
