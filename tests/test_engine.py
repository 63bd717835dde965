"""The calls of users: annotate, evaluate, render, train."""

import random

from anchorite import engine
from anchorite.operators import training

SF = "/root/testdata/sf0.001"


def test_evaluate(spark):
    schema = "doc_id long, pos long, title string"
    gold = spark.createDataFrame([(1, 0, "A"), (1, 5, "B"), (1, 9, None)], schema)
    links = spark.createDataFrame([(1, 0, "A"), (1, 7, "C"), (1, 8, None)], schema)
    r = engine.evaluate(links, gold, "doc_id", "pos").first()
    assert tuple(r) == (1, 2, 2, 0.5, 0.5, 0.5)
    assert tuple(engine.evaluate(links.limit(0), gold.limit(0), "doc_id", "pos").first()) == (0, 0, 0, None, None, None)


def test_annotate(spark):
    rows = engine.annotate(spark, SF)
    assert rows.columns == ["doc_id", "pos", "surface", "title"] and rows.count() > 0


def test_html(spark):
    docs = spark.createDataFrame([(1, "a <b> cd ef"), (2, "x & y"), (3, None)], "doc_id long, text string")
    links = spark.createDataFrame([(1, 9, 2, "EF"), (1, 6, 2, "CD"), (1, 0, 1, None)], "doc_id long, char_start int, char_len int, title string")
    got = {r.doc_id: r.html for r in engine.render_html(docs, links).collect()}
    assert got == {1: 'a &lt;b&gt; <a href="CD">cd</a> <a href="EF">ef</a>', 2: "x &amp; y", 3: None}


def test_xml(spark, tmp_path):
    links = spark.createDataFrame([(1, "A & B")], "doc_id long, title string")
    engine.write_xml(links, str(tmp_path / "x"))
    assert spark.read.format("xml").option("rowTag", "Entity").load(str(tmp_path / "x")).first().title == "A & B"


def test_training(spark):
    rng = random.Random(7)
    rows = [(i, rng.uniform(0.1, 4), rng.uniform(-1, 1)) for i in range(300)]
    names = ["a", "b"]
    samples = training.signed(spark.createDataFrame(rows, "id long, a double, b double"), names, "id")
    scale = training.largest(samples, names)
    assert scale["a"] == max(r[1] for r in rows)
    data = training.scaled(samples, scale).cache()
    assert 50 < data.where("label = 1").count() < 250
    model = training.fit(data, names, costs=(0.01, 0.1), folds=2)
    margin = training.score(model, names)
    assert data.where((margin > 0) == (data.label == 1)).count() > 285
