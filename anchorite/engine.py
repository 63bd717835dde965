"""What a user calls: annotate documents, evaluate links, render them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import registry


def annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, surface, title) of all linked mentions of a folder's documents."""
    return registry.run_sql(spark, sf_dir, "SELECT doc_id, pos, surface, link AS title FROM decided WHERE link IS NOT NULL")


def evaluate(links: DataFrame, gold: DataFrame, *keys: str) -> DataFrame:
    """One row of true positives, predictions, gold links, precision, recall and F1; null titles are no links, rates of nothing are null."""
    p = links.where("title IS NOT NULL").select(*keys, "title").distinct().withColumn("p", F.lit(1))
    g = gold.where("title IS NOT NULL").select(*keys, "title").distinct().withColumn("g", F.lit(1))
    n = p.join(g, [*keys, "title"], "full_outer").agg(F.count(F.col("p") + F.col("g")).alias("tp"), F.count("p").alias("predicted"), F.count("g").alias("expected"))
    rate = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    return n.select("*", rate(F.col("tp"), F.col("predicted")).alias("precision"), rate(F.col("tp"), F.col("expected")).alias("recall"), rate(2 * F.col("tp"), F.col("predicted") + F.col("expected")).alias("f1"))


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def render_html(docs: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, html): each text with its links (doc_id, char_start, char_len, title) as anchors; links must not overlap.

    Every group of links is written, the last one too. A document without links keeps its escaped text.
    """
    own = links.where("title IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("char_start", "char_len", "title"))).alias("l"))
    x = docs.select("doc_id", "text").join(own, "doc_id", "left").withColumn("l", F.coalesce("l", F.array().cast("array<struct<char_start:int,char_len:int,title:string>>")))
    end = lambda s: s.char_start + s.char_len
    before = lambda i: F.when(i > 0, end(F.get("l", i - 1))).otherwise(0)
    piece = lambda s, i: F.concat(_escaped(F.substring("text", before(i) + 1, s.char_start - before(i))), F.lit('<a href="'), _escaped(s.title), F.lit('">'), _escaped(F.substring("text", s.char_start + 1, s.char_len)), F.lit("</a>"))
    tail = F.coalesce(end(F.get("l", F.size("l") - 1)), F.lit(0))
    return x.select("doc_id", F.concat(F.array_join(F.transform("l", piece), ""), _escaped(F.substring("text", tail + 1, F.length("text")))).alias("html"))


def write_xml(links: DataFrame, path: str) -> None:
    """Links as entity elements of an XML file."""
    links.write.format("xml").option("rootTag", "Entities").option("rowTag", "Entity").mode("overwrite").save(path)
