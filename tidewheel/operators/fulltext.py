"""MATCH ... AGAINST: an inverted index as a DataFrame, scored by term frequency and inverse document frequency."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def words(text):
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_']+"), lambda w: w != "")


def inverted_index(docs: DataFrame, key: str, *columns: str) -> DataFrame:
    """``word``, ``key``, ``tf``: one partial aggregation by (word, key)."""
    w = docs.select(key, F.explode(words(F.concat_ws(" ", *columns))).alias("word"))
    return w.groupBy("word", key).agg(F.count(F.lit(1)).alias("tf"))


def match(docs: DataFrame, key: str, columns: list[str], query: str) -> DataFrame:
    """Rows of ``docs`` with ``score``, that hold a word of ``query``: no shuffle, the words' document counts reach the driver as one row."""
    asked = sorted(set(re.findall(r"[\w']+", query.lower())))
    listed = F.array(*[F.lit(w) for w in asked]) if asked else F.array().cast("array<string>")
    # one pass over the texts: counts of the asked words alone, by word of the query
    own = F.filter(words(F.concat_ws(" ", *columns)), lambda w: F.array_contains(listed, w))
    counted = docs.withColumn("_tf", F.transform(listed, lambda q: F.size(F.filter(own, lambda w: w == q))))
    # its facts are one row: how many rows there are, and how many have each word
    facts = counted.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("_tf")[i] > 0, 1)).alias(f"df{i}") for i in range(len(asked))]).first()
    weight = [math.log10(facts["n"] / facts[f"df{i}"]) ** 2 if facts[f"df{i}"] else 0.0 for i in range(len(asked))]
    score = reduce(lambda a, b: a + b, [F.col("_tf")[i] * F.lit(x) for i, x in enumerate(weight)], F.lit(0.0))
    return counted.where(F.exists("_tf", lambda x: x > 0)).withColumn("score", score).drop("_tf")


def term_hits(text, query: str):
    """How often words of ``query`` occur in ``text``: MATCH as an expression, true if not 0.  ``match`` gives the weighted score."""
    asked = sorted(set(re.findall(r"[\w']+", query.lower())))
    return F.size(F.filter(words(F.coalesce(text, F.lit(""))), lambda w: w.isin(asked))).cast("double")
