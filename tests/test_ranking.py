"""Rankers that can be exchanged, and words as a worse scan has them."""

import random

import pytest
from pyspark.sql import functions as F

from kontora.operators import evaluation, ranking


def by_products(queries, wordings, n):
    """The plain way: every stated query against every wording of the catalogue."""
    valid = (F.coalesce(F.col("date") >= F.col("valid_from"), F.lit(True))) & (F.coalesce(F.col("date") < F.col("valid_to"), F.lit(True)))
    against = (F.size("held") > 0) & (F.size("packages") > 0) & ~F.arrays_overlap("held", "packages")
    score = ranking.dot(F.col("query_vec"), F.col("vec")) - F.when(against, 0.1).otherwise(0.0)
    met = queries.join(wordings, valid).select("query_id", "ware_id", score.alias("score"))
    return met.groupBy("query_id", "ware_id").agg(F.max("score").alias("score"))


def test_two_rankers_give_the_same(spark):
    rng = random.Random(2)
    vec = lambda: [rng.gauss(0, 1) for _ in range(8)]
    pack = lambda: rng.choice([[], ["XKG"], ["XCS", "XBO"]])
    queries = spark.createDataFrame([(i, vec(), None, pack()) for i in range(12)], "query_id long, query_vec array<float>, date date, held array<string>")
    wordings = spark.createDataFrame([(f"w{i % 30}", vec(), None, None, pack()) for i in range(90)], "ware_id string, vec array<float>, valid_from date, valid_to date, packages array<string>")
    rows = [sorted((r.query_id, r["rank"], r.ware_id, round(r.score, 9)) for r in ranking.rank_wares(queries, wordings, n=4, ranker=k).collect()) for k in (None, by_products, ranking.by_vectors(block=16))]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 48
    with pytest.raises(ValueError):
        ranking.rank_wares(queries, wordings, ranker=lambda q, w, n: q.select("query_id", F.lit("w").alias("ware_id"), F.lit(1).alias("score")))


def test_worse_scans(spark):
    rows = [(d, r, r * 20 + k, "".join("0158BOIl,"[(r + k + j) % 9] for j in range(2 + (k + r) % 6)), 50 * k, 30 * r, 40, 20) for d in range(6) for r in range(40) for k in range(20)]
    words = spark.createDataFrame(rows, "doc int, row int, ord int, text string, x int, y int, w int, h int")
    got = [sorted(map(tuple, evaluation.augment_words(words, ["doc"], seed).collect())) for seed in (1, 1, 2)]
    assert got[0] == got[1] != got[2]
    n = len(rows)
    same = spark.createDataFrame(rows, words.schema)
    none = evaluation.augment_words(same, ["doc"], drop=0.0, jitter=0.0, confuse=0.0, cut=0.0)
    assert sorted((r.doc, r.ord, r.text, r.x, r.y, r.w, r.h) for r in none.collect()) == sorted((d, o, t, x, y, w, h) for d, _, o, t, x, y, w, h in rows)
    lost = evaluation.augment_words(words, ["doc"], drop=0.1, jitter=0.0, confuse=0.0, cut=0.0).count()
    assert abs((n - lost) / n - 0.1) < 0.02
    cut = evaluation.augment_words(words, ["doc"], drop=0.0, jitter=0.0, confuse=0.0, cut=0.2).collect()
    halves = sum(r.part for r in cut)
    long = sum(len(t) > 3 for _, _, _, t, *_ in rows)
    assert abs(halves / long - 0.2) < 0.03 and "".join(r.text for r in sorted(cut, key=lambda r: (r.doc, r.ord, r.part))) == "".join(t for _, _, _, t, *_ in sorted(rows, key=lambda r: (r[0], r[2])))
    assert len(cut) < n + halves  # some run together
    wrong = evaluation.augment_words(words, ["doc"], drop=0.0, jitter=0.0, confuse=0.3, cut=0.0).collect()
    texts = {(d, o): t for d, _, o, t, *_ in rows}
    changed = sum(r.text != texts[r.doc, r.ord] for r in wrong)
    assert abs(changed / n - 0.3) < 0.04 and all(len(r.text) == len(texts[r.doc, r.ord]) for r in wrong)
