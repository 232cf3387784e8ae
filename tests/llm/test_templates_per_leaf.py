"""Leaves hold as many line templates as their lines make."""

import random

from pyspark.sql import functions as F

from quirework.llm import line_templates


def test_any_number_of_templates_in_a_leaf(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    bodies = [[word() for _ in range(7)] for _ in range(12)]
    texts = []
    for i, body in enumerate(bodies):
        for j in range(4 if i < 9 else 2):  # the last three are too rare
            texts.append(" ".join(["server says that", *body[:6], word(), body[6]]))
    texts += ["server says that " + " ".join(word() for _ in range(8)) for _ in range(40)]
    rng.shuffle(texts)
    rows = [(i, t + "\nown " + word()) for i, t in enumerate(texts)]
    got = line_templates.drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").toPandas()
    # one template after the other, in plain Python
    _, dropped = line_templates.recurring(spark.createDataFrame([(t,) for _, t in rows], "text string"))
    keys = {r.m: r.k for r in spark.createDataFrame([(t,) for t in texts], "m string").select("m", F.unhex(F.md5(F.col("m").cast("binary"))).alias("k")).collect()}
    left, gone = sorted(set(texts), key=lambda t: keys[t]), {}
    while left:
        model = left[0].split(" ")
        mates = [t for t in left if sum(a == b for a, b in zip(t.split(" "), model)) >= 0.7 * len(model)]
        if len(mates) >= 3:
            gone |= {keys[t]: keys[left[0]] for t in mates}
        left = [t for t in left if t not in mates]
    assert len(set(gone.values())) == 9
    assert {r.line_key: r.template for r in dropped.collect()} == gone
    assert got.n_dropped.tolist() == [int(keys[t] in gone) for t in texts]
