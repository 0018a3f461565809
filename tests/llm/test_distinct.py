import random

import corpus_pipeline


def test_one_row_of_each_group(spark):
    rng = random.Random(3)
    text = lambda: [f"w{rng.randrange(5000)}" for _ in range(60)]
    a, b, e = text(), text(), text()
    alone = [" ".join(text()) for _ in range(4)]
    near = lambda base, end: " ".join(base[:59] + [end])
    rows = [
        (1, near(a, "x"), "en"), (None, near(a, "y"), "en"), (None, alone[0], "en"), (None, alone[1], "de"),  # a null id like another, and clean ones
        (5, near(a, "z"), "en"), (5, alone[2], "en"),  # one of two rows of an id is a copy
        (6, near(b, "x"), "en"), (6, near(b, "y"), "en"), (6, near(b, "y"), None), (6, near(b, "y").upper(), "en"),  # near copies under one id
        (None, near(e, "x"), "en"), (None, near(e, "y"), "en"), (None, near(e, "y"), "de"),  # near copies without an id
        (7, alone[3], None), (7, alone[3], None), (8, None, "en"), (8, "", "en"), (None, None, None), (None, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    out = [tuple(r) for r in corpus_pipeline.distinct(spark, df, "").collect()]
    assert len(out) == len(set(out)) and set(out) <= set(rows)
    of = lambda base: [r for r in out if r[1] and r[1].lower().startswith(" ".join(base[:59]))]
    assert of(a) == [rows[0]]
    assert [r[0] for r in of(b)] == [6]
    assert [r[0] for r in of(e)] == [None]
    left = {r for r in rows if not r[1] or r[1] in alone}
    assert set(out) - {*of(a), *of(b), *of(e)} == left
