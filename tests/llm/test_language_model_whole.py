"""The language model and its floors come from every labelled row, however many a language has."""

import numpy as np

from lectern.llm import language_id as li

ROWS = 7_000


def labelled(spark):
    rows = [(k, f"row {k * 7919 % 100_003:x} {'xyz'[k % 3]}", "en") for k in range(ROWS)] + [(ROWS, "zwei", "de"), (ROWS + 1, "none", None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)


def test_counts_are_those_of_all_rows(spark):
    rows, frame = labelled(spark)
    model = li.LanguageModel.train(frame)
    assert model.languages == ["de", "en"]
    for k, lang in enumerate(model.languages):
        _, starts = li.code_points([t for _, t, x in rows if x == lang])
        grams = len(li.ORDERS) * (np.diff(starts) - 1).sum()  # the last place of a text begins none
        unseen = li.SMOOTHING / (grams + li.SMOOTHING * li.BUCKETS)  # the share of a bucket without n-grams tells their number
        assert np.isclose(np.exp(np.float64(model.log_probability[:-1, k].min())), unseen, rtol=1e-5)


def test_floors_are_those_of_all_rows(spark):
    rows, frame = labelled(spark)
    learned = li.LanguageModel.learned(frame)
    model = li.LanguageModel.fit(learned).with_floor(learned)
    texts = [t for _, t, x in rows if x == "en"]
    evidence, grams = model.evidence(li.letters_of(texts))
    assert learned.count() == ROWS + 1 and np.isclose(model.floor[1], (evidence[:, 1] / grams).min() - li.FLOOR_MARGIN)
