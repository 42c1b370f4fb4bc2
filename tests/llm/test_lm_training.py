"""The class model's training: every trigram counts by its n, whatever the partitions."""

import numpy as np

from strandline.llm.lm_score import CLASSES, train_classes

RNG = np.random.default_rng(3)


def test_training_weighs_all_trigrams(spark):
    pairs = [(1, 2), (2, 1), (3, 2), (200, 7)]
    wanted = {p: RNG.dirichlet(np.full(6, 1.0)) for p in pairs}
    rows = [((a * CLASSES + b) * CLASSES + 10 + c, int(n)) for (a, b), q in wanted.items() for c, n in enumerate(np.round(q * 50_000)) if n]
    frequency = np.full(CLASSES, 0.5)
    for code, n in rows:
        frequency[code % CLASSES] += n
    frequency /= frequency.sum()
    df = spark.createDataFrame(rows, "code int, n long")
    model = train_classes(df.repartition(7, "code"), frequency)
    other = train_classes(df.repartition(2, "code"), frequency)
    more = train_classes(df.selectExpr("code", "n * 1000 as n"), frequency)
    assert np.allclose(model.flat(), other.flat(), atol=1e-6)
    assert np.allclose(model.table(), more.table(), atol=0.02)
    p = 10.0 ** model.table()
    assert np.allclose(p.sum(1), 1, atol=1e-3)
    for (a, b), q in wanted.items():
        assert np.abs(p[a * CLASSES + b, 10:16] - q).max() < 0.03
    assert train_classes(df.limit(0), frequency).table().shape == (CLASSES * CLASSES, CLASSES)
