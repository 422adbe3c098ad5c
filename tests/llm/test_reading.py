import numpy as np
import pyarrow as pa
import pytest

from skein.llm import reading

EASY = ["The cat sat down. It was hot. We had tea. The dog ran home.", "I see a boat. It is red. The boat is big. We like it."]
HARD = [
    "Insofar as the heterogeneous replication topology, which in practice remains susceptible to pathological fragmentation, constrains the feasible degree of parallelism, administrators are well advised, notwithstanding apparently satisfactory behaviour, to postpone irreversible consolidation until independent verification has been completed.",
    "Whereas the asynchronous reconciliation of partially committed fragments invalidates the published complexity estimates, a rigorous interpretation of the available telemetry suggests, provided that no compensating mechanism has been configured, that metadata locality deteriorates considerably under sustained concurrency.",
]
PLAIN = ["The backup job stopped after ten minutes because the disk was full. Open the monitor and filter the list by status before you repeat the test.", "The media server keeps the volume reserved until the session ends although the disk was replaced last week."]


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = [], []
    for k in range(240):
        band = k % 3
        text = " ".join([EASY, PLAIN, HARD][band][(k + j) % 2] for j in range(1 + k % 4))
        docs.append((k, text, f"s{k % 7}"))
        labels.append((k, "r1", reading.BANDS[band]))
        labels.append((k, "r2", reading.BANDS[(band + 1) % 3] if k % 17 == 0 else reading.BANDS[band].upper()))
    extra = [(900, None, "s"), (901, "", None), (902, "# Title\n- item\n2024-01-01 10:00:00 [INFO] a rc=1", "s"), (903, EASY[0] * 20_000, "s")]
    return spark.createDataFrame(docs + extra, "doc_id long, text string, source string"), spark.createDataFrame([*labels, (1, "r3", "odd"), (2, "r3", None)], "doc_id long, rater string, band string")


def test_bands(spark, tables):
    docs, labels = tables
    grader = reading.train(docs, labels)
    assert grader.agreement > 0.9 and grader.low < grader.high
    got = {r["doc_id"]: r for r in reading.score(docs.selectExpr("*", "1 AS grade", "2 AS _read"), grader).collect()}
    assert np.mean([got[k]["band"] == reading.BANDS[k % 3] for k in range(240)]) > 0.95
    assert got[900]["band"] is None and got[901]["grade"] is None and got[902]["band"] is None and got[903]["band"] == "basic"
    assert reading.score(docs.limit(0), grader).count() == 0


def test_too_few_labels(tables):
    docs, labels = tables
    with pytest.raises(ValueError):
        reading.train(docs, labels.limit(0))


def test_features_do_not_depend_on_the_batch():
    texts = [*EASY, *HARD, "", None, "한국어 문장입니다. 두 번째 문장은 조금 더 깁니다.", "日本語の文です。二つ目の文です。"]
    whole = reading.feature_matrix(pa.array(texts, pa.string()))
    each = np.concatenate([reading.feature_matrix(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(whole, each)
    x = dict(zip(reading.FEATURES, whole[0]))
    assert x["sentences"] == 4 and x["sent_words_mean"] == pytest.approx(14 / 4)


def test_trees_fit_a_step():
    rng = np.random.default_rng(0)
    x = rng.random((500, 3))
    y = (x[:, 1] > 0.4) * 2.0
    assert np.abs(reading.Trees().fit(x, y).predict(x) - y).mean() < 0.05
    knots, levels = reading._isotonic(np.array([1.0, 2.0, 3.0]), np.array([1.0, 0.0, 2.0]))
    assert list(levels) == [0.5, 2.0] and list(knots) == [2.0, 3.0]
