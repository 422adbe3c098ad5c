import pytest

from skein.llm import mixing


@pytest.fixture
def docs(spark):
    rows = [(k, "some words of text " * (1 + k % 37), ["A", " a ", "b", "hot", "hot", "hot"][k % 6]) for k in range(3000)]
    return spark.createDataFrame([*rows, (9001, None, "a"), (9002, "", "a"), (9003, "x", None), (9004, "y", "unlisted")], "doc_id long, text string, source string")


def test_shares(spark, docs):
    weights = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 3), ("hot", 0.1, 1), ("none", 0.1, 4)], "source string, target_share double, max_repeats int")
    mix, shares = mixing.mix_sources(docs, weights)
    rows = mix.collect()
    most = {"a": 2, "b": 3, "hot": 1}
    assert all(1 <= r["copies"] <= most[r["source"]] for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)
    got = {r["source"]: r for r in shares.collect()}
    for source, aim in (("a", 0.5 / 0.9), ("b", 0.3 / 0.9), ("hot", 0.1 / 0.9)):
        assert got[source]["actual_share"] == pytest.approx(aim, abs=0.01)
        assert got[source]["tokens_off"] <= got[source]["most_tokens_off"]
    assert got["none"]["actual_share"] == 0 and got["none"]["have_docs"] == 0
    assert mixing.emit_copies(mix).count() == sum(r["copies"] for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_sources(docs.repartition(7), weights)[0].collect()))


def test_a_total_too_large_stops_at_the_repeats(spark, docs):
    weights = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    mix, _ = mixing.mix_sources(docs, weights, total_tokens=10**12)
    assert {r["copies"] for r in mix.collect()} == {2} and mix.count() == 1000


def test_places_number_each_source(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "SLOT_ROWS", 50)
    from pyspark.sql import functions as F

    sized = docs.where("text is not null and source = 'hot'").select("doc_id", "source", F.length("text").alias("n_tokens")).withColumn("have_docs", F.lit(1500))
    places = sorted(r["_place"] for r in mixing._numbered(sized, "source", "doc_id").collect())
    assert places == list(range(1500))


def test_nothing(spark, docs):
    weights = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    assert mixing.mix_sources(docs.limit(0), weights)[0].count() == 0 and mixing.mix_sources(docs, weights.limit(0))[0].count() == 0


def test_long_texts_are_counted_in_parts(spark, monkeypatch):
    text = ("word and more, " * 500).strip()
    code = mixing._encoding(mixing.read_tokenizer(mixing.TOKENIZERS_DIR, mixing.TOKENIZER))
    monkeypatch.setattr(mixing, "PART_CHARS", 100)
    assert sum(len(code.encode_ordinary(p)) for p in mixing._parts(text)) == len(code.encode_ordinary(text)) and "".join(mixing._parts(text)) == text
    assert mixing._parts("x" * 1000) == ["x" * 1000]
    for odd in ("x" * 250 + " y" * 200, "サーバー" * 80 + " end of it", "a\n" * 300, "  ".join("ab" * 90)):
        assert sum(len(code.encode_ordinary(p)) for p in mixing._parts(odd)) == len(code.encode_ordinary(odd)) and "".join(mixing._parts(odd)) == odd
