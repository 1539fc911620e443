"""Every operator on rows that are odd in every column, with columns named like its own, and on empty tables."""

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from rastrel.llm import common, components, compression, decontam, histshard, idcoder, langid, packing, pii, quality, simhash, toxicity

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
NAMES = "score lang_pred _none _id _digest _text_hash h1 h2 near terms spans task place size law shard slot fp least digest y n label _lang _score frame part".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES)
LONG = "the river runs under old stone bridges and " * 3_000


def rows():
    text = "eight of the boats lay by the quay, and nobody mailed me@there.example.org that day"
    given = [(1, text, "en"), (1, text, "en"), (1, "another text under the same id", "en"), (None, text, None), (None, None, None), (2, None, "en"), (3, "", "en"), (4, " \t\n", "de")]
    given += [(5, LONG, "en"), (6, "12 34 !?", None), (7, "\x00\x1c\u00a0\u2028 <|endoftext|> 中文 é", "fr"), (8, "wort " * 40, "de"), (9, "w", "fr"), (-3, text.upper(), "en"), (10, "un mot et un autre mot", "fr")]
    return [(d, t, g, None, None, *(["x"] * len(NAMES))) for d, t, g in given]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 1), (2, 0, 0), (3, 1, 1), (5, 0, 1), (8, None, None), (9, 1, 0), (10, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


def op3(docs, path):
    idcoder.write(docs, WORDS, path)
    return idcoder.read(docs.sparkSession, path)


ITEMS = [(1, "eight of the boats lay by the quay, and nobody"), (1, "stone bridges and the river runs under old"), (None, "w"), (2, None), (3, "")]
OPERATORS = {
    "pii": lambda d, lab, path: pii.detect(d),
    "compression": lambda d, lab, path: compression.judge(d),
    "idcoder": lambda d, lab, path: op3(d, path),
    "toxicity": lambda d, lab, path: toxicity.score(d, lab, F.lit(True)),
    "langid": lambda d, lab, path: langid.predict(d, langid.train(d)),
    "histshard": lambda d, lab, path: histshard.shard(d, 4),
    "simhash": lambda d, lab, path: simhash.near_duplicates(d),
    "quality": lambda d, lab, path: quality.score(d, lab, F.lit(True)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(odd, labels, tmp_path, name):
    got = [r["doc_id"] for r in OPERATORS[name](odd, labels, str(tmp_path / "x")).select("doc_id").collect()]
    assert sorted(got, key=str) == sorted((r[0] for r in rows()), key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows_for_no_rows(odd, labels, tmp_path, name):
    assert OPERATORS[name](odd.limit(0), labels, str(tmp_path / "x")).count() == 0


def test_columns_are_kept(odd, spark):
    assert langid.predict(odd, langid.train(odd)).columns == [*odd.columns, "lang_pred_", "score_"]
    assert pii.sanitise(odd).columns == odd.columns and pii.sanitise(odd).count() == len(rows())
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.clean(odd, items).columns == odd.columns
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(odd, items).collect()} == {(1, 1), (None, 1), (-3, 1), (5, 1)}
    one = simhash.keep_one(odd)
    assert one.columns == odd.columns and {r["text"] for r in one.collect()} <= {r[1] for r in rows()}
    assert sum(r["length"] for r in packing.pack(odd, BYTES).collect()) > 20_000


def test_a_repeated_id_teaches_once(spark):
    docs = spark.createDataFrame([(1, f"text number {i} of one id") for i in range(300)] + [(2, "clean words here"), (3, "nasty words here")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels, F.lit(True)).collect()
    assert len(got) == 302 and max(len(r["nearest"]) for r in got) <= 3  # three examples, whatever their texts


def test_pipeline_stages_on_odd_and_empty_tables(odd, spark, tmp_path):
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd, odd.limit(0), odd.withColumn("lang", F.lit(None).cast("string"))):
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = common.table(stage(spark, docs, str(tmp_path)), name)
            assert name == "pack" or docs.columns == columns
            if name == "language":
                assert not docs.where("text is null or not rlike(text, '\\\\p{L}')").count()


def test_components_of_a_star_a_chain_and_a_ring(spark):
    star = [(0, i) for i in range(1, 400)]
    chain = [(i, i + 1) for i in range(1000, 1040)]
    ring = [(2000 + i, 2000 + (i + 7) % 30) for i in range(30)]
    edges = spark.createDataFrame(star + chain + ring + [(5, 5), (0, 3), (3, 0), (None, 4)], "u long, v long")
    got = {r["u"]: r["v"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 400)} | {i: 1000 for i in range(1001, 1041)} | {2000 + i: 2000 for i in range(1, 30)}


def test_forest_of_a_wide_anchor(monkeypatch):
    """Groups over the limit, with bytes that all share, give the same components as the search of all pairs."""
    rng = np.random.default_rng(3)
    for free in (8, 20, 40):
        values = np.unique(rng.integers(0, 1 << free, 3000 if free > 8 else 200)) << 11
        monkeypatch.setattr(simhash, "WIDE", 1 << 30)
        want = simhash._Union()
        for a, b in simhash._forest(values, 3):
            want.add(a, b)
        monkeypatch.setattr(simhash, "WIDE", 100)
        got = simhash._Union()
        for a, b in simhash._forest(values, 3):
            assert (a ^ b).bit_count() <= 3
            got.add(a, b)
        assert [got.root(int(v)) for v in values] == [want.root(int(v)) for v in values]


def test_the_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://somewhere:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    with pytest.raises(ValueError):
        common.shared_dir(type("Session", (), {"conf": Conf(), "sparkContext": Context()})())
