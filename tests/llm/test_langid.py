import random

import numpy as np
from pyspark.sql import functions as F

from rastrel.llm import langid

#: Syllables of four made-up languages that bear the codes of two families.
SYLLABLES = {"en": "the ing and ou th er", "de": "sch ein ung ver ich der", "fr": "eau ille ent que les ai", "es": "ción os que las ado el"}


def sentence(rng, lang, n):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(seed, each=60):
    rng = random.Random(seed)
    return [(k * 1000 + i, sentence(rng, lang, rng.randint(8, 60)), lang, 1) for k, lang in enumerate(SYLLABLES) for i in range(each)]


def test_held_out_accuracy_and_cases(spark):
    schema = "doc_id long, text string, lang string, Score int"
    model = langid.train(spark.createDataFrame(corpus(1), schema).select("text", "lang"), sample=200, dims=1024)
    assert model.families == ["germanic", "romance"] and len(model.machines) == 4
    rows = corpus(2, 30) + [(9000, None, "en", 1), (9001, "", "en", 1), (9002, "123 $$ 中。"[:6], None, 1), (9003, "12 34", "en", 1), (None, rows_text := sentence(random.Random(3), "fr", 20), None, 1), (9004, (rows_text + " ") * 3000, None, 1)]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(rows, schema), model, "lang_pred", "sure").collect()}
    right = [got[i]["lang_pred"] == lang for i, _, lang, _ in rows[:120]]
    assert np.mean(right) > 0.97
    assert all(got[i]["lang_pred"] == "und" and got[i]["sure"] == 0 for i in (9000, 9001, 9002, 9003))
    assert got[None]["lang_pred"] == got[9004]["lang_pred"] == "fr" and got[9004]["Score"] == 1
    assert all(0 <= r["sure"] <= 1 for r in got.values())


def test_few_labels(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    model = langid.train(empty)
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert langid.predict(docs, model).first()["lang_pred"] == "und"
    one = langid.train(spark.createDataFrame([("abc abd", "xx"), ("abe abf", "xx"), ("q", None)], "text string, lang string"))
    assert tuple(langid.predict(docs, one).select("lang_pred", "score").first()) == ("xx", 1.0)
    assert langid.predict(docs.where(F.lit(False)), one).count() == 0


def test_trigrams_of_long_texts_are_counted_whole(monkeypatch):
    raw = langid.normal("Ein Haus. Ça va? " * 500)
    whole = langid.features(raw, 512)
    monkeypatch.setattr(langid, "_CHUNK", 97)
    assert np.allclose(langid.features(raw, 512), whole)


def test_separable_classes_are_separated():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(1, 0.3, (50, 8)), rng.normal(-1, 0.3, (90, 8))]).astype(np.float32)
    y = np.array([1.0] * 50 + [-1.0] * 90)
    w, b = langid.svm(x, y)
    assert (np.sign(x @ w + b) == y).all()


def test_copies_do_not_fill_the_sample(spark, monkeypatch):
    """A text with many copies is one of the texts learnt from, and at most `sample` texts are collected."""
    import numpy as np

    from rastrel.llm import langid

    words = {"en": "the house and river with many green hills", "de": "das haus und der fluss mit vielen huegeln"}
    rows = [(f"{words[k]} {chr(97 + i // 26)}{chr(97 + i % 26) * 3}", k) for k in words for i in range(60)] + [("the one copied text of them all", "en")] * 900
    seen, own = [], langid.svm
    monkeypatch.setattr(langid, "svm", lambda x, y: (seen.append(x), own(x, y))[1])
    langid.train(spark.createDataFrame(rows, "text string, lang string"), sample=40)
    assert seen and all(len(np.unique(x, axis=0)) == len(x) <= 40 for x in seen)
    model = langid.train(spark.createDataFrame(rows[-900:] + rows[:10] + rows[60:70], "text string, lang string"), sample=40)
    assert model.langs == ["de", "en"] and seen[-1].shape[0] <= 21
