"""The pipeline on a small corpus, against a plain version of what each stage decides."""

import random
import shutil

import corpus_pipeline
import public_tokenizers
from rastrel.llm import common, decontam, pii
from tests.llm.test_decontam import forms
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(9)
    parts = {"en": "the ing and ou th er", "de": "sch ein ung ver ich der", "fr": "eau ille ent que les ai"}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = []
    for i in range(90):
        lang = rng.choice(list(parts))
        rows.append([i, text(lang, rng.randint(20, 90)), lang])
    items = [(k, text("en", 30)) for k in range(5)]
    rows += [[100 + k, f"{text('en', 10)} {t} {text('en', 10)}", "en"] for k, t in items]
    rows += [[200 + i, rows[i][1], "en"] for i in range(8)] + [[300, None, "en"], [301, "12 34 !!", "en"], [302, "", None]]
    rows += [[400, text("en", 30) + " mail a.b@cd.example.com now", "en"], [401, text("de", 40) + " 4111 1111 1111 1111 " + text("de", 5), "de"]]
    return [(*r, "s", len(r[1] or "")) for r in rows], items


def test_stages(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = common.documents(spark, str(tmp_path))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "personal_data", "pack"]
    left = {r[0]: r[1] for r in rows if any(c.isalpha() for c in r[1] or "")}
    sets = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.table(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.dtypes == [tuple(x.split()) for x in SCHEMA.replace("long", "bigint").split(", ")]
        sets.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert sets[0] == left
    fp = {i: plain_fingerprint(t) for i, t in left.items()}
    of = plain_components(fp.values())
    first = {min(i for i in fp if of[fp[i]] == c) for c in set(of.values())}
    assert set(sets[1]) == first and not set(sets[1]) & set(range(200, 208))
    dirty = {i for i in sets[1] for _, t in items if f" {' '.join(forms(t))} " in f" {' '.join(forms(left[i]))} "}
    assert set(sets[2]) == set(sets[1]) - dirty and {100, 101, 102, 103, 104} <= dirty
    for i, t in sets[2].items():
        spans = pii.base_spans(t)
        assert (sets[3][i] == t) if not spans else ("[EMAIL]" in sets[3][i] or "[CARD]" in sets[3][i])
    assert {r["n_chars"] == len(r["text"]) for r in docs.collect()} == {True}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sizes = {r["doc_id"]: r["doc_tokens"] for r in packed}
    assert sizes == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in sets[3].items()}
    assert sum(r["length"] for r in packed) == sum(sizes.values())
    shutil.rmtree(tmp_path, ignore_errors=True)
    assert decontam.THRESHOLD == 0.8
