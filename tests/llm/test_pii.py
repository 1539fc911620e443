import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from rastrel.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, text):
    digits = [int(c) for c in text if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        odd, even = digits[-1::-2], digits[-2::-2]
        return 13 <= len(digits) <= 19 and (sum(odd) + sum(sum(divmod(2 * d, 10)) for d in even)) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def plain_base(text):
    return [(k, m.start(), m.end()) for k, rule in RULES.items() for m in re.finditer(rule, text) if passes(k, m[0])]


def test_base_spans_equal_the_plain_rules():
    rng = random.Random(4)
    alphabets = ("a.@-é", "019. +-()", "ab@.x1+ \n-", "4111 -")
    fixed = ["x@y.z@w.v", "a@b..c", "1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1.256", "4111 1111 1111 1111", "+1 (068) 555-2748", "٣٤@a.b", "0001.2.3.4", "1" * 500, "a" * 300 + "@b.c"]
    for text in fixed + ["".join(rng.choice(a) for _ in range(rng.randint(0, 60))) for a in alphabets for _ in range(4000)]:
        assert pii.base_spans(text) == plain_base(text), text


def plain_terms(rows, rule):
    """(text) -> spans of terms that disclose, from the definitions."""
    texts = [t or "" for _, t, *_ in rows]
    n_term = Counter(x for t in texts for x in {m.lower() for m in re.findall(r"[^\W\d_]{3,}", t)})
    seen = {t: pii.mentions(t, plain_base(t), rule.window) for t in set(texts)}
    copies, pair, shown, entity = Counter(texts), Counter(), defaultdict(set), Counter()
    for t, near in seen.items():
        for key in {(e, term) for levels, term in near for e in levels}:
            pair[key] += copies[t]
        for e in {e for levels, _ in near for e in levels}:
            entity[e] += copies[t]
        for (kind, group, value), term in near:
            shown[kind, term].add(value)
            shown[group, term].add(value)
            shown[value, term].add(t)
    kinds, n = {}, len(rows)
    for (e, term), c in pair.items():
        if len(shown[e, term]) >= rule.support and entity[e] < n:
            share = math.log2(n * c / (entity[e] * n_term[term])) / math.log2(n / entity[e])
            if share >= rule.generalise:
                kinds[e, term] = pii.TERM_KINDS[share >= rule.remove]
    out = {}
    for t, near in seen.items():
        found = {}
        for (levels, term), at in near.items():
            for span in at:
                for e in levels:
                    if (e, term) in kinds:
                        found[span] = max(found.get(span, ""), kinds[e, term])
        out[t] = sorted((k, *s) for s, k in found.items())
    return out


def corpus():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 6)))
    common = [word() for _ in range(30)]
    text = lambda k: " ".join(rng.choice(common) for _ in range(k))
    rows = [(i, text(40), "x") for i in range(200)]
    rows += [(300 + i, f"{text(6)} Zebulon Quarx mails zeb@quarx.example.com often {text(20)}", "x") for i in range(6)]
    rows += [(400 + i, f"{text(12)} call +1 (068) 555-27{i}8 {text(12)}", "x") for i in range(5)]
    rows += [(700 + i, f"{text(9)} my visa 4111 1111 1111 {n} {text(9)}", "x") for i, n in enumerate((1111, 1129, 1137))]  # cards that differ
    rows += [(710 + i, f"{text(9)} oddity bob@one.example.org {text(9 + i)}", "x") for i in range(2)]  # too few texts, and one value only
    rows += [(500, None, None), (501, "", "x"), (None, "nobody 10.0.0.1", "x"), (300, rows[200][1], "x"), (600, "Zebulon alone, far away", "x"), (601, "é " * 5000 + "a@b.cd", "x")]
    return rows


def test_terms_equal_brute_force(spark):
    rows, rule = corpus(), pii.Disclosure()
    docs = spark.createDataFrame(rows, "doc_id long, text string, H1 string")
    want = plain_terms(rows, rule)
    got = pii.detect(docs, rule).collect()
    flagged = 0
    table = Counter((i, t or "") for i, t, _ in rows)
    found = Counter()
    for r in got:
        for i, t in table:
            base = plain_base(t)
            if i == r["doc_id"] and r["base"] == pii.joined(base) and r["spans"] == pii.joined(base + want[t]):
                assert r["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
                assert [r[f"n_{k}"] for k in RULES] == [sum(s[0] == k for s in base) for k in RULES]
                flagged += bool(want[t])
                found[i, t] += 1
                break
        else:
            pytest.fail(f"no such result: {r}")
    assert sum(found.values()) == len(rows) and flagged >= 14
    words = {t[s:e].lower() for t, spans in want.items() for _, s, e in spans}
    assert {"zebulon", "quarx", "mails", "visa", "call"} <= words and "oddity" not in words  # by value, by kind, by kind
    assert any(k == "term_removed" for s in want.values() for k, *_ in s) or any(k == "term_generalised" for s in want.values() for k, *_ in s)


def test_sanitised_texts(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, _h1 string")
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert len(texts) == len({r[0] for r in rows}) and texts[500] is None and texts[501] == ""
    assert "zeb@" not in texts[301] and "[EMAIL]" in texts[301] and "Quarx" not in texts[301]
    assert "[PHONE]" in texts[400] and texts[600].startswith("Zebulon") and texts[0] == rows[0][1]


def test_redaction_of_overlaps():
    assert pii.redact("ab cd ef", [("card", 0, 5), ("phone", 3, 8)]) == "[CARD]"
    assert pii.redact("x foo y", [("term_removed", 2, 5)]) == "x  y"


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.detect(docs).count() == 0 and pii.sanitise(docs).count() == 0
