import random
import re
from collections import Counter

import zstandard

from rastrel.llm import compression as c


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            hit.update(range(i, i + 8))
    lines, dups = text.split("\n"), 0
    for i, line in enumerate(lines):
        dups += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(hit)


def texts():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé#$\x85\x1c") for _ in range(rng.randint(1, 7)))
    out = ["", " \n\t\x0b", "one", "a\na\n\na\n \n ", "w " * 500, " x y z " * 9]
    for _ in range(150):
        few = [word() for _ in range(rng.choice([3, 30, 400]))]
        out.append("".join(rng.choice(few) + rng.choice([" ", " ", "\n", "\t", "  "]) for _ in range(rng.choice([5, 25, 100, 700]))))
    block = " ".join(word() for _ in range(60))
    return out + [f"{block} {' '.join(word() for _ in range(40))} {block}", f"{block}\n" * 3]


def test_base_measures_equal_the_plain_rules():
    for t in texts():
        assert c.base(t.encode()) == plain_base(t), repr(t[:80])


def test_rows(spark):
    limits, all_texts = c.Limits(), [None, *texts()]
    rows = [(i, t, 1) for i, t in enumerate(all_texts)] + [(None, "again", 1), (7, all_texts[7], 1)]
    got = c.judge(spark.createDataFrame(rows, "doc_id long, text string, Ratio int")).collect()
    assert len(got) == len(rows)
    press = zstandard.ZstdCompressor(level=3, write_content_size=False).compress
    by_id = {i: t for i, t, _ in rows}
    for r in got:
        text = by_id[r["doc_id"]] or ""
        words, chars, symbols, dups, repeat = plain_base(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (words, chars, symbols, dups, repeat)
        failed = words < 20 or 100 * repeat > 30 * words
        raw = text.encode()
        assert r["base_failed"] == failed and (r["ratio"] == len(raw) / len(press(raw)) if raw else r["ratio"] is None)
        assert not (failed and r["kept"])
        if not failed:
            low, high = next(b for s, b in reversed(list(zip(limits.starts, limits.bands))) if len(raw) >= s)
            assert r["kept"] == (low <= r["ratio"] <= high and r["n_chunks_out"] <= limits.share * r["n_chunks"])


def test_verdicts():
    rng = random.Random(5)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(1500))
    noise = " ".join("".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(6)) for _ in range(800))
    cycle = " ".join(f"{i} {i} {i}" for i in range(10, 40)) + " "
    judged = {}
    press = zstandard.ZstdCompressor(level=3, write_content_size=False).compress
    for name, t in (("prose", prose), ("table", " ".join(f"row{i % 10} value" for i in range(0, 4000, 7))), ("mixed", prose + " " + "ab cd " * 3000)):
        whole, chunks = c.ratios(t.encode(), c.Limits(), press)
        judged[name] = c.verdict(1000, 0, len(t.encode()), whole, chunks, c.Limits())[1]
    assert judged["prose"] is None and judged["table"] == "repetitive" and judged["mixed"] is not None and noise and cycle
    assert c.verdict(100, 0, 5000, 1.02, [1.0, 1.0], c.Limits())[1] == "incompressible"
    assert c.verdict(100, 0, 9000, 2.0, [1.0, 2.0, 2.0, 2.0], c.Limits())[1] == "chunks"


def test_empty_table(spark):
    assert c.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bands_tell_planted_noise_and_repetition_from_prose():
    """Of each kind of planted text at least 19 of 20 are rejected from 2,000 bytes on, and by chunks inside long prose; of prose none."""
    import base64

    rng, limits = random.Random(1), c.Limits()
    press = zstandard.ZstdCompressor(level=limits.level, write_content_size=False).compress
    parts = "the ing and ou th er tion ent al is of re st en at in on es".split()
    lexicon = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    word = lambda: lexicon[int(3000 * rng.random() ** 2.5)]

    def prose(n):
        out = []
        while sum(map(len, out)) < n:
            out.append(" ".join(word() for _ in range(rng.randint(5, 14))).capitalize() + rng.choice(".,?;"))
        return " ".join(out)[:n].encode()

    def noise(n):
        raw = base64.b64encode(rng.randbytes(n)).decode()[:n]
        return " ".join(raw[i : i + 40] for i in range(0, n, 40)).encode()

    def template(n):
        said = [" ".join(word() for _ in range(5)) for _ in range(6)]
        return " ".join(f"{rng.choice(said)} {word()}" for _ in range(n // 30)).encode()

    def rejected(text):
        n_words, _, _, _, n_repeat = c.base(text)
        return c.verdict(n_words, n_repeat, len(text), *c.ratios(text, limits, press), limits)[1] is not None

    for n in (2000, 8000, 30000):
        assert sum(rejected(prose(n)) for _ in range(20)) == 0
        assert sum(rejected(noise(n)) for _ in range(20)) >= 19 and sum(rejected(template(n)) for _ in range(20)) >= 19
    assert all(rejected(prose(6000) + b" " + make(4000) + b" " + prose(2000)) for make in (noise, template))
