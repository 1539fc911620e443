import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rastrel.llm import idcoder, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n,block,top", [(1, 16, 65536), (15, 16, 10), (16, 16, 49408), (1000, 64, 300), (5000, 256, 65536), (3000, 4096, 2)])
def test_blocks_come_back(n, block, top):
    ids = np.random.default_rng(n).integers(0, top, n)
    payloads = idcoder.encode_blocks(ids, block)
    sizes = [min(block, n - i) for i in range(0, n, block)]
    assert (idcoder.decode_blocks(payloads, sizes, block) == ids).all()


def test_blocks_are_independent():
    ids = np.random.default_rng(0).integers(0, 500, 1024)
    payloads = idcoder.encode_blocks(ids, 128)
    for i, p in enumerate(payloads):
        assert p == idcoder.encode_blocks(ids[128 * i : 128 * i + 128], 128)[0]
        assert (idcoder.decode_blocks([p], [128], 128) == ids[128 * i : 128 * i + 128]).all()


def test_blocks_go_in_shares(monkeypatch):
    """Many blocks are coded some at a time, to the same bytes, in working memory that doesn't grow with their number."""
    ids = np.random.default_rng(2).zipf(1.3, 900 * 128 + 5) % 49408
    sizes = [128] * 900 + [5]
    payloads = idcoder.encode_blocks(ids, 128, 49407)
    monkeypatch.setattr(idcoder, "LANES", 100)
    tracemalloc.start()
    assert idcoder.encode_blocks(ids, 128, 49407) == payloads
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 * len(ids)
    assert (idcoder.decode_blocks(payloads, sizes, 128, 49407) == ids).all()


def test_what_is_predictable_is_short():
    rng = np.random.default_rng(1)
    phrase = rng.integers(0, 49408, 20)
    repeated = np.tile(phrase, 100)
    assert sum(map(len, idcoder.encode_blocks(repeated, 2048))) < 0.25 * 2 * len(repeated)
    skewed = rng.zipf(1.5, 4096) % 1000
    assert sum(map(len, idcoder.encode_blocks(skewed, 2048))) < 0.6 * 2 * len(skewed)
    flat = rng.integers(0, 65536, 4096)
    assert sum(map(len, idcoder.encode_blocks(flat, 2048))) < 1.25 * 2 * len(flat)


def test_damage_is_seen():
    ids = np.arange(1000) % 77
    frame = idcoder.encode_frame([5, None, 6], [400, 1, 599], ids, 128)
    doc_ids, counts, back = idcoder.decode_frame(frame)
    assert doc_ids == [5, None, 6] and counts.tolist() == [400, 1, 599] and (back == ids).all()
    for at in (0, 7, 25, 30, len(frame) // 2, len(frame) - 1):
        with pytest.raises(ValueError):
            idcoder.decode_frame(frame[:at] + bytes([frame[at] ^ 1]) + frame[at + 1 :])
    with pytest.raises(ValueError):
        idcoder.decode_frame(frame[:20])


def test_round_trip_through_files(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 80))), 1) for i in rng.sample(range(10_000), 120)]
    rows += [(None, "no id", 1), (20_000, None, 1), (20_001, "", 1), (20_002, "twice b", 1), (20_002, "twice a", 1), (20_003, "long É! " * 4000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Frame int").repartition(5)
    idcoder.write(docs, PATH, str(tmp_path / "ids"), block=64, frame_ids=1000)
    got = [tuple(r) for r in idcoder.read(spark, str(tmp_path / "ids")).drop("ids").collect()]
    tok, start, want = Tokenizer.from_file(PATH), 0, []
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_no_frame_of_a_few_ids(spark, tmp_path):
    """A part's last ids, fewer than a quarter of a frame, are in the frame before; a document of several frames is whole in one."""
    rows = [(i, "ab " * n) for i, n in enumerate([9] * 105 + [5000] + [9] * 3 + [3000, 1])]
    idcoder.write(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), PATH, str(tmp_path / "ids"), block=64, frame_ids=1000)
    frames = spark.read.parquet(str(tmp_path / "ids")).orderBy("part", "seq").collect()
    assert min(f["n_ids"] for f in frames if f["seq"]) >= 250
    by_part = {}
    for f in frames:
        assert f["first"] == by_part.get(f["part"], 0) and f["seq"] == sum(g["part"] == f["part"] and g["seq"] < f["seq"] for g in frames)
        by_part[f["part"]] = f["first"] + f["n_ids"]
    tok = Tokenizer.from_file(PATH)
    got = idcoder.read(spark, str(tmp_path / "ids")).orderBy("start").collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in got] == [(i, len(tok.encode(t, add_special_tokens=False).ids) + 1) for i, t in rows]


def test_ids_stay_behind(spark, tmp_path):
    """Without the column of ids all else is as with it."""
    rows = [(i, "some words " * (i % 7)) for i in range(50)] + [(None, None)]
    idcoder.write(spark.createDataFrame(rows, "doc_id long, text string"), PATH, str(tmp_path / "ids"), block=64, frame_ids=100)
    whole, bare = idcoder.read(spark, str(tmp_path / "ids")), idcoder.read(spark, str(tmp_path / "ids"), with_ids=False)
    assert bare.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] == whole.columns[:4] and whole.columns[4:] == ["ids"]
    assert bare.orderBy("start").collect() == whole.drop("ids").orderBy("start").collect()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["n_tokens"] for r in whole.collect())


def test_empty_table(spark, tmp_path):
    idcoder.write(spark.createDataFrame([], "doc_id long, text string"), PATH, str(tmp_path / "ids"))
    assert idcoder.read(spark, str(tmp_path / "ids")).count() == 0


ADDED = ["hi <|endoftext|> there", "<|startoftext|>", "a<|startoftext|>b", "x <|endoftext|", "<|ENDOFTEXT|>", "<|endoftext|><|endoftext|> ", "<|endof text|>"]


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_librarys(file):
    """Added tokens in a text too, alone, at its ends, across the places where texts are cut, and in long ones."""
    path = public_tokenizers.path(file)
    texts = ADDED + ["Plain text, it's 12.\nNext  line", "", "é" * 80 + "<|endoftext|>", "w " * 5000 + "<|startoftext|> z" + " q" * 5000, "\x1c<|endoftext|>\u00a0 "]
    tok = Tokenizer.from_file(path)  # as it comes
    got = tokens.Encoder(path).batch(texts)
    assert [tokens.as_ids(x).tolist() for x in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    few = tokens.Encoder(path, most=3)  # chunks are forgotten all the time
    assert few.batch(texts) == got and few.batch(texts) == got


def test_pieces_are_made_together_and_once():
    """A batch's new pieces are one call; the next batch's chunks of known pieces need none."""
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder, calls = tokens.Encoder(public_tokenizers.path(name)), []
        make = encoder.pieces.make
        encoder.pieces.make = lambda pieces, make=make: calls.append(len(pieces)) or make(pieces)
        text = "start " + " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400))
        plain = Tokenizer.from_file(public_tokenizers.path(name))
        for t in (text, text.replace(" ", ", "), text.replace(" ", "\nnew ")):
            assert list(tokens.as_ids(encoder.batch([t])[0])) == plain.encode(t, add_special_tokens=False).ids
        assert len(calls) <= 3 and calls[0] > 400 and (len(calls) == 1 or calls[1] <= 2)


def test_memories_have_the_size_asked_for():
    """A larger memory makes words of some batches ago once, a smaller one again; the ids are the same."""
    rng, made = random.Random(3), []
    batches = [" ".join("".join(rng.choice("abcdef") for _ in range(9)) for _ in range(400)) for _ in range(4)]
    for size in ((300, 1 << 20), (5000, 1 << 20), (5000, 1 << 10)):
        encoder = tokens.encoder(PATH, *size)
        assert encoder is tokens.encoder(PATH, *size) is not tokens.encoder(PATH)
        calls, make = [], encoder.chunks.make
        encoder.chunks.make = lambda x, calls=calls, make=make: calls.append(len(x)) or make(x)
        made.append((sum(map(len, [encoder.batch([t])[0] for t in batches * 2])), sum(calls)))
    assert len({n for n, _ in made}) == 1
    assert made[1][1] <= 1600 < 3000 < min(made[0][1], made[2][1])


def test_memory_finds_each_string_again():
    """Strings of all lengths about the longest that the table holds, alike but for one byte or a zero at the end; each is made once, until there are too many."""
    rng = random.Random(5)
    words = {"", "a", "a\0", "é" * 11, "é" * 12, *("x" * n for n in range(40)), *("x" * n + "y" for n in range(40))}
    words |= {"".join(rng.choice("ab\0é") for _ in range(rng.randint(1, 30))) for _ in range(5000)}
    words, calls = sorted(words), []

    def make(values):
        calls.extend(values.to_pylist())
        own = [np.array([*x.encode(), 7], np.uint16) for x in values.to_pylist()]
        return np.array([len(x) for x in own]), np.concatenate(own)

    def check(memory, some):
        sizes, starts, flat = memory.find(pa.array(["cut off", *some], pa.large_string()).slice(1))
        assert [flat[s : s + n].tolist() for s, n in zip(starts, sizes)] == [[*x.encode(), 7] for x in some]

    memory = tokens._Memory(make, 10_000)
    for _ in range(6):
        check(memory, rng.sample(words, 3000))
    check(memory, words)
    assert sorted(calls) == words
    few = tokens._Memory(make, 100)
    for _ in range(6):
        check(few, rng.sample(words, 3000))
