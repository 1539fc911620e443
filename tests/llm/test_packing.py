import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from rastrel.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [(1, "Hello world, it's 12 o'clock.\nNew  line\t!", 7), (2, None, 7), (3, "", 7), (None, "none", 7), (1, "again", 7), (4, "Été déjà vu " * 3000, 7), (5, "x" * 5000, 7), (6, "a\x1cb\x85c <|endoftext|> 中文", 7)]


def test_pieces_are_the_ids_in_order(spark):
    found = packing.pack(spark.createDataFrame(ROWS, "doc_id long, text string, Task int"), PATH).collect()
    tok = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for doc_id, text, _ in ROWS:
        want[doc_id].append(tok.encode(text or "", add_special_tokens=False).ids + [0])
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (str(r["doc_id"]), r["doc_tokens"], r["start"])):
        ids = np.frombuffer(r["ids"], "<u2")
        assert r["length"] == len(ids) and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 1024 and r["offset"] == 0
        assert zlib.crc32(ids.astype("<u4").tobytes()) == r["ids_crc32"]
        got[r["doc_id"]] += [] if r["start"] else [[]]
        assert len(got[r["doc_id"]][-1]) == r["start"]
        got[r["doc_id"]][-1] += ids.tolist()
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    ids = [r["sequence_id"] for r in sorted(found, key=lambda r: r["sequence_id"])]
    assert ids == list(range(len(found)))
    lengths = [r["length"] for r in sorted(found, key=lambda r: r["sequence_id"])]
    assert lengths == sorted(lengths)  # a bucket is one range of ids


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_lengths():
    assert packing.piece_lengths(1024 * 2 + 5, 1024) == [1024, 1024, 4, 1]
    assert packing.piece_lengths(1, 1024) == [1]
