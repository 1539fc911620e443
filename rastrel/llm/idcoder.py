"""Token ids in files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

Within a block each different id gets a slot when it is first seen. Three predictions of the next id are mixed: order 0,
the counts of all slots seen so far; order 1, the slot that followed the last id before, with how often this came true;
order 2, the same after the last two ids (hashed). A gate, adaptive and with a context for every pair of confidences, gives
the weights: the probabilities that order 2 is right, that order 1 is, that order 0 must say, or that the id is new to the
block. The mixed frequencies drive a range coder with a 48-bit interval that sheds 16 bits at a time: a step for the gate,
then one among the counts of order 0, or among all ids up to the frame's largest for a new one. Counts of order 0 are
brought up to date at fixed places, whenever the block has grown by half; slots that came since count once.

All state is reset at each block, so blocks are coded side by side: the arrays below have one lane for each block of a
frame and go through the blocks in step. The coder's numbers are whole and below 2**53 in float64, and quotients are taken
low enough that rounding can't show, so any machine decodes what any other encoded.

A frame is a run of whole documents with all it takes to read it alone:

    magic "RIDC" | version u16 | block ids u16 | documents u32 | blocks u32 | ids u64 | largest id u32 | crc32 of all the rest u32
    doc_id i64 each | null mark u8 each | ids u32 each | of each block: ids u32, bytes u32, crc32 of its ids u32 | blocks

all little-endian but the coder's 16-bit digits. write() puts frames, in ascending doc_id order, into a table in the
shared folder by Spark's commit protocol; read() decodes and checks every block and returns the documents.

Defined cases: a null or empty text is the end id alone; null doc_ids come first; rows equal in doc_id are ordered by
text; a document longer than a frame's usual size is one frame; an empty table gives no frames and no rows; other columns of
the documents, whatever their names, are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import batches, common, tokens

BLOCK = 2048
MOST_BLOCK = 1 << 14  # a slot and its confidence share 16 bits
FRAME_IDS = 6 << 20
LANES = 1600  # blocks that go in step; with more, their tables don't fit the processor's cache
REMEMBERED = 600_000, 48 << 20  # chunks and bytes that the tokenizer remembers; the coder's own arrays leave room for them
MAGIC, VERSION = b"RIDC", 2
_HEAD, _CHECK = struct.Struct("<4sHHIIQI"), struct.Struct("<I")

_TOP, _LOW, _DIGIT = 2.0**48, 2.0**32, 2.0**16
_SAFE = 1 - 2.0**-50  # brings a rounded quotient below the true one
_HASH = 11  # bits of an order-2 context
_AGAIN = 2  # order 0 is counted again when a block has grown by one part in so many


def _packed(rows) -> np.ndarray:
    """Four 16-bit numbers in each uint64, the first lowest."""
    return np.array([sum(int(x) << 16 * i for i, x in enumerate(r)) for r in rows], np.uint64)


# cumulative frequencies of the gate: order 2, order 1, order 0, new; each below 2**15
_START = _packed([(8, 16, 64, 112)])[0]
_LEAST = _packed([(1, 2, 3, 4)])[0]
_AFTER = _packed([(24, 24, 24, 24)])[0]  # moved up by as many places as the kind that came
_FULL, _HALF, _OFTEN = np.uint64(1500 << 48), np.uint64(0x7FFF7FFF7FFF7FFF), 64  # every so many steps, what is above is halved
_EACH, _GUARD, _FIRST = _packed([(1, 1, 1, 1)])[0], _packed([(1 << 15,) * 4])[0], _packed([(1 << 15,) * 3])[0]
_PLACE, _TOTAL, _MASK = np.uint64(16), np.uint64(48), np.uint64(0xFFFF)
_ROWS = 24  # steps whose intervals are worked out at once: few enough for the processor's cache


def _turned(rows: np.ndarray, out: np.ndarray) -> np.ndarray:
    """out becomes the transpose of rows, some rows at a time: their columns share the lines of the processor's cache."""
    for i in range(0, len(rows), 32):
        out[:, i : i + 32] = rows[i : i + 32].T
    return out


class _Orders:
    """Orders 2 and 1 (the rows of `at`) and the gate, of all lanes, fresh.

    Tables of lanes hold one slot's or context's entries of all lanes side by side. A lane's own entries would lie whole pages apart
    from the next lane's, and those for the same slots, mostly the first few, drive each other out of the cache.
    """

    def __init__(self, lanes: int, block: int):
        self.lanes, self.lane = lanes, np.arange(lanes)
        self.known = np.zeros((block + (1 << _HASH)) * lanes, np.uint16)  # slot * 4 + confidence
        self.contexts = self.lane + block * lanes
        self.at, self.slots = np.empty((2, lanes), np.int64), np.empty((2, lanes), np.uint16)
        self.held, self.cell, self.bounds = np.empty((2, lanes), np.uint16), np.empty(lanes, np.int64), np.empty(lanes, np.uint64)
        self.gate, self.by_gate = np.full(lanes * 32, _START), self.lane * 32
        self.before, self.ones = np.zeros(lanes, np.uint16), np.ones(lanes, np.uint16)  # minima with a row of ones are quicker than with a single one
        self.step = 0

    def guess(self, last: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Predict the next slots after the last ones, whose entries are at cell; returns the gate's cumulative frequencies, packed."""
        mixed = last * np.uint16(0x9E35)
        mixed += self.before * np.uint16(0x1F7B)
        mixed >>= 2
        mixed &= (1 << _HASH) - 1
        self.before = last
        np.multiply(mixed, self.lanes, out=self.at[0], dtype=np.int64)
        self.at[0] += self.contexts
        self.at[1] = cell
        self.known.take(self.at, out=self.held, mode="clip")
        np.right_shift(self.held, 2, out=self.slots)
        self.sure = self.held & 3
        case = self.sure[0] << 2
        case += self.sure[1]
        case <<= 1
        case += self.slots[0] == self.slots[1]
        np.add(self.by_gate, case, out=self.cell)
        self.gate.take(self.cell, out=self.bounds, mode="clip")
        return self.bounds + _LEAST

    def missed(self, slot: np.ndarray) -> np.ndarray:
        """1 where an order predicted another slot, else 0."""
        return np.minimum(self.slots ^ slot, self.ones)

    def learn(self, place: np.ndarray, slot: np.ndarray, missed: np.ndarray) -> None:
        """place: 16 times which of the gate's four it was; slot: what came. A confidence of 2 or 3 falls by one on a miss, a hit raises it up to 3.

        Here and below no choice is made by np.where(): its loop branches, and these branches can't be foreseen.
        """
        self.gate[self.cell] = self.bounds + (_AFTER << place)
        self.step += 1
        if self.step % _OFTEN == 0:
            full = np.flatnonzero(self.gate > _FULL)
            self.gate[full] = self.gate[full] >> np.uint64(1) & _HALF
        fresh = slot << 2
        fresh |= 1
        held = self.held
        held += np.minimum(3 - self.sure, missed ^ self.ones)
        held -= missed
        self.sure >>= 1
        self.sure ^= 1
        self.sure &= missed
        held ^= (held ^ fresh) & -self.sure  # fresh where a low confidence missed
        self.known[self.at] = held


class _Counts:
    """Order 0 of all lanes: each slot's count up to some place (upper half) and the sum below it, and (decoding) the slot of each unit."""

    def __init__(self, lanes: int, block: int):
        self.lanes, self.lane = lanes, np.arange(lanes)
        self.counts, self.both = np.zeros((block, lanes), np.uint16), np.zeros((block, lanes), np.uint32)
        self.flat = self.both.ravel()
        self.slot, self.by_unit = np.zeros(1, np.uint16), np.zeros(lanes, np.int64)
        self.used, self.units, self.next = np.zeros(lanes, np.uint16), 0, 4
        self.since = np.zeros(lanes, np.int64)  # slots less units

    def again(self, recent: np.ndarray, used: np.ndarray, decoding: bool) -> None:
        """recent: the slots since the last time, a row each step; used: how many slots there are."""
        for i in range(0, len(recent), _ROWS):
            np.add.at(self.counts.ravel(), (recent[i : i + _ROWS] * np.int64(self.lanes) + self.lane).ravel(), np.uint16(1))
        most, self.units, self.used = int(used.max()), self.units + len(recent), used
        counts = self.counts[:most]
        below = self.both[:most]
        np.cumsum(counts[:-1], axis=0, out=below[1:], dtype=np.uint32)
        below[0] = 0
        below |= counts.astype(np.uint32) << 16
        if decoding:
            own = _turned(counts, np.empty(counts.shape[::-1], np.uint16))
            slots = np.broadcast_to(np.arange(most, dtype=np.uint16), own.shape)
            self.slot, self.by_unit = np.repeat(slots.ravel(), own.ravel()), self.lane * self.units
        self.since, self.next = used.astype(np.int64) - self.units, self.units + max(4, self.units // _AGAIN)


def _numbered(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each id and whether it is new to its block, a row each step."""
    lanes, steps = table.shape
    first, back = np.zeros(1 << 16, np.uint16), np.arange(steps, dtype=np.uint16)
    slots, new = np.empty((steps, lanes), np.uint16), np.empty((steps, lanes), bool)
    some, fresh = np.empty((32, steps), np.uint16), np.empty((32, steps), bool)
    for a in range(0, lanes, 32):
        rows = table[a : a + 32].astype(np.int64)
        for i, ids in enumerate(rows):
            first[ids[::-1]] = back[::-1]
            at = first.take(ids)
            np.equal(at, back, out=fresh[i])
            number = np.cumsum(fresh[i], dtype=np.uint16)
            number -= 1
            some[i] = number.take(at)
        slots[:, a : a + 32] = some[: len(rows)].T
        new[:, a : a + 32] = fresh[: len(rows)].T
    return slots, new


def _checked(block: int) -> None:
    if not 0 < block <= MOST_BLOCK:
        raise ValueError(f"a block has 1 to {MOST_BLOCK} ids")


def _at_once(blocks: int) -> int:
    """How many blocks go in step: shares of equal size, of LANES at most."""
    return -(-blocks // max(1, -(-blocks // LANES)))


def encode_blocks(ids: np.ndarray, block: int = BLOCK, largest: int = 0xFFFF) -> list[bytes]:
    """The payload of each block of `block` ids; the last may be shorter. largest: no id is above it."""
    _checked(block)
    at_once = _at_once(-(-len(ids) // block)) * block
    return [p for i in range(0, len(ids), at_once) for p in _encoded(ids[i : i + at_once], block, largest)]


def _encoded(ids: np.ndarray, block: int, largest: int) -> list[bytes]:
    lanes, steps = -(-len(ids) // block), min(block, len(ids))
    table = np.zeros((lanes, steps), np.uint16)
    table.ravel()[: len(ids)] = ids
    slots, new = _numbered(table)
    table = _turned(table, np.empty((steps, lanes), np.uint16))
    orders, counts = _Orders(lanes, block), _Counts(lanes, block)
    low, span, lane, used = np.zeros(lanes), np.full(lanes, _TOP), np.arange(lanes, dtype=np.uint32), np.zeros(lanes, np.int32)
    out, owner, a, done = [], [], 0, 0
    last, cell, ones = np.zeros(lanes, np.uint16), orders.lane, np.ones(lanes, np.uint32)
    while a < steps:  # to the next place where order 0 is counted, or less: what doesn't depend on the step before, for all at once
        z = min(steps, counts.next, a + _ROWS)
        slot, novel = slots[a:z], new[a:z]
        cells = slot * np.int64(lanes)
        cells += orders.lane
        bounds, place = np.empty((2, z - a, lanes), np.uint64)
        kind = novel * np.uint16(3)
        for i in range(z - a):
            bounds[i] = orders.guess(last, cell)
            last, cell = slot[i], cells[i]
            missed = orders.missed(last)
            np.maximum(kind[i], missed[0] * (missed[1] + 1), out=kind[i])
            np.multiply(kind[i], 16, out=place[i], dtype=np.uint64)
            orders.learn(place[i], last, missed)
        below = (bounds << _PLACE >> place & _MASK).view(np.int64)
        width = ((bounds >> place & _MASK).view(np.int64) - below).astype(np.float64)
        under, total = below.astype(np.float64), (bounds >> _TOTAL).view(np.int64).astype(np.float64)
        by_count, came = kind == 2, np.cumsum(novel, axis=0, dtype=np.int32)
        came += used
        since = counts.since.astype(np.int32)
        old, both = by_count & (slot < counts.used), counts.flat.take(cells, mode="clip")
        both *= old
        size = np.maximum(both >> 16, ones).astype(np.float64)
        begin = (slot - since) * (by_count ^ old)
        begin += table[a:z] * novel
        begin += (both & 0xFFFF).view(np.int32)
        whole = (came - since - 1) * by_count
        whole += novel * np.int32(largest)
        whole += 1
        begin, whole = begin.astype(np.float64), whole.astype(np.float64)
        used = came[-1]
        for i in range(z - a):
            step = span / total[i]
            step *= _SAFE
            np.floor(step, out=step)
            low += step * under[i]
            span = step * width[i]
            step = span / whole[i]
            step *= _SAFE
            np.floor(step, out=step)
            low += step * begin[i]
            span = step * size[i]
            some = np.flatnonzero(span < _LOW)
            while len(some):
                part = low.take(some)
                top = np.floor(part / _LOW)
                out.append(top.astype(np.uint32))
                owner.append(lane.take(some))
                low[some] = (part - top * _LOW) * _DIGIT
                part = span.take(some) * _DIGIT
                span[some] = part
                some = some[part < _LOW]
        if z < steps and z == counts.next:
            counts.again(slots[done:z], used.astype(np.uint16), False)
            done = z
        a = z
    for place in (_LOW, _DIGIT, 1.0):
        part = np.floor(low / place)
        out.append(part.astype(np.uint32))
        owner.append(lane)
        low -= part * place
    owners = np.concatenate(owner)
    digits = np.concatenate(out).take(np.argsort(owners.astype(np.uint16) if lanes < 1 << 16 else owners, kind="stable"))
    while len(over := np.flatnonzero(digits >> 16)):  # carries; a lane's first digit has none
        digits[over] &= 0xFFFF
        digits[over - 1] += 1
    ends = np.cumsum(np.bincount(owners, minlength=lanes))
    return [x.tobytes() for x in np.split(digits.astype(">u2"), ends[:-1])]


def decode_blocks(payloads: list[bytes], sizes: list[int], block: int = BLOCK, largest: int = 0xFFFF) -> np.ndarray:
    """The ids of all blocks, in order."""
    _checked(block)
    n = _at_once(len(payloads))
    return np.concatenate([x for i in range(0, len(payloads), n) for x in _decoded(payloads[i : i + n], sizes[i : i + n], block, largest)])


def _decoded(payloads: list[bytes], sizes: list[int], block: int, largest: int) -> list[np.ndarray]:
    lanes, steps = len(payloads), max(sizes)
    rows = np.zeros((lanes, max(map(len, payloads)) // 2 + 4), np.uint16)
    for i, p in enumerate(payloads):
        rows[i, : len(p) // 2] = np.frombuffer(p, ">u2")
    digits = _turned(rows, np.empty(rows.shape[::-1], np.uint16)).ravel()
    orders, counts, lane = _Orders(lanes, block), _Counts(lanes, block), np.arange(lanes)
    span, code, at = np.full(lanes, _TOP), np.zeros(lanes), lane
    for _ in range(3):
        code, at = code * _DIGIT + digits.take(at), at + lanes
    slots, ids = np.empty((steps, lanes), np.uint16), np.zeros((block, lanes), np.uint16)
    whole, choice, own, both = np.ones((4, lanes)), np.zeros((4, lanes), np.uint16), np.empty(lanes, np.uint16), np.empty(lanes, np.uint32)
    ones = np.ones(lanes, np.uint32)
    orders.slots, used, known = choice[:2], choice[3], whole[2]  # known: slots that came since order 0 was counted and all units of before
    known[:], whole[3], done, last, cell = 0, largest + 1, 0, np.zeros(lanes, np.uint16), lane
    for t in range(steps):
        if t == counts.next:
            counts.again(slots[done:t], used.copy(), True)
            known[:], done = t, t
        bounds = orders.guess(last, cell)
        step = span / (bounds >> _TOTAL).view(np.int64)
        step *= _SAFE
        np.floor(step, out=step)
        said = (code / step).astype(np.int64).view(np.uint64) * _EACH
        said |= _GUARD
        said -= bounds
        said &= _FIRST  # a bit for each of the first three bounds that isn't above
        kind = np.bitwise_count(said)
        i = kind * np.int64(lanes)
        i += lane
        place = kind * _PLACE
        under = (bounds << _PLACE >> place & _MASK).view(np.int64)
        code -= step * under
        bounds >>= place
        bounds &= _MASK
        span = step * (bounds.view(np.int64) - under)
        total = whole.take(i)
        step = span / total
        step *= _SAFE
        np.floor(step, out=step)
        total -= 1
        unit = np.minimum(code / step, total).astype(np.int64)
        old = kind == 2
        old &= unit < counts.units
        among = unit * old
        unit -= among
        among += counts.by_unit
        counts.slot.take(among, out=own, mode="clip")
        np.add(unit, counts.since, out=choice[2], casting="unsafe")
        choice[2] ^= (choice[2] ^ own) & -old.astype(np.uint16)
        last = choice.take(i, out=slots[t], mode="clip")
        cell = last * np.int64(lanes)
        cell += lane
        counts.flat.take(cell, out=both, mode="clip")
        both *= old
        code -= step * ((both & 0xFFFF) + unit)
        both >>= 16
        span = step * np.maximum(both, ones)
        some = np.flatnonzero(span < _LOW)
        while len(some):
            here = at.take(some)
            code[some] = code.take(some) * _DIGIT + digits.take(here, mode="clip")
            at[some] = here + lanes
            part = span.take(some) * _DIGIT
            span[some] = part
            some = some[part < _LOW]
        novel = kind == 3
        used += novel
        known += novel
        novel = np.flatnonzero(novel)
        ids.ravel()[cell.take(novel)] = unit.take(novel)
        orders.learn(place, last, orders.missed(last))
    most = int(used.max())
    ids, slots = _turned(ids[:most], np.empty((lanes, most), np.uint16)), _turned(slots, np.empty((lanes, steps), np.uint16))
    return [names.take(own[:n]) for names, own, n in zip(ids, slots, sizes)]


def encode_frame(doc_ids: list, counts: list[int], ids: np.ndarray, block: int = BLOCK) -> bytes:
    """One frame of whole documents."""
    largest = int(ids.max(initial=0))
    payloads = encode_blocks(ids, block, largest) if len(ids) else []
    raw = memoryview(ids.astype("<u4").tobytes())
    parts = [raw[i : i + 4 * block] for i in range(0, len(raw), 4 * block)]
    heads = np.array([(len(x) // 4, len(p), zlib.crc32(x)) for x, p in zip(parts, payloads)], "<u4")
    body = b"".join(
        [
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            bytes(d is None for d in doc_ids),
            np.array(counts, "<u4").tobytes(),
            heads.tobytes(),
            *payloads,
        ]
    )
    head = _HEAD.pack(MAGIC, VERSION, block, len(doc_ids), len(payloads), len(ids), largest)
    return head + _CHECK.pack(zlib.crc32(body, zlib.crc32(head))) + body


def decode_frame(frame: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, counts and ids; raises ValueError where a checksum or a size is wrong."""
    if len(frame) < _HEAD.size + _CHECK.size:
        raise ValueError("a frame is shorter than its head")
    magic, version, block, docs, blocks, total, largest = _HEAD.unpack_from(frame)
    body = memoryview(frame)[_HEAD.size + _CHECK.size :]
    if magic != MAGIC or version != VERSION or zlib.crc32(body, zlib.crc32(frame[: _HEAD.size])) != _CHECK.unpack_from(frame, _HEAD.size)[0]:
        raise ValueError("not a frame, or its checksum is wrong")
    known = np.frombuffer(body, "<i8", docs)
    null = np.frombuffer(body, np.uint8, docs, 8 * docs)
    counts = np.frombuffer(body, "<u4", docs, 9 * docs).astype(np.int64)
    heads = np.frombuffer(body, "<u4", 3 * blocks, 13 * docs).reshape(blocks, 3).astype(np.int64)
    ends = 13 * docs + 12 * blocks + np.cumsum(heads[:, 1])
    payloads = [bytes(body[e - n : e]) for e, n in zip(ends.tolist(), heads[:, 1].tolist())]
    ids = decode_blocks(payloads, heads[:, 0].tolist(), block, largest) if blocks else np.zeros(0, np.uint16)
    at, raw = 0, memoryview(ids.astype("<u4").tobytes())
    for n, _, crc in heads.tolist():
        if zlib.crc32(raw[4 * at : 4 * (at + n)]) != crc:
            raise ValueError(f"the checksum of the block at id {at} is wrong")
        at += n
    if at != total or counts.sum() != total:
        raise ValueError("a frame's sizes don't agree")
    return [None if x else d for d, x in zip(known.tolist(), null.tolist())], counts, ids


FRAMES = "part int, seq long, first long, n_ids long, frame binary"


def write(docs: DataFrame, vocabulary: str, path: str, end_id: int = 2, block: int = BLOCK, frame_ids: int = FRAME_IDS) -> None:
    """Tokenize all documents and write their ids' frames in ascending doc_id order: part by part, seq by seq.

    first is the frame's first id within its part. One exchange by ranges of doc_id; a frame, a quarter of the next and a
    slice of texts are all that a task holds. A rest of less than a quarter joins the frame before it: a frame of a few blocks
    takes as many steps as a full one.
    """

    def run(given):
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        docs_, counts, held, size, cut = [], [], [], 0, None  # cut: documents and ids of the frame that is full
        end = np.array([end_id], "<u2").tobytes()

        def frame(n):
            ids = np.frombuffer(b"".join(held[:n]), "<u2")
            row = (part, seq, first, len(ids), encode_frame(docs_[:n], counts[:n], ids, block))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [x.split()[0] for x in FRAMES.split(", ")])

        for batch in batches.slices(given, "text"):
            texts = [t or "" for t in batches.strings(batch.column("text"))]
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), tokens.encoder(vocabulary, *REMEMBERED).batch(texts)):
                docs_.append(doc_id)
                held.append(raw + end)
                counts.append(len(raw) // 2 + 1)
                size += counts[-1]
                if cut is None and size >= frame_ids:
                    cut = len(docs_), size
                if cut and size >= cut[1] + frame_ids // 4:
                    n, full = cut
                    yield frame(n)
                    docs_, counts, held, seq, first, size = docs_[n:], counts[n:], held[n:], seq + 1, first + full, size - full
                    cut = (len(docs_), size) if size >= frame_ids else None
        if docs_:
            yield frame(len(docs_))

    cut = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    parts = common.text_partitions(docs.sparkSession)
    dealt = cut.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(run, FRAMES).write.options(compression="none", **common.PLAIN_FILES).parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids (little-endian uint32) from the frames.

    Every block is decoded and checked with or without ids; without, they aren't sent from Python to Spark.
    """
    frames = spark.read.schema(FRAMES).parquet(path)
    counted = frames.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = common.offsets(counted, [], "part", "n", "before")
    placed = common.small_join(frames, before, ["part"]).select((F.col("before") + F.col("first")).alias("first"), "frame")

    def run(given):
        for batch in given:
            for first, frame in zip(batch.column("first").to_pylist(), batch.column("frame")):
                doc_ids, counts, ids = decode_frame(frame.as_buffer().to_pybytes())
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                each = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), counts.tolist())]
                crcs = pa.array(map(zlib.crc32, each), pa.int64())
                columns = [pa.array(doc_ids, pa.int64()), pa.array(first + ends - counts), pa.array(counts), crcs]
                if with_ids:
                    columns.append(pa.array(each, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return placed.mapInArrow(run, schema)
