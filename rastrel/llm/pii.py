"""Personal data: patterns for direct identifiers, then information-theoretic sanitisation of the terms that reveal them.

Base: emails, IP addresses, card and phone numbers, leftmost and non-overlapping by kind. A mention protects three entities:
its value, the group the value belongs to (an email's domain, an address's first two parts, a card's issuer, a phone number
without its last four digits), and its kind ("there is a card number here"). A term t (three letters or more, lower case)
within `window` terms of a mention of e counts as seen with it. Over all N documents, with document counts n(e), n(t), n(e, t),

    IC(e) = log2(N / n(e))        PMI(e, t) = log2(N * n(e, t) / (n(e) * n(t)))

and t reveals the share PMI / IC of what e says: 1 if t occurs only near e. At `generalise` of it the term near e is
replaced by a placeholder, at `remove` it goes. A pair counts only if enough shows it, so that a word's one chance meeting
with a number reveals nothing: `support` different texts for a value, `support` different values (which near copies of one
text don't have) for a group or a kind. Terms' spans are added to the base ones, which stay as they are.

The first pass reads every text and writes mentions to the shared folder; pairs are counted by text with its number of
copies. Document counts of terms come from a second pass over all texts, which looks only at terms of supported pairs by
a Bloom filter of fixed size (2**22 bits); a join drops its false positives, so counts are exact.

Defined cases: a null or empty text has no spans and its base digest is that of the empty string; rows with a null doc_id
and repeated rows are documents like any other (each counts in N); texts of any length are read whole; an empty table gives
no rows; other columns, whatever their names, are ignored here and kept by sanitise().
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches, common

KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("term_generalised", "term_removed")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: From the start of a run of digits, whole runs only: what [0-9]+(\.[0-9]+){3} finds first, without its retries.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
_BLOOM_BITS = 1 << 22
_HELD = 300_000  # terms that a task counts before it passes them on


@dataclass(frozen=True)
class Disclosure:
    window: int = 8
    support: int = 3
    generalise: float = 0.5
    remove: float = 0.9


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at + 1):
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                last = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    found = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    if "." in text:
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return found


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def entities(kind: str, value: str) -> tuple[int, int, int]:
    """64-bit names of what a mention protects: its kind, the value's group, the value, whatever its spelling."""
    import xxhash

    value = value.lower() if kind in ("email", "ip") else re.sub(r"[^0-9]", "", value)
    group = {"email": value.rpartition("@")[2], "ip": ".".join(value.split(".")[:2]), "card": value[:6], "phone": value[:-4]}[kind]
    return tuple(xxhash.xxh64_intdigest(f"{kind}:{x}", 42) - (1 << 63) for x in ("kind", f"group:{group}", f"value:{value}"))


def mentions(text: str, spans: list[tuple[str, int, int]], window: int) -> dict[tuple[tuple[int, int, int], str], list[tuple[int, int]]]:
    """(entities, term) -> the term's spans within `window` terms of a mention; terms that touch a base span aren't terms."""
    if not spans:
        return {}
    taken = sorted((s, e) for _, s, e in spans)
    terms, i, reach = [], 0, 0
    for m in _TERM.finditer(text):
        while i < len(taken) and taken[i][0] < m.end():
            reach = max(reach, taken[i][1])
            i += 1
        if m.start() >= reach:
            terms.append((m.start(), m.end()))
    starts = np.array([s for s, _ in terms], np.int64)
    found: dict[tuple[tuple[int, int, int], str], set] = {}
    for kind, s, e in spans:
        name, at = entities(kind, text[s:e]), int(np.searchsorted(starts, s))
        for a, b in terms[max(0, at - window) : at + window]:
            found.setdefault((name, text[a:b].lower()), set()).add((a, b))
    return {k: sorted(v) for k, v in found.items()}


_SPAN = pa.struct([("s", pa.int32()), ("e", pa.int32())])
LEVELS = ("kind", "grp", "value")
_NEAR = pa.list_(pa.struct([*((x, pa.int64()) for x in LEVELS), ("term", pa.string()), ("spans", pa.list_(_SPAN))]))
FOUND = (
    "doc_id long, h1 long, h2 long, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, "
    "near array<struct<kind: long, grp: long, value: long, term: string, spans: array<struct<s: int, e: int>>>>"
)


def _hashes(text):
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")


def find(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """The base spans of every row, and the terms near them."""

    def run(given):
        for batch in batches.slices(given, "text"):
            counts, bases, digests, near = [], [], [], []
            for text in batches.strings(batch.column("text")):
                spans = base_spans(text or "")
                by_kind = Counter(k for k, _, _ in spans)
                counts.append([by_kind[k] for k in KINDS])
                bases.append(joined(spans))
                digests.append(hashlib.sha256(bases[-1].encode()).hexdigest())
                near.append([dict(zip(LEVELS, n)) | {"term": t, "spans": [{"s": a, "e": b} for a, b in at]} for (n, t), at in mentions(text or "", spans, rule.window).items()])
            columns = [batch.column(c) for c in ("doc_id", "h1", "h2")]
            columns += [pa.array(c, pa.int64()) for c in zip(*counts)]
            columns += [pa.array(bases, pa.string()), pa.array(digests, pa.string()), pa.array(near, _NEAR)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in FOUND.split(", n")[0].split(", ")] + ["n_email", "n_ip", "n_card", "n_phone", "base", "base_sha256", "near"])

    text = docs["text"].cast("string")
    cut = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), *_hashes(text))
    return cut.mapInArrow(run, FOUND)


def _bloom(terms: DataFrame) -> np.ndarray:
    """A bit for each term's hash; 128 rows of 4 KB reach the driver at most."""
    at = (F.xxhash64("term").bitwiseAND(_BLOOM_BITS - 1) + 1).alias("at")  # bucket b, position p: the value 32768 * (b - 1) + p + 1
    rows = terms.select(at).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    bits = np.zeros(_BLOOM_BITS, np.uint8)
    for r in rows:
        bits[32768 * (r["bucket"] - 1) :][:32768] = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
    return np.packbits(bits)


def _counted(docs: DataFrame, bloom: np.ndarray) -> DataFrame:
    """term, n: the documents that hold each term that the filter lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom.tobytes())

    def run(given):
        import xxhash

        bits = np.unpackbits(np.frombuffer(shared.value, np.uint8))
        slot = lambda t: xxhash.xxh64_intdigest(t, 42) & (_BLOOM_BITS - 1)
        count: Counter = Counter()

        def rows():
            kept = [(t, n) for t, n in count.items() if bits[slot(t)]]
            count.clear()
            return pa.RecordBatch.from_arrays([pa.array([t for t, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["term", "n"])

        for batch in batches.slices(given, "text"):
            for text in batches.strings(batch.column("text")):
                if text:
                    count.update(set(map(str.lower, set(_TERM.findall(text)))))
                    if len(count) > _HELD:
                        yield rows()
        yield rows()

    seen = docs.select(docs["text"].cast("string").alias("text")).mapInArrow(run, "term string, n long")
    return seen.groupBy("term").agg(F.sum("n").alias("n_term"))


def disclosing(docs: DataFrame, found: DataFrame, rule: Disclosure = Disclosure()) -> tuple[DataFrame, DataFrame]:
    """(texts, pairs): each distinct text with mentions and its copies; entity, term, share and kind of the pairs that disclose."""
    texts = found.where(F.size("near") > 0).groupBy("h1", "h2").agg(F.first("near").alias("near"), F.count("*").alias("copies"))
    texts = common.table(texts, "texts")
    n = found.count()
    once = lambda make: F.explode(F.array_distinct(F.flatten(F.transform("near", lambda x: F.array(*(make(x, i) for i in LEVELS))))))
    counted = texts.select("copies", once(lambda x, i: x[i]).alias("entity")).groupBy("entity").agg(F.sum("copies").alias("n_entity"))
    pairs = texts.select("copies", once(lambda x, i: F.struct(x[i].alias("entity"), x["term"].alias("term"))).alias("x"))
    pairs = pairs.groupBy("x.entity", "x.term").agg(F.sum("copies").alias("n_pair"))
    by = {"kind": "value", "grp": "value", "value": None}  # what there must be enough of: values, or texts
    witness = lambda x, i: F.struct(x[i].alias("entity"), x["term"].alias("term"), (x[by[i]] if by[i] else F.col("h1")).alias("by"))
    shown = texts.select(once(witness).alias("x")).select("x.*").distinct().groupBy("entity", "term").agg(F.count("*").alias("shown"))
    pairs = pairs.join(shown.where(F.col("shown") >= rule.support).drop("shown"), ["entity", "term"])
    pairs = common.table(pairs.join(counted, "entity"), "pairs")
    counts = _counted(docs, _bloom(pairs.select("term").distinct()))
    ic = F.log2(F.lit(float(n)) / F.col("n_entity"))
    pmi = F.log2(F.lit(float(n)) * F.col("n_pair") / (F.col("n_entity") * F.col("n_term")))
    told = pairs.where(F.col("n_entity") < n).join(counts, "term").withColumn("share", pmi / ic).where(F.col("share") >= rule.generalise)
    kind = F.when(F.col("share") >= rule.remove, F.lit(TERM_KINDS[1])).otherwise(F.lit(TERM_KINDS[0]))
    return texts, common.table(told.select("entity", "term", "share", kind.alias("kind")), "disclosing")


def term_spans(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """h1, h2, terms (array of kind, s, e by kind and start) of each text in which a term discloses; removal wins."""
    near = texts.select("h1", "h2", F.explode("near").alias("x")).select("h1", "h2", F.explode(F.array(*(f"x.{i}" for i in LEVELS))).alias("entity"), "x.term", "x.spans")
    hit = near.join(pairs, ["entity", "term"]).select("h1", "h2", "kind", F.explode("spans").alias("at"))
    once = hit.groupBy("h1", "h2", "at").agg(F.max("kind").alias("kind"))
    packed = F.sort_array(F.collect_list(F.struct("kind", "at.s", "at.e")))
    return once.groupBy("h1", "h2").agg(packed.alias("terms"))


def detect(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """doc_id, h1, h2, counts of the base kinds, base, base_sha256, terms, spans (base, then terms) of every row."""
    found = common.table(find(docs, rule), "found")
    texts, pairs = disclosing(docs, found, rule)
    added = common.table(term_spans(texts, pairs), "terms")
    rows = found.drop("near").join(added, ["h1", "h2"], "left")
    said = F.array_join(F.transform("terms", lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size("terms") > 0, said))
    return rows.withColumn("spans", spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced: a placeholder of its first span's kind, nothing for removed terms."""
    out, at = [], 0
    spans = sorted(spans, key=lambda x: (x[1], -x[2]))
    i = 0
    while i < len(spans):
        kind, start, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][1] < end:
            i += 1
            end = max(end, spans[i][2])
        out += [text[at:start], "" if kind == TERM_KINDS[1] else "[TERM]" if kind == TERM_KINDS[0] else f"[{kind.upper()}]"]
        at, i = end, i + 1
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """The rows with their texts redacted; all other columns as they are."""
    found = common.table(find(docs, rule), "found")
    texts, pairs = disclosing(docs, found, rule)
    a, b, c = common.fresh(docs, "_h1", "_h2", "_terms")
    added = common.table(term_spans(texts, pairs), "terms").select(F.col("h1").alias(a), F.col("h2").alias(b), F.col("terms").alias(c))
    h1, h2 = _hashes(docs["text"].cast("string"))
    marked = docs.withColumn(a, h1).withColumn(b, h2).join(added, [a, b], "left").drop(a, b)
    names = docs.columns
    at = names.index("text")

    def run(given):
        for batch in given:
            new = []
            for text, terms in zip(batches.strings(batch.column("text")), batch.column(c).to_pylist()):
                spans = base_spans(text or "") + [(x["kind"], x["s"], x["e"]) for x in terms or ()]
                new.append(redact(text, spans) if spans else text)
            columns = [batch.column(n) for n in names]
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return marked.select(*names, c).mapInArrow(run, docs.schema)
