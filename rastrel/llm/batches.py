"""Arrow batches in the Python workers: cut to a bounded size, read, and passed on with added columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 6 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about `most` bytes; a longer text comes alone and whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
            upto = max(at + 1, upto)
            yield batch.slice(at, upto - at)
            at = upto


def strings(column: pa.Array) -> list:
    """Texts of a column, None for null."""
    return column.to_numpy(zero_copy_only=False).tolist()


def raw(column: pa.Array) -> list:
    """UTF-8 bytes of a column's texts, None for null."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return strings(column.cast(kind))


#: Characters taken off the ends of a word before it is looked up.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”‘’…–—"


def words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words (between ASCII white space) of all texts, the number of each word in order, and where each text's words begin."""
    lists = pc.ascii_split_whitespace(pc.fill_null(column, "").cast(pa.large_string()))
    flat = lists.flatten().dictionary_encode()
    starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    # a text that begins or ends with white space has an empty word there
    index = flat.indices.to_numpy(zero_copy_only=False)
    return flat.dictionary, index, starts


def terms(distinct: pa.Array) -> pa.Array:
    """Words in lower case without the marks at their ends."""
    return pc.utf8_lower(pc.utf8_trim(distinct, characters=MARKS))
