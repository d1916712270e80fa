"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by offsets.

Pre-tokenisation follows the pattern of the public byte-level vocabularies

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

without running a regular expression: every code point gets a class, each class is a
transition function over the scanner's states, and functions compose associatively. A
function that ignores the state before it (all but contraction marks and the letters
after them) is a constant, so the scan at that place is a look at the previous class;
only the few windows that hold a contraction mark are composed.

Null text: no ids, empty bytes. Empty text: the same. Lone surrogates cannot occur in
Arrow strings. Repeated rows: encoded each on its own.
"""

from __future__ import annotations

import base64
import functools
import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices

# Classes of code points.
OTHER, LETTER, DIGIT, BLANK, SPACE, MARK1, MARK2 = range(7)
# States of the scanner after a code point: inside a run of other signs (or after a space
# that such a run may take), not so, owing two or one letters to a contraction, closed.
RUN, FREE, OWES2, OWES1, CLOSED = range(5)
#: STEP[class][state]: the state that follows. Rows are the transition functions.
STEP = np.array([
    [RUN] * 5,  # other
    [FREE, FREE, OWES1, CLOSED, FREE],  # letter
    [FREE] * 5,  # digit
    [FREE] * 5,  # blank
    [RUN] * 5,  # space
    [RUN, OWES1, OWES1, OWES1, OWES1],  # an apostrophe that one letter can complete
    [RUN, OWES2, OWES2, OWES2, OWES2],  # or two
], dtype=np.int8)

# Code points that count as white space in the pattern.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# What may follow the apostrophe of a contraction.
ENDINGS1 = "stmd"
ENDINGS2 = ("re", "ve", "ll")


@functools.cache
def code_classes() -> np.ndarray:
    """Class of every code point, from the categories of Unicode."""
    kinds = np.zeros(0x110000, dtype=np.int8)
    category = unicodedata.category
    for c in range(0x110000):
        k = category(chr(c))[0]
        if k == "L":
            kinds[c] = LETTER
        elif k == "N":
            kinds[c] = DIGIT
    kinds[WHITE] = BLANK
    kinds[0x20] = SPACE
    return kinds


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Composition of transition functions, row by row; associative."""
    return np.take_along_axis(then, first, axis=1)


def slice_starts(text: str) -> np.ndarray:
    """Where the pattern's matches start, as offsets of code points."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    n = len(points)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    kinds = code_classes()[points]
    white = (kinds == BLANK) | (kinds == SPACE)
    group = np.where(white, np.int8(BLANK), kinds)
    cut = np.empty(n, dtype=bool)
    cut[0] = True
    # The constants of the scan: a change of class cuts; a space goes to what follows it;
    # the last of several white spaces stands apart when something follows.
    np.not_equal(group[1:], group[:-1], out=cut[1:])
    cut[1:] &= kinds[:-1] != SPACE
    cut[1:] |= white[1:] & ~white[:-1]
    if n > 2:
        cut[1:-1] |= white[1:-1] & white[:-2] & ~white[2:]
    marks = np.flatnonzero(points == 0x27)
    if len(marks):
        contractions(points, kinds, marks, cut)
    return np.flatnonzero(cut)


def contractions(points: np.ndarray, kinds: np.ndarray, marks: np.ndarray, cut: np.ndarray) -> None:
    """Move cuts around contractions: compose the functions of each apostrophe's window."""
    n = len(points)
    after = np.pad(points, (0, 2))
    a, b = after[marks + 1], after[marks + 2]
    one = np.isin(a, [ord(c) for c in ENDINGS1])
    two = np.zeros(len(marks), dtype=bool)
    for x, y in ENDINGS2:
        two |= (a == ord(x)) & (b == ord(y))
    # All apostrophes up to each mark take part: the state before one may hang on another.
    own = np.where(one, MARK1, np.where(two, MARK2, OTHER)).astype(np.int8)
    before = np.where(marks > 0, kinds[np.maximum(marks - 1, 0)], BLANK)
    # What precedes is either constant, or a letter (free, or closed: alike for a mark), or another apostrophe.
    state = STEP[before, FREE]
    function = np.broadcast_to(state[:, None], (len(marks), 5)).astype(np.int64)
    function = compose(function, STEP[own].astype(np.int64))
    held = function[:, 0]
    for owed, width in ((OWES1, 1), (OWES2, 2)):
        at = marks[held == owed]
        cut[at] = True
        cut[at + 1] = False
        end = at + width + 1
        cut[end[end < n]] = True


class Codec:
    """Encoder and decoder over a rank file (token in base64, rank)."""

    def __init__(self, path: str, cache_size: int = 200_000):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        size = max(self.ranks.values()) + 1
        words = [b""] * size
        for word, rank in self.ranks.items():
            words[rank] = word
        self.lengths = np.array([len(w) for w in words], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        self.cache_size = cache_size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one slice: join the neighbours of least rank until none can be joined."""
        ranks = self.ranks
        whole = ranks.get(word)
        if whole is not None:
            return [whole]
        parts = [word[i : i + 1] for i in range(len(word))]
        if len(parts) > 512:
            return self.merge_long(parts)
        get = ranks.get
        none = 1 << 62
        costs = [get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
        while costs:
            low = min(costs)
            if low == none:
                break
            i = costs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                costs[i - 1] = get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def merge_long(self, parts: list[bytes]) -> list[int]:
        """The same for one long slice, with a heap and links, in n log n."""
        import heapq

        ranks, n = self.ranks, len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if alive[i] else -1
            if j < 0 or parts[i] is not a or parts[j] is not b:
                continue
            parts[i] = a + b
            alive[j] = False
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := ranks.get(parts[x] + parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [ranks[p] for p, keep in zip(parts, alive, strict=True) if keep]

    def word_ids(self, word: str) -> bytes:
        """Ids of a slice as packed int32, through two generations of cache."""
        found = self.old.get(word)
        if found is None:
            found = np.array(self.merge(word.encode()), dtype=np.int32).tobytes()
        if len(word) <= 64:
            if len(self.young) >= self.cache_size:
                self.old, self.young = self.young, {}
            self.young[word] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, int32."""
        starts = slice_starts(text).tolist()
        if not starts:
            return np.zeros(0, dtype=np.int32)
        words = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
        found = list(map(self.young.get, words))
        if None in found:
            word_ids = self.word_ids
            found = [word_ids(w) if f is None else f for f, w in zip(found, words, strict=True)]
        return np.frombuffer(b"".join(found), dtype=np.int32)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset at which each id's bytes end in the text."""
        return np.cumsum(self.lengths[ids])

    def decode(self, ids: np.ndarray, ends: np.ndarray | None = None) -> bytes:
        """Bytes of ids: every id's bytes are copied to the place its offset names."""
        if not len(ids):
            return b""
        ends = self.ends(ids) if ends is None else ends
        lengths = self.lengths[ids]
        shift = self.starts[ids] - (ends - lengths)
        return self.flat[np.repeat(shift, lengths) + np.arange(ends[-1])].tobytes()


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    return Codec(path)


def _plain(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    return df.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("text"))


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0), type=kind))


def round_trip(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", offsets: bool = False) -> DataFrame:
    """Encode each whole text and decode its ids again.

    Returns ``key``, ``ids`` array<int>, ``decoded`` binary and, with ``offsets``, ``ends``
    array<bigint>: where each id ends in the text's bytes. A null text is empty and gives no ids;
    rows are encoded one by one, so repeated rows and ids are no matter and a null key stays null. Other
    columns are left aside; an empty table gives no rows.
    """
    kind = dict(df.dtypes)[key]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(vocabulary)
        ids = [c.encode(t) for t in batch.column(1).to_pylist()]
        ends = [c.ends(i) for i in ids]
        out = {key: batch.column(0), "ids": _lists(ids, pa.int32()), "decoded": pa.array([c.decode(i, e) for i, e in zip(ids, ends, strict=True)], type=pa.binary())}
        if offsets:
            out["ends"] = _lists(ends, pa.int64())
        return pa.RecordBatch.from_pydict(out)

    schema = f"`{key}` {kind}, ids array<int>, decoded binary" + ", ends array<bigint>" * offsets
    return map_slices(_plain(df, [key], text), "text", step, schema, most=2 << 20)


def digests(encoded: DataFrame, key: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of what ``round_trip`` returns, and its columns ``keep``."""
    return encoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *keep,
    )
