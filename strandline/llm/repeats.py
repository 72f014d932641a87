"""Removing long passages that stand in more than one place.

Difference-cover anchors: a cover of the residues modulo a period holds, for any
two places, an offset below the period at which both lie on the cover. Short
runs (window - period + 1 words) are hashed only at positions on the cover; two
equal long windows always share such an anchor at the same offset. Anchors that
repeat go back to their documents; windows around them are extended to full
length, hashed, and those that repeat are removed.

Both times the hashes meet in buckets by value, so no table of them is held
anywhere. Words are told apart by 128 bits of XXH3, runs by 93 bits: three
polynomials over prime fields, for which no text is known that brings two
different runs together.
"""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import small_batches, table

WINDOW, PERIOD = 35, 21
#: A difference cover of the residues modulo 21.
COVER = (0, 1, 4, 14, 16)
#: Text bytes that one step of a task works on.
STEP = 4 << 20
#: Windows in a bucket of hashes, at most about.
BUCKET = 2_000_000

#: Primes below 2**31, and a base for each.
_PRIMES, _BASES = (2147483647, 2147483629, 2147483587), (1103515245, 1220703125, 1812433253)
#: Different words that a worker remembers the hashes of.
CACHE = 400_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo a prime below 2**31, remembered."""
    had = _powers.get((base, prime), np.ones(1, "u8"))
    while len(had) < n:
        had = np.concatenate([had, had * np.uint64(pow(base, len(had), prime)) % np.uint64(prime)])
    _powers[base, prime] = had
    return had[:n]


class _Numbers(dict):
    """A number for each different word, and 128 bits of XXH3 for each number."""

    def __init__(self):
        import xxhash

        self.digest, self.data, self.table = xxhash.xxh3_128_digest, bytearray(), np.zeros((0, 2), "<u8")

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.data += self.digest(word)
        return n

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE:
            self.clear()
            self.data, self.table = bytearray(), self.table[:0]
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if len(self.table) < len(self):
            self.table = np.frombuffer(bytes(self.data), "<u8").reshape(-1, 2)
        return self.table[at]


_numbers = None


class Words:
    """Words of some texts: where they stand, and hashes of any run of them."""

    def __init__(self, texts: list[bytes]):
        self.joined = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.joined, "u1")
        space = _SPACE[raw]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        self.raw, self.starts, self.ends = raw, edge[0::2], edge[1::2]
        at = np.cumsum([0] + [len(t) + 1 for t in texts])
        #: First word of each text, and one more.
        self.first = np.searchsorted(self.starts, at)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        #: Place of each word in its text.
        self.place = np.arange(len(self.starts)) - self.first[self.text]
        #: Words from each word to the end of its text, itself included.
        self.left = self.first[self.text + 1] - self.first[self.text] - self.place

    @functools.cached_property
    def wide(self) -> np.ndarray:
        """128 bits for each word: equal for equal words, and else for none that are likely ever met."""
        global _numbers
        _numbers = _numbers if _numbers is not None else _Numbers()
        return _numbers.hashes(self.joined.split())

    @property
    def hash(self) -> np.ndarray:
        return self.wide[:, 0]

    def runs(self, at: np.ndarray, n: int, which: int = 0) -> np.ndarray:
        """Hashes of the n words from each of the words at: 62 bits (0) or 31 others (1).

        Polynomials over three prime fields, each over its own bits of the words' hashes.
        """
        out = np.zeros(len(at), "u8")
        for k in ((0, 1), (2,))[which]:
            prime = np.uint64(_PRIMES[k])
            word = (self.wide[:, k // 2] >> np.uint64(31 * (k % 2))) & np.uint64(0x7FFFFFFF)
            # A step's words are fewer than 2**32, so sums of terms below 2**31 stay exact.
            sums = np.zeros(len(word) + 1, "u8")
            np.cumsum(word % prime * powers(_BASES[k], _PRIMES[k], len(word)) % prime, out=sums[1:])
            back = powers(pow(_BASES[k], -1, _PRIMES[k]), _PRIMES[k], len(word) + 1)
            out = out << np.uint64(31) | (sums[at + n] - sums[at]) % prime * back[at] % prime
        return out.view("i8")


def _steps(batches):
    """Rows of about STEP bytes of text: batch columns before the text, texts."""
    for batch in batches:
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(batch.num_columns - 1).to_pylist()]
        size = np.cumsum([len(t) for t in texts])
        cuts = [0, *(np.flatnonzero(np.diff(size // STEP)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield [batch.column(k).slice(a, b - a) for k in range(batch.num_columns - 1)], texts[a:b]


def _anchors(words: Words, width: int, period: int, cover) -> np.ndarray:
    on = np.zeros(period, bool)
    on[list(cover)] = True
    return np.flatnonzero(on[words.place % period] & (words.left >= width))


def _around(words: Words, anchors: np.ndarray, window: int, period: int) -> np.ndarray:
    """First words of the full windows that hold an anchor, which lies below period words in."""
    n = len(words.starts)
    rise = np.zeros(n + 1, np.int32)
    np.add.at(rise, np.maximum(anchors - period + 1, words.first[words.text[anchors]]), 1)
    np.add.at(rise, anchors + 1, -1)
    return np.flatnonzero((np.cumsum(rise[:n]) > 0) & (words.left >= window))


def _pack(h1, h2, single, doc, place, key1, key2) -> bytes:
    """Runs in order of their documents as bytes: hashes plain, places squeezed."""
    used, at = np.unique(doc, return_inverse=True)
    rest = zlib.compress(b"".join([single.astype("u1").tobytes(), at.astype("<i4").tobytes(), place.astype("<i4").tobytes(), key1[used].tobytes(), key2[used].tobytes()]), 1)
    return struct.pack("<ii", len(h1), len(used)) + h1.tobytes() + h2.tobytes() + rest


def _unpack(data: bytes) -> list[np.ndarray]:
    """h1, h2, single, key1, key2 and place of each run."""
    n, d = struct.unpack_from("<ii", data)
    h1, h2 = np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, "<i4", n, 8 + 8 * n)
    rest = zlib.decompress(data[8 + 12 * n :])
    single, at, place = np.frombuffer(rest, "u1", n), np.frombuffer(rest, "<i4", n, n), np.frombuffer(rest, "<i4", n, 5 * n)
    key1, key2 = np.frombuffer(rest, "<i8", d, 9 * n), np.frombuffer(rest, "<i8", d, 9 * n + 8 * d)
    return [h1, h2, single, key1[at], key2[at], place]


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts by the columns, and which rows of it are a group's first and last."""
    order = np.lexsort(columns[::-1])
    same = np.ones(max(len(order) - 1, 0), bool)
    for c in columns:
        same &= np.diff(c[order]) == 0
    edge = np.ones(1, bool)[: len(order)]
    return order, np.concatenate([edge, ~same]), np.concatenate([~same, edge])


_FOUND = pa.schema([("key1", pa.int64()), ("key2", pa.int64()), ("ranges", pa.binary()), ("places", pa.binary())])
FOUND = "key1 long, key2 long, ranges binary, places binary"


def _marked(n: int, ranges, places) -> np.ndarray:
    """Which of a text's n words the found ranges and places name."""
    out = np.zeros(n, bool)
    for data in ranges or []:
        for first, end in np.frombuffer(data, "<i4").reshape(-1, 2).tolist():
            out[first:end] = True
    for data in places or []:
        out[np.frombuffer(data, "<i4")] = True
    return out


def repeated_runs(texts: DataFrame, width: int, among, buckets: int) -> DataFrame:
    """FOUND: runs of ``width`` words, of those asked about, that are also asked about elsewhere.

    texts: key1, key2 (longs; a text is known by them), more columns, text. ``among``
    gives from Words and the lists of the columns between the first words of the runs
    asked about. ranges holds pairs (first, end) of first words and places single
    ones, as little-endian ints; either may be null, a key has many rows, and runs
    may come more than once.
    """

    def emit(batches):
        """For each bucket of hashes one row with a step's runs, each hash once.

        Runs that repeat within the step are known to; they go out as ranges. So a
        passage that a third of all documents share comes once a step to the task
        that counts it.
        """
        for keys, texts in _steps(batches):
            words = Words(texts)
            at = among(words, [c.to_pylist() for c in keys[2:]])
            h1, h2 = words.runs(at, width, 0), words.runs(at, width, 1).astype("i4")
            order, first, last = _groups(h1, h2)
            twice = np.zeros(len(at), bool)
            twice[order] = ~(first & last)
            out = []
            w = at[twice]
            run = np.concatenate([np.ones(1, bool)[: len(w)], (np.diff(w) > 1) | (np.diff(words.text[w]) > 0)])
            start = w[run]
            pair = np.stack([words.place[start], words.place[start] + np.diff(np.append(np.flatnonzero(run), len(w)))], 1).astype("<i4")
            key1, key2 = (k.to_numpy(zero_copy_only=False).astype("i8") for k in keys[:2])
            for part in np.split(np.arange(len(start)), np.flatnonzero(np.diff(words.text[start])) + 1) if len(start) else []:
                doc = words.text[start[part[0]]]
                out.append(((int(key1[doc]) ^ int(key2[doc])) % buckets, int(key1[doc]), int(key2[doc]), pair[part].tobytes(), None))
            kept = np.sort(order[first])
            to = (h1[kept].view("u8") >> np.uint64(20)) % np.uint64(buckets)
            by = np.argsort(to, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(to[by])) + 1) if len(kept) else []:
                k = kept[part]
                out.append((int(to[part[0]]), None, None, None, _pack(h1[k], h2[k], ~twice[k], words.text[at[k]], words.place[at[k]], key1, key2)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "key1", "key2", "ranges", "runs"])

    def count(parts):
        """Rows for the runs of a bucket that came from two steps; they are single in theirs."""
        h1, h2, single, key1, key2, place = (np.concatenate(c) for c in zip(*map(_unpack, parts), strict=True))
        order, first, last = _groups(h1, h2)
        found = order[~(first & last) & (single[order] == 1)]
        by, first, _ = _groups(key1[found], key2[found])
        found = found[by]
        ends = np.flatnonzero(first)
        lead = found[ends]
        cols = [pa.array(key1[lead]), pa.array(key2[lead]), pa.nulls(len(lead), pa.binary()), pa.array([x.tobytes() for x in np.split(place[found].astype("<i4"), ends[1:])][: len(lead)], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, schema=_FOUND)

    def meet(batches):
        """Rows sorted by bucket: one bucket's runs at a time."""
        held, bucket = [], None
        for batch in batches:
            ranges = batch.filter(batch.column(3).is_valid())
            yield pa.RecordBatch.from_arrays([*(ranges.column(c) for c in (1, 2, 3)), pa.nulls(ranges.num_rows, pa.binary())], schema=_FOUND)
            sent = batch.filter(batch.column(4).is_valid())
            for b, data in zip(sent.column(0).to_pylist(), sent.column(4).to_pylist(), strict=True):
                if held and b != bucket:
                    yield count(held)
                    held = []
                bucket = b
                held.append(data)
        if held:
            yield count(held)

    sent = texts.mapInArrow(emit, "bucket int, key1 long, key2 long, ranges binary, runs binary")
    return sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, FOUND)


def _with(texts: DataFrame, found: DataFrame) -> DataFrame:
    """key1, key2, ranges, places, text of every row of texts, in lists (or null) by its key.

    All joins of a plan that goes through here share one shuffle of the texts.
    """
    by = found.groupBy("key1", "key2").agg(F.collect_list("ranges").alias("ranges"), F.collect_list("places").alias("places"))
    return texts.join(by, ["key1", "key2"], "left").select("key1", "key2", "ranges", "places", "text")


def repeated_windows(keyed: DataFrame, window: int = WINDOW, period: int = PERIOD, cover=COVER) -> DataFrame:
    """FOUND: windows whose words also start somewhere else.

    keyed: key1, key2 (longs, not null), text; a text is known by its keys.
    """
    if not 1 <= period < window:
        raise ValueError("period must be below window")
    width = window - period + 1
    # Words have two bytes at least, the space after them included.
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(96, int(size / 6 / BUCKET))

    def at_cover(words, _):
        return _anchors(words, width, period, cover)

    def around(words, marks):
        n = np.diff(words.first)
        hit = np.concatenate([np.zeros(0, bool), *(_marked(n[k], *m) for k, m in enumerate(zip(*marks, strict=True)))])
        return _around(words, np.flatnonzero(hit), window, period)

    anchors = repeated_runs(keyed, width, at_cover, buckets)
    return repeated_runs(_with(keyed, anchors), window, around, buckets)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, period: int = PERIOD, cover=COVER) -> DataFrame:
    """doc_id, n_words, n_removed and kept (its remaining words joined by one space).

    Every word that lies in a window of ``window`` words whose sequence starts
    anywhere else, in the same document or another, goes; windows are judged on
    the input. Null texts have no words. A row that is repeated repeats its
    windows. Rows are known by doc_id and a hash of the text; a null doc_id counts
    as the least long.
    """
    small_batches(docs.sparkSession)
    least = F.lit(-(1 << 63))
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), least).alias("key1"), F.xxhash64(text_col).alias("key2"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    joined = _with(keyed, repeated_windows(keyed, window, period, cover))

    def run(batches):
        for (ids, _, ranges, places), texts in _steps(batches):
            n_words, n_removed, kept = [], [], []
            for text, pairs, singles in zip(texts, ranges.to_pylist(), places.to_pylist(), strict=True):
                words = text.split()
                n_words.append(len(words))
                starts = _marked(len(words), pairs, singles)
                if starts.any():
                    # A word is covered if a window starts at it or at one of the window - 1 before.
                    total = np.cumsum(starts)
                    gone = total > np.concatenate([np.zeros(window, np.int64), total])[: len(words)]
                    n_removed.append(int(gone.sum()))
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    n_removed.append(0)
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    out = joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
    return out.withColumn("doc_id", F.nullif("doc_id", least))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
