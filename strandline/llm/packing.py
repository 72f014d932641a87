"""Packing documents into fixed-length training sequences.

Pattern packing: the histogram of piece lengths (at most ``max_tokens`` bins,
whatever the corpus size) is covered by repeats of few-document length patterns
that fill a sequence exactly. Repeat counts are fitted to the histogram by
non-negative least squares and rounded; what rounding leaves over is fitted again
while that places pieces, and the rest is packed best-fit. Pieces of one length are interchangeable, so a piece finds its
place from its rank within its length.
"""

from __future__ import annotations

import bisect
import gc
import json
import os
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import cut, plus, small_batches, table

MAX_TOKENS = 4096
#: Documents in a pattern, and draws of lengths that patterns begin with, at most.
FEW, DRAWS = 8, 2048
#: Sweeps of a fit; times that what rounding leaves is fitted anew, while that places this share.
ROUNDS, STAGES, LITTLE = 12, 10, 0.02
#: Chunks whose ids a worker remembers; bounds its memory.
CACHE = 800_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Fixed value: a pre-tokenizer's pattern that keeps runs of letters apart from runs of symbols.
LETTERS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Symbols that may follow a word, which that pattern encodes apart.
_SYMBOLS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")


class WordPairs:
    """Byte-pair encoding of many words at once: ids as the tokenizer gives them for one pre-tokenized word.

    Words of one length in bytes are the columns of a table of symbols. In each step
    every column merges its pair of least rank, the leftmost of these, and so gets
    shorter by one; a column without such a pair is done.
    """

    #: Bytes of the longest word; words in a table.
    LONGEST, WIDTH = 60, 8192
    _TIMES, _NONE = np.uint32(0x9E3779B1), np.int32(1 << 30)

    def __init__(self, vocab: dict[str, int], merges: list):
        from tokenizers.pre_tokenizers import ByteLevel

        shown = {b: c for c, b in self.alphabet().items()}
        assert set(shown.values()) == set(ByteLevel.alphabet())
        self.inner, self.last = (np.array([vocab[shown[b] + end] for b in range(256)], np.uint16) for end in ("", "</w>"))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        ids = [(~(vocab[a] << 16 | vocab[b]) & 0xFFFFFFFF, vocab[a + b]) for a, b in pairs]
        bits = max(4, (len(ids) * 2).bit_length())
        self.shift, self.wrap = np.uint32(32 - bits), np.uint32((1 << bits) - 1)
        # Open addressing by inverted pairs; no pair inverts to 0, which an empty place holds.
        self.key, self.rank = np.zeros(1 << bits, np.uint32), np.full(1 << bits, self._NONE, np.int32)
        self.made = np.array([new for _, new in ids], np.uint16)
        for rank, (key, _) in enumerate(ids):
            at = (key * int(self._TIMES) & 0xFFFFFFFF) >> int(self.shift)
            while self.key[at]:
                at = (at + 1) & int(self.wrap)
            self.key[at], self.rank[at] = key, rank << 6
        self.first = [self.ranks(self.inner[:, None], x[None, :]) for x in (self.inner, self.last)]

    @staticmethod
    def alphabet() -> dict[str, int]:
        """The byte that each character of the byte-level alphabet stands for."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(plain)]
        return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}

    @classmethod
    def of(cls, rules: dict) -> WordPairs | None:
        """None where the rules ask for more than plain merges."""
        model = rules["model"]
        vocab, merges = model.get("vocab") or {}, model.get("merges") or []
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        plain = model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        plain = plain and len(set(map(tuple, pairs))) == len(pairs) and all(c + end in vocab for c in cls.alphabet() for end in ("", "</w>")) and max(vocab.values()) < (1 << 16) - 1
        plain = plain and all(a in vocab and b in vocab and a + b in vocab for a, b in pairs)
        return cls(vocab, merges) if plain else None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, times 64."""
        key = ~(a.astype(np.uint32) << np.uint32(16) | b)
        at = (key * self._TIMES) >> self.shift
        held = self.key[at]
        out = self.rank[at]
        other = np.nonzero(held != key)
        out[other] = self._NONE
        while len(other[0]):
            more = held[other] != 0
            other = tuple(x[more] for x in other)
            at[other] = (at[other] + np.uint32(1)) & self.wrap
            held[other] = self.key[at[other]]
            hit = held[other] == key[other]
            found = tuple(x[hit] for x in other)
            out[found] = self.rank[at[found]]
            other = tuple(x[~hit] for x in other)
        return out

    def encode(self, words: list[str]) -> dict[str, bytes]:
        """Ids as little-endian uint32 bytes; words that are empty or too long are left out."""
        by_length: dict[int, tuple[list[str], list[bytes]]] = {}
        for w in words:
            raw = w.encode()
            if len(raw) not in by_length:
                by_length[len(raw)] = ([], [])
            names, raws = by_length[len(raw)]
            names.append(w)
            raws.append(raw)
        out: dict[str, bytes] = {}
        for length, (names, raws) in by_length.items():
            if 0 < length <= self.LONGEST:
                for at in range(0, len(names), self.WIDTH):
                    self._table(names[at : at + self.WIDTH], np.frombuffer(b"".join(raws[at : at + self.WIDTH]), "u1").reshape(-1, length).T, out)
        return out

    def _table(self, names: list[str], raw: np.ndarray, out: dict[str, bytes]) -> None:
        s = np.concatenate([self.inner[raw[:-1]], self.last[raw[-1:]]])
        r = np.concatenate([self.first[0][raw[:-2], raw[1:-1]], self.first[1][raw[-2:-1], raw[-1:]]]) if len(raw) > 1 else np.zeros((0, len(names)), np.int32)
        who, row = np.arange(len(names)), np.arange(len(raw), dtype=np.int32)[:, None]
        while True:
            # The least rank, and the place of the leftmost pair that has it.
            low = (r | row[: len(r)]).min(0, initial=self._NONE)
            off = low >= self._NONE
            done = np.flatnonzero(off)
            if len(done):
                ids, size = s[:, done].T.astype("<u4").tobytes(), 4 * len(s)
                for at, k in zip(range(0, size * len(done), size), who[done].tolist(), strict=True):
                    out[names[k]] = ids[at : at + size]
                if len(done) == len(who):
                    return
                on = np.flatnonzero(~off)
                s, r, who, low = s[:, on], r[:, on], who[on], low[on]
            n, k = np.arange(len(who)), low & 63
            s = np.where(row[: len(r)] > k, s[1:], s[:-1])
            s[k, n] = self.made[low >> 6]
            r = np.where(row[: len(r) - 1] >= k, r[1:], r[:-1])
            for left, have in ((k - 1, k > 0), (k, k < len(r))):
                i, j = left[have], n[have]
                r[i, j] = self.ranks(s[i, j], s[i + 1, j])


class Encoder:
    """Token ids of whole texts as little-endian uint32 bytes.

    A tokenizer that drops white space and never joins across it gives each
    white-space-delimited chunk the same ids wherever it stands; their ids are
    remembered. Where its pattern is ``LETTERS_APART``, a word and the symbols after
    it are looked up apart, and words skip the pattern. Any other tokenizer encodes
    whole texts.
    """

    #: White space to Python's str.split, but not to the tokenizers' patterns.
    ODD = ("\x1c", "\x1d", "\x1e", "\x1f")

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_str(spec)
        rules = json.loads(spec)
        added = rules.get("added_tokens") or []
        #: Texts that hold one of these are encoded whole, as it may stand inside a chunk.
        self.added = tuple(t["content"] for t in added)
        steps = [(n["type"], n.get("pattern", {}).get("Regex")) for n in (rules.get("normalizer") or {}).get("normalizers", [])]
        pre = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_chunk = steps == [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)] and [p.get("type") for p in pre] == ["Split", "ByteLevel"] and pre[0]["behavior"] == "Removed" and r"\s" in pre[0]["pattern"]["Regex"] and not any(t["normalized"] for t in added)
        self.apart = self.by_chunk and pre[0]["pattern"]["Regex"] == LETTERS_APART and pre[0]["invert"] and not pre[1]["use_regex"]
        if self.by_chunk:
            self.bare = Tokenizer.from_str(json.dumps(rules | {"normalizer": None, "added_tokens": []}))
            self.letters = Tokenizer.from_str(json.dumps(rules | {"normalizer": None, "added_tokens": [], "pre_tokenizer": pre[1]})) if self.apart else None
            self.pairs = WordPairs.of(rules) if self.apart and not pre[1]["add_prefix_space"] else None
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks that are not known, and of the parts that they were made from."""
        out, words, rest, parts = {}, set(), set(), []
        known, apart = self.known, self.apart
        for c in chunks:
            word = c if c.isalpha() or not apart else c.rstrip(_SYMBOLS)
            # All letters, of alphabets that every version of the patterns knows.
            if not (apart and word.isalpha() and (word.isascii() or max(word) < "\u0250")):
                rest.add(c)
                continue
            if word is not c and len(word) < len(c):
                end = c[len(word) :]
                parts.append((c, word, end))
                if end in known:
                    out[end] = known[end]
                else:
                    rest.add(end)
                if word in known:
                    out[word] = known[word]
                    continue
            words.add(word)
        if self.pairs:
            out.update(self.pairs.encode(list(words)))
            words = words.difference(out)
        for tokenizer, some in ((self.letters, list(words)), (self.bare, list(rest))) if apart else ((self.bare, list(rest)),):
            for at in range(0, len(some), 4096):
                part = some[at : at + 4096]
                got = tokenizer.encode_batch_fast(part, add_special_tokens=False)
                out.update(zip(part, [array("I", g.ids).tobytes() for g in got], strict=True))
        for c, word, end in parts:
            out[c] = out[word] + out[end]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_chunk:
            return [self.whole(t) for t in texts]
        out: list[bytes | None] = []
        waiting: list[tuple[int, list[str]]] = []
        apart = (*self.ODD, *self.added)
        for k, t in enumerate(texts):
            if any(c in t for c in apart):
                out.append(self.whole(t))
                continue
            if not t.isascii():
                t = unicodedata.normalize("NFC", t).replace("Σ", "σ")
            out.append(None)
            waiting.append((k, t.lower().split()))
        new = set().union(*(chunks for _, chunks in waiting))
        new.difference_update(self.known)
        fresh = self.learn(new)
        self.known.update(fresh)
        known = self.known.__getitem__
        for k, chunks in waiting:
            out[k] = b"".join(map(known, chunks))
        # The last that came are forgotten where they are too many.
        while len(self.known) > CACHE:
            self.known.popitem()
        return out


_encoders: dict[int, Encoder] = {}


def pieces_of(ids: bytes, max_tokens: int = MAX_TOKENS, end: int = 1) -> Iterator[tuple[int, int, bytes]]:
    """(start, length, id bytes) of a document's pieces, its closing id included."""
    ids += end.to_bytes(4, "little")
    for start in range(0, len(ids) // 4, max_tokens):
        part = ids[start * 4 : (start + max_tokens) * 4]
        yield start, len(part) // 4, part


def tokenize(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids if asked).

    Null and empty texts give one piece that holds the closing id alone. Rows
    repeated in docs stay repeated; a null doc_id stays null.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches):
        key = hash(spec.value)
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(spec.value)
        encoder = _encoders[key]
        # Millions of strings and no cycles: the collector would only walk them again and again.
        gc.disable()
        try:
            yield from pieces(encoder, batches)
        finally:
            gc.enable()

    def pieces(encoder, batches):
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            rows = [(d, k, start, n, zlib.crc32(part), part) for d, ids in zip(doc_ids, encoder.encode(texts), strict=True) for k, (start, n, part) in enumerate(pieces_of(ids, max_tokens))]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            out = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=False)]
            if keep_ids:
                out.append(pa.array([np.frombuffer(x, "<u4").astype("i4") for x in cols[5]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES + ", ids array<int>" * keep_ids)


def patterns(hist: np.ndarray, draws: int = DRAWS, few: int = FEW, seed: int = 0) -> list[tuple[int, ...]]:
    """Patterns of at most ``few`` lengths of the histogram that fill a sequence exactly.

    All of one length (repeated or not) and of two; of more, those that begin with
    drawn lengths, half of the draws by pieces and half by tokens, and end with the
    length that is then missing, where the histogram has it. The number of patterns
    depends on the sequence, not on the corpus.
    """
    size = len(hist) - 1
    have = np.flatnonzero(hist[1:]) + 1
    on = hist > 0
    out = {(int(v),) * (size // int(v)) for v in have if size % v == 0 and size // v <= few}
    out |= {(size - int(v), int(v)) for v in have if 2 * v <= size and on[size - v]}
    rng = np.random.default_rng(seed)
    for weight in (hist[have].astype(float), hist[have].astype(float) * have):
        if not len(have):
            break
        drawn = rng.choice(have, (draws // 2, few - 1), p=weight / weight.sum())
        rest = size - np.cumsum(drawn, 1)
        for row, k in np.argwhere((rest > 0) & on[np.maximum(rest, 0)]):
            if k:
                out.add(tuple(sorted((*drawn[row, : k + 1].tolist(), int(rest[row, k])), reverse=True)))
    return sorted(out)


def fit_counts(hist: np.ndarray, pats: list[tuple[int, ...]], rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative least squares: repeats x >= 0 least in the sum of (hist - A x) ** 2.

    A says how often a length stands in a pattern. Coordinate descent: each repeat
    in turn takes its best value given the others, so the residual never rises and
    the repeats go to a solution.
    """
    left, x = hist.astype(float).tolist(), [0.0] * len(pats)
    columns = [(k, sorted(Counter(p).items())) for k, p in enumerate(pats)]
    columns = [(k, c, 1.0 / sum(m * m for _, m in c)) for k, c in columns]
    least = 1e-9 * max(float(hist.sum()), 1.0)
    for _ in range(rounds):
        moved = 0.0
        for k, column, step in columns:
            grad = 0.0
            for v, m in column:
                grad += m * left[v]
            was = x[k]
            new = was + grad * step
            if new < 0.0:
                new = 0.0
            if new != was:
                x[k] = new
                for v, m in column:
                    left[v] -= m * (new - was)
                moved = max(moved, abs(new - was))
        if moved <= least:
            break
    return np.array(x)


class _Slots:
    """Slots given to the pieces of a histogram so far, as runs."""

    def __init__(self, hist: np.ndarray):
        self.left = hist.astype(np.int64).copy()
        self.taken = np.zeros(len(hist), np.int64)
        self.runs: list[tuple[int, ...]] = []
        self.sequences = self.by_pattern = 0

    def copy(self) -> _Slots:
        out = _Slots(self.left)
        out.taken, out.runs, out.sequences, out.by_pattern = self.taken.copy(), list(self.runs), self.sequences, self.by_pattern
        return out

    def place(self, length: int, n: int, per: int, seq: int, offset: int) -> None:
        self.runs.append((length, self.taken[length], per, seq, offset))
        self.taken[length] += n
        self.left[length] -= n

    def by_patterns(self, seed: int) -> int:
        """Fit patterns to what is left, round their repeats and place them; pieces placed."""
        before = int(self.left.sum())
        pats = patterns(self.left, seed=seed)
        want = np.rint(fit_counts(self.left, pats)).astype(np.int64) if pats else np.zeros(0, np.int64)
        # Patterns with the longest pieces first: short ones are easy to place later.
        for k in np.flatnonzero(want)[::-1]:
            times = Counter(pats[k])
            n = min(int(want[k]), *(int(self.left[v]) // m for v, m in times.items()))
            if n > 0:
                offset = 0
                for v, m in sorted(times.items(), reverse=True):
                    self.place(v, n * m, m, self.sequences, offset)
                    offset += v * m
                self.sequences += n
        placed = before - int(self.left.sum())
        self.by_pattern += placed
        return placed

    def best_fit(self) -> _Slots:
        """Place all that is left, longest first, each where the least space stays."""
        size, left = len(self.left) - 1, self.left
        open_by: dict[int, list[tuple[int, int]]] = {}  # slack: runs of (first sequence, how many)
        slacks: list[int] = []

        def add(slack: int, seq: int, n: int) -> None:
            if slack and n:
                if slack not in open_by:
                    open_by[slack] = []
                    bisect.insort(slacks, slack)
                open_by[slack].append((seq, n))

        for length in range(size, 0, -1):
            while left[length]:
                at = bisect.bisect_left(slacks, length)
                if at == len(slacks):
                    per = size // length
                    n = -(-int(left[length]) // per)
                    add(size, self.sequences, n)
                    self.sequences += n
                    continue
                slack = slacks[at]
                seq, n = open_by[slack].pop()
                if not open_by[slack]:
                    del open_by[slack], slacks[at]
                rest, per = int(left[length]), slack // length
                full = min(n, rest // per)
                if full:
                    self.place(length, full * per, per, seq, size - slack)
                    add(slack - per * length, seq, full)
                elif rest:
                    self.place(length, rest, rest, seq, size - slack)
                    add(slack - rest * length, seq, 1)
                    full = 1
                add(slack, seq + full, n - full)
        return self


def plan(hist: np.ndarray, size: int = MAX_TOKENS) -> dict[str, np.ndarray]:
    """Slots for every piece of the histogram, as runs sorted by (length, first rank).

    A run says: pieces of this length with ranks from ``first`` go ``per`` to a
    sequence, the i-th to sequence ``seq + i // per`` at ``offset + i % per *
    length``. The number of runs depends on ``size``, not on the corpus.
    ``sequences`` and ``by_pattern`` (pieces that patterns placed) are counts. What
    rounding leaves over is fitted anew while that places more than a little; of
    these fits as many are kept as leave the fewest sequences.
    """
    slots = _Slots(hist)
    best = slots.copy().best_fit()
    for seed in range(STAGES):
        before = int(slots.left.sum())
        placed = slots.by_patterns(seed)
        packed = slots.copy().best_fit()
        if packed.sequences <= best.sequences:
            best = packed
        if placed <= before * LITTLE:
            break
    table_ = np.array(sorted(best.runs), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "per", "seq", "offset"), table_.T.copy(), strict=True)) | {"sequences": np.array([best.sequences]), "by_pattern": np.array([best.by_pattern])}


def place(pieces: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """pieces and their sequence_id and offset.

    The driver sees the histogram alone. Ranks within a length come from a
    salted count, so a length that holds a third of all pieces is ranked by many
    tasks; equal pieces may swap ranks, which changes nothing.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("length").count().collect()
    hist = np.zeros(max_tokens + 1, np.int64)
    for row in counts:
        hist[row["length"]] = row["count"]
    slots = plan(hist, max_tokens)
    shared = spark.sparkContext.broadcast({k: v for k, v in slots.items()} | {"code": slots["length"] << 44 | slots["first"]})
    salts = spark.createDataFrame([(int(r["length"]), max(1, int(r["count"] ** 0.5))) for r in counts], "length long, salts int")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))).drop("salts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(cells, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))
    names = pieces.columns

    def run(batches):
        s = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            k = np.searchsorted(s["code"], length << 44 | rank, side="right") - 1
            i = rank - s["first"][k]
            seq, offset = s["seq"][k] + i // s["per"][k], s["offset"][k] + i % s["per"][k] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = plus(pieces.schema, "sequence_id long, offset long")
    return ranked.select(*names, "rank").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str | None = None, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Every piece of every document with its place in a sequence.

    Nulls: a null text is empty, a null doc_id stays null. Other columns of docs
    do not matter. An empty table gives no rows.
    """
    return place(cut(tokenize(docs, tokenizer, max_tokens=max_tokens), "pieces"), max_tokens)


def sequences(docs: DataFrame, tokenizer: str | None = None, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """The packed sequences themselves: sequence_id, doc_ids, input_ids."""
    pieces = cut(tokenize(docs, tokenizer, max_tokens=max_tokens, keep_ids=True), "pieces")
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return place(pieces, max_tokens).groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.col("p.doc_id").alias("doc_ids"), F.flatten("p.ids").alias("input_ids"))


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
