"""The least-squares fit of patterns against exact solutions, and what patterns place."""

import itertools
import random

import numpy as np
from conftest_llm import SF

from strandline.llm import packing


def residual(hist, pats, x):
    left = hist.astype(float).copy()
    for p, n in zip(pats, x, strict=True):
        for v in p:
            left[v] -= n
    return float((left**2).sum())


def exact(hist, pats):
    """Least residual over all sets of patterns whose unconstrained solution is not negative."""
    a = np.array([[p.count(v) for p in pats] for v in range(len(hist))], float)
    best = float((hist**2).sum())
    for r in range(1, len(pats) + 1):
        for some in itertools.combinations(range(len(pats)), r):
            x, *_ = np.linalg.lstsq(a[:, some], hist, rcond=None)
            if (x >= -1e-9).all():
                best = min(best, float(((a[:, some] @ x - hist) ** 2).sum()))
    return best


def test_fit_is_least_squares():
    r = np.random.default_rng(1)
    for _ in range(12):
        hist = np.concatenate([[0], r.integers(0, 30, 12)]).astype(float)
        pats = packing.patterns(hist.astype(np.int64), draws=24, few=4)[:9]
        if pats:
            got = [residual(hist, pats, packing.fit_counts(hist, pats, n)) for n in (5, 15, 25, 400)]
            assert got == sorted(got, reverse=True) and abs(got[-1] - exact(hist, pats)) <= 1e-6 * (1 + got[-1])


def test_patterns_fill_sequences():
    hist = np.bincount(np.random.default_rng(2).integers(1, 101, 500), minlength=101)
    pats = packing.patterns(hist)
    assert len(pats) == len(set(pats)) > 100 and all(sum(p) == 100 and len(p) <= packing.FEW and all(hist[v] for v in p) for p in pats)
    assert packing.patterns(np.zeros(101, np.int64)) == []


def test_patterns_place_most_pieces(spark):
    """Most pieces that are not full come to their place through a pattern; no more sequences than tokens need."""
    rows = packing.tokenize(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")).groupBy("length").count().collect()
    hist = np.zeros(packing.MAX_TOKENS + 1, np.int64)
    for r in rows:
        hist[r["length"]] = r["count"]
    p = packing.plan(hist)
    full = hist[packing.MAX_TOKENS]
    assert p["by_pattern"][0] - full > 0.5 * (hist.sum() - full)
    assert p["sequences"][0] <= 1.001 * (hist * np.arange(len(hist))).sum() / packing.MAX_TOKENS + 1


def test_other_patterns_are_not_split():
    """A tokenizer whose pattern does not keep letters from symbols gets whole chunks."""
    import json

    with open(packing.default_tokenizer(), encoding="utf-8") as f:
        rules = json.load(f)
    rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[^\s]+"
    encoder = packing.Encoder(json.dumps(rules))
    texts = ["One two, three. four### five.six", "é, ß. x"]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert encoder.by_chunk and not encoder.apart and got == [encoder.full.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_and_symbols_apart():
    with open(packing.default_tokenizer(), encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    texts = ["that$$$ that. that.$$$ it's 'tis don't. a_b c_ _d é, éß### 12% x9. --- (word) word's. ŉx. İ. ﬁ! ʰa."] * 2
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert encoder.apart and got == [encoder.full.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_pairs_merge_as_the_tokenizer(monkeypatch):
    """Words of every length at once: repeats that overlap, other alphabets, too long a word; what a full memory forgets."""
    with open(packing.default_tokenizer(), encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    r = random.Random(4)
    letters = (("ab", 12), ("a", 64), ("etaoinshr", 14), ("abcdefghijklmnopqrstuvwxyzßéöñł", 40))
    words = sorted({"".join(r.choice(a) for _ in range(r.randint(1, n))) for a, n in letters for _ in range(500)})
    got = encoder.pairs.encode(words)
    assert {w for w in words if w not in got} == {w for w in words if len(w.encode()) > packing.WordPairs.LONGEST} != set()
    want = encoder.letters.encode_batch_fast(words, add_special_tokens=False)
    assert all(w not in got or np.frombuffer(got[w], "<u4").tolist() == g.ids for w, g in zip(words, want, strict=True))
    monkeypatch.setattr(packing, "CACHE", 50)
    for _ in range(2):
        texts = [" ".join(r.choice(words) + r.choice(("", ",", "...", "'s", "1.")) for _ in range(60)) for _ in range(4)]
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
        assert len(encoder.known) == 50 and got == [encoder.full.encode(t, add_special_tokens=False).ids for t in texts]
