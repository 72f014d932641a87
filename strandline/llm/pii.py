"""Personal data by weak-supervision aggregation.

Candidates are the strict matches and looser ones (numbers without a country
code, spelt-out addresses, social security numbers, account numbers). Labelers
vote on each: its exact shape, checksums and known endings, a gazetteer of words
that announce such data, the characters around it, and how regular it is.
Expectation-maximisation over the counts of vote patterns, over all kinds and then
for each kind, estimates how reliable each labeler is and how likely each pattern
is right; a labeler that abstains (0) says nothing. Those soft labels train the
final span classifier, a logistic model that sees the kind and what no labeler looked
at: the span's length, its characters, and the word before it. Its odds and those of
the votes make the score. Rows never leave the JVM: the driver sees counts of cells
of these, of which there are at most 280,000 whatever the corpus.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import spans as S
from strandline.llm.common import cut, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban")
CONTEXT = 24

# Possessive forms of the patterns asked for; a run is tried at its first
# character only (or where the last match ended), as later ones fail alike.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms, and the kinds that they stand for.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]++(?: ?(?:[(\[](?:dot|DOT)[)\]]|\.) ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
    "ssn": r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![0-9A-Za-z])",
}

#: Words that announce personal data.
GAZETTEER = "account bank call card cell contact email e-mail fax host iban ip mail mobile phone reach ring sms social ssn tel telephone visa write".split()
#: Common last parts of domains.
ENDINGS = "biz co com de edu es eu fr gov info int io mil net org uk us".split()

LABELERS = ("shape", "check", "gazetteer", "context", "regular")
#: Values of each feature: length, characters, hash of the word before.
FEATURES = (4, 3, 16)
#: Votes of each labeler that its reliability over all kinds counts for in that of one kind.
PRIOR = 20.0


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    chars = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int")))),
        F.lit(0),
        lambda s, d: s + d,
    )
    return total % 10 == 0


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def strict(kind: str, s: Column) -> Column:
    """Whether a match of a strict pattern counts."""
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))
    if kind == "card":
        d = _digits(s)
        return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(s)).between(8, 15)
    return F.lit(True)


def votes(span: Column) -> list[Column]:
    """Votes (-1, 0, 1) of LABELERS on a span of SPAN and base."""
    kind, text, left, right = span["kind"], span["text"], F.lower(span["left"]), span["right"]
    d = _digits(text)
    n = F.length(d)
    shape = F.when(span["base"], 1).otherwise(0)
    check = (
        F.when(kind == "card", F.when(F.length(d) > 0, 1))
        .when(kind == "email", F.when(F.lower(F.regexp_extract(text, r"([A-Za-z0-9]+)\)?\]?$", 1)).isin(ENDINGS), 1).otherwise(-1))
        .when(kind == "ip", F.when(text.rlike(r"^(?:0|127|255)\."), -1).otherwise(1))
        .when(kind == "phone", F.when(n.between(10, 13), 1).otherwise(-1))
        .when(kind == "ssn", F.when(text.rlike("^(?:000|666|9)|-00-|-0000$"), -1).otherwise(1))
        .otherwise(F.when(n >= 10, 1).otherwise(-1))
    )
    known = F.exists(F.split(left, r"[^a-z-]+"), lambda w: w.isin(GAZETTEER))
    around = F.when(left.rlike(r"[:=]\s*[\"'(]?$"), 1).when(left.rlike(r"[A-Za-z0-9_/]$") | right.rlike("^[A-Za-z0-9_/]"), -1).otherwise(0)
    kinds = F.size(F.array_distinct(F.split(d, "")))
    regular = F.when(n == 0, 0).when(kinds <= 2, -1).when(kinds >= 4, 1).otherwise(0)
    return [F.coalesce(v, F.lit(0)).cast("int") for v in (shape, check, F.when(known, 1).otherwise(-1), around, regular)]


def candidates(text: Column) -> tuple[Column, Column]:
    """Strict spans, and looser ones that touch none of them."""
    digit = text.rlike("[0-9]")
    may = {"email": F.contains(text, F.lit("@")), "ip": digit & F.contains(text, F.lit(".")), "card": digit, "phone": F.contains(text, F.lit("+"))}
    counts = lambda kind: lambda s: strict(kind, s["text"])
    base = F.concat(*[F.filter(S.find(text, PATTERNS[k], k, may[k], CONTEXT), counts(k)) for k in BASE])
    spelt = F.contains(text, F.lit("(at)")) | F.contains(text, F.lit("[at]")) | F.contains(text, F.lit("(AT)")) | F.contains(text, F.lit("[AT]"))
    loose = F.concat(*[S.find(text, p, k, spelt if k == "email" else digit, CONTEXT) for k, p in LOOSE.items()])
    return base, loose


def features(span: Column) -> list[Column]:
    """FEATURES of a span of SPAN, from 0: none of them is a vote."""
    n = F.length(span["text"])
    length = F.when(n < 12, 0).when(n < 16, 1).when(n < 20, 2).otherwise(3)
    chars = F.when(span["text"].rlike("[A-Za-z]"), 2).when(span["text"].rlike("^[0-9]+$"), 0).otherwise(1)
    word = F.regexp_extract(F.lower(span["left"]), r"([a-z]+)[^a-z]*$", 1)
    return [length, chars, F.pmod(F.xxhash64(word), F.lit(FEATURES[2])).cast("int")]


def _voted(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with _base and _loose, each span with its votes and features."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base, loose = candidates(text)
    found = docs.withColumn("_found", F.struct(base.alias("base"), loose.alias("loose")))

    def vote(is_base):
        told = lambda s: F.struct(*[s[f].alias(f) for f in ("kind", "text", "left", "right")], F.lit(is_base).alias("base"))
        return lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.array(*votes(told(s))).alias("votes"), F.array(*features(s)).alias("features"))

    return found.withColumns({"_base": F.transform("_found.base", vote(True)), "_loose": F.transform(S.outside(F.col("_found.loose"), F.col("_found.base")), vote(False))}).drop("_found")


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50, prior: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote pattern, and P(vote | class) by class, labeler and vote.

    Two classes; labelers vote independently given the class. Starts from ``prior``
    (shares that count as PRIOR spans of each class), or else from the mean vote, so
    the class that labelers speak for is the one found.
    """
    at = np.arange(patterns.shape[1])
    pseudo = np.full((2, patterns.shape[1], 3), 0.5) if prior is None else PRIOR * prior + 0.5

    def posterior(share, total):
        logs = [np.log(total[c] + 1) + np.log(share[c, at, patterns + 1]).sum(1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))

    post = 1 / (1 + np.exp(-2 * patterns.mean(1) * patterns.shape[1])) if prior is None else posterior(prior, np.zeros(2))
    for _ in range(rounds):
        share = pseudo.copy()
        for v in (-1, 1):
            hit = patterns == v
            share[0, :, v + 1] += ((counts * (1 - post))[:, None] * hit).sum(0)
            share[1, :, v + 1] += ((counts * post)[:, None] * hit).sum(0)
        share /= share[:, :, ::2].sum(2, keepdims=True)
        share[:, :, 1] = 1
        post = posterior(share, np.array([(counts * (1 - post)).sum(), (counts * post).sum()]))
    return post, share


def train(x: np.ndarray, post: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights (columns of x, then the intercept) of a logistic model fitted to soft labels."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(float)
    w = np.zeros(x.shape[1])
    weight = counts / max(counts.sum(), 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        grad = x.T @ (weight * (p - post)) + 1e-3 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def design(kinds: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Rows of the classifier: one column for each kind and each value of each feature."""
    return np.hstack([np.eye(n)[np.asarray(v, int)] for n, v in zip((len(KINDS), *FEATURES), (kinds, *marks.T), strict=True)])


def odds(kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log odds that a vote speaks for, by kind, labeler and vote: over all kinds, then of each."""
    out = np.zeros((len(KINDS), len(LABELERS), 3))
    _, pooled = expectation_maximisation(votes, counts)
    for k in np.unique(kinds):
        patterns, at = np.unique(votes[kinds == k], axis=0, return_inverse=True)
        _, share = expectation_maximisation(patterns, np.bincount(at.ravel(), counts[kinds == k], len(patterns)), prior=pooled)
        out[k] = np.log(share[1] / share[0])
    return out


def said(table_: np.ndarray, kinds: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """Log odds of some cells from the table of odds()."""
    return table_[kinds[:, None], np.arange(len(LABELERS)), votes + 1].sum(1)


def fit(kinds: np.ndarray, votes: np.ndarray, marks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table of odds and the classifier's weights. Soft labels take both classes as equally frequent."""
    table_ = odds(kinds, votes, counts)
    return table_, train(design(kinds, marks), 1 / (1 + np.exp(-said(table_, kinds, votes))), counts)


def learn(voted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """fit() from counts of cells; zeros where nothing was found."""
    cell = lambda s: F.struct(s["kind"].alias("kind"), s["votes"].alias("votes"), s["features"].alias("features"))
    rows = voted.select(F.explode(F.concat(F.transform("_base", cell), F.transform("_loose", cell))).alias("cell")).groupBy("cell").count().orderBy("cell").collect()
    if not rows:
        return np.zeros((len(KINDS), len(LABELERS), 3)), np.zeros(len(KINDS) + sum(FEATURES) + 1)
    kinds = np.array([KINDS.index(r["cell"]["kind"]) for r in rows])
    return fit(kinds, np.array([r["cell"]["votes"] for r in rows]), np.array([r["cell"]["features"] for r in rows]), np.array([r["count"] for r in rows], float))


def scored(span: Column, learnt: tuple[np.ndarray, np.ndarray]) -> Column:
    """The probability of a span with votes and features."""
    table_, w = learnt
    kind = F.array_position(F.array(*map(F.lit, KINDS)), span["kind"]).cast("int") - 1
    parts = np.split(w, np.cumsum([len(KINDS), *FEATURES]))
    total = F.lit(float(parts[-1][0]))
    for weights, at in zip(parts[:-1], (kind, *[F.get(span["features"], F.lit(i)) for i in range(len(FEATURES))]), strict=True):
        total = total + F.get(F.array(*[F.lit(float(x)) for x in weights]), at)
    for i in range(len(LABELERS)):
        total = total + F.get(F.array(*[F.lit(float(x)) for x in table_[:, i].ravel()]), kind * 3 + F.get(span["votes"], F.lit(i)) + 1)
    return 1 / (1 + F.exp(-total))


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all if not given), and base and spans: arrays of (kind, start, end, score).

    base holds the strict matches, spans these and the looser ones that the
    classifier takes. Null and empty texts have none; columns of docs named base,
    spans, _base, _loose or _found are replaced. Every row is scored by itself, so
    rows repeated in docs come back repeated, and an empty table gives no rows. The
    patterns run once: what they find is written with the columns kept.
    """
    names = [c for c in (keep if keep is not None else docs.columns) if c not in ("base", "spans", "_base", "_loose", "_found")]
    voted = cut(_voted(docs, text_col).select(*names, "_base", "_loose"), "spans")
    learnt = learn(voted)
    told = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), scored(s, learnt).alias("score"))
    base = F.transform("_base", told)
    more = F.filter(F.transform("_loose", told), lambda s: s["score"] >= 0.5)
    return voted.withColumns({"base": base, "spans": F.concat(base, more)}).drop("_base", "_loose")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans by kind, and all spans, of every document; null texts have none."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    base = F.col("base")
    return found.select("doc_id", *[S.count(base, k).alias(f"n_{k}") for k in BASE], F.sha2(S.listed(base, KINDS, True), 256).alias("base_sha256"), S.listed(F.col("spans"), KINDS, True).alias("spans"))
