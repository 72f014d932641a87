"""Secrets by a battery of randomness tests.

Known forms (assignments, access keys, long hex) are found by pattern. Every other
long token is held against the alphabet of the narrowest encoding that fits it: a
chi-squared test of uniformity, a runs test about the middle of the alphabet and a
test of serial correlation. The null hypothesis of all three is that the token's
symbols are drawn uniformly and independently, as a secret's are. The two tests of
order take the lesser of their p-values twice (Bonferroni), which Fisher's method
joins with that of the counts. The Benjamini-Hochberg procedure over these, one
for each class of lengths, finds the tokens that are not random and keeps the
expected share of secrets among them below ``FDR``. Of the others those are
reported that ordinary text is unlikely to be as even as (``TEXT``): short words
cannot be told from secrets by the battery alone. The procedure's input is a
histogram of p-values, so the driver sees counts alone; rows never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import spans as S
from strandline.llm.common import cut, table

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
#: Share of secrets among the tokens found not random; chance that text is as even as a token reported.
FDR, TEXT = 0.01, 0.003
#: p-values are rounded up to powers of ten of this fraction.
GRID = 20

PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    # Whole runs that are long enough; shorter ones are dropped anyway.
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
    "random": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}",
}

#: Encodings from narrow to wide: symbols in order of value.
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("base64 mixed", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
#: Chance that two characters of ordinary text agree, and of their doing so thrice.
TEXT_PAIR, TEXT_TRIPLE = 0.066, 0.0053


def upper_normal(z: Column) -> Column:
    """P(Z > z), by a logistic approximation (error below 0.0002), never 0."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def statistics(token: Column) -> Column:
    """Array with the one struct of what the battery needs; empty if no encoding fits."""
    bare = F.regexp_replace(token, "=+$", "")
    size = F.lit(0)
    alphabet = F.lit("")
    for _, symbols in reversed(ENCODINGS):
        fits = bare.rlike(f"^[{symbols.replace('-', chr(92) + '-')}]+$")
        size, alphabet = F.when(fits, len(symbols)).otherwise(size), F.when(fits, F.lit(symbols)).otherwise(alphabet)
    given = F.array(F.struct(bare.alias("s"), size.cast("double").alias("k"), alphabet.alias("a")))
    coded = F.transform(F.filter(given, lambda g: g["k"] > 0), lambda g: F.struct(g["k"].alias("k"), F.transform(F.split(g["s"], ""), lambda c: (F.instr(g["a"], c) - 1).cast("double")).alias("v"), F.split(g["s"], "").alias("c")))
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda s, x: s + f(x))

    def sums(g):
        v, n = g["v"], F.size(g["v"]).cast("double")
        steps = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        high = lambda x: x >= g["k"] / 2
        mean = (g["k"] - 1) / 2
        return F.struct(
            g["k"].alias("k"),
            n.alias("n"),
            total(F.array_distinct(v), lambda a: F.pow(F.size(F.filter(v, lambda x: x == a)).cast("double"), F.lit(2.0))).alias("squares"),
            total(v, lambda x: high(x).cast("double")).alias("above"),
            total(steps, lambda p: (high(p["x"]) != high(p["y"])).cast("double")).alias("turns"),
            total(steps, lambda p: (p["x"] - mean) * (p["y"] - mean)).alias("lagged"),
        )

    return F.transform(coded, sums)


def battery(token: Column) -> Column:
    """Array with one struct (n, p_random, p_text), or none if no encoding fits.

    p_random combines the three tests under the null of uniform symbols; p_text is
    the chance that text of this length is as even or more so.
    """

    def tests(s):
        n, k = s["n"], s["k"]
        chi = s["squares"] * k / n - n
        df = k - 1
        # Wilson-Hilferty: the cube root of a chi-squared over its mean is nearly normal.
        p_chi = upper_normal((F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
        a, b = s["above"], n - s["above"]
        runs = 1 + 2 * a * b / n
        var = F.greatest((runs - 1) * (runs - 2) / (n - 1), F.lit(1e-9))
        p_runs = F.when((a == 0) | (b == 0), F.pow(F.lit(0.5), n - 1)).otherwise(F.least(F.lit(1.0), 2 * upper_normal(F.abs(s["turns"] + 1 - runs) / F.sqrt(var))))
        p_serial = F.least(F.lit(1.0), 2 * upper_normal(F.abs(s["lagged"]) / ((k * k - 1) / 12 * F.sqrt(n - 1))))
        pairs = n * (n - 1) / 2
        even = (s["squares"] - n) / 2
        sd = F.sqrt(pairs * TEXT_PAIR * (1 - TEXT_PAIR) + n * (n - 1) * (n - 2) * (TEXT_TRIPLE - TEXT_PAIR**2))
        p_text = upper_normal((pairs * TEXT_PAIR - even) / sd)
        # Fisher: the product q of two independent p-values has P(q or less) = q (1 - ln q).
        q = F.greatest(p_chi * F.least(F.lit(1.0), 2 * F.least(p_runs, p_serial)), F.lit(1e-300))
        return F.struct(n.alias("n"), (q * (1 - F.log(q))).alias("p_random"), p_text.alias("p_text"))

    return F.transform(F.filter(statistics(token), lambda s: s["n"] >= 16), tests)


def stratum(n: Column) -> Column:
    """Class of lengths: 16, 24, 32, 48, 64, 128 symbols and more."""
    return F.when(n < 24, 0).when(n < 32, 1).when(n < 48, 2).when(n < 64, 3).when(n < 128, 4).otherwise(5)


def level(p: Column) -> Column:
    """How many grid steps a p-value is below 1; rounds it up."""
    return F.floor(-F.log10(p) * GRID).cast("int")


def thresholds(counts: list[tuple[int, int, int]], fdr: float = FDR) -> dict[int, int]:
    """Benjamini-Hochberg for each class of lengths from (class, level, count): least level taken."""
    out = {}
    for c in {c for c, _, _ in counts}:
        mine = sorted(((lv, n) for s, lv, n in counts if s == c), reverse=True)
        tests, taken = sum(n for _, n in mine), 0
        for lv, n in mine:
            taken += n
            if 10 ** (-lv / GRID) * tests <= fdr * taken:
                out[c] = lv
    return out


def base_spans(text: Column) -> Column:
    lower = F.lower(text)
    named = F.contains(lower, F.lit("pass")) | F.contains(lower, F.lit("secret")) | F.contains(lower, F.lit("token")) | F.contains(lower, F.lit("api"))
    assign = F.filter(S.find(text, PATTERNS["assign"], "assign", named), lambda s: F.length(F.regexp_extract(s["text"], PATTERNS["assign"], 1)) >= 6)
    return F.concat(assign, S.find(text, PATTERNS["access"], "access", F.contains(text, F.lit("AKIA"))), S.find(text, PATTERNS["hex"], "hex", F.lit(True)))


def _tested(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.withColumn("_found", F.struct(base_spans(text).alias("base"), S.find(text, PATTERNS["random"], "random", F.lit(True)).alias("loose")))
    tested = F.transform(S.outside(F.col("_found.loose"), F.col("_found.base")), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.get(battery(s["text"]), F.lit(0)).alias("t")))
    plain = F.transform("_found.base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.withColumns({"_base": plain, "_loose": F.filter(tested, lambda s: s["t"].isNotNull())}).drop("_found")


def scan(docs: DataFrame, text_col: str = "text", fdr: float = FDR, text: float = TEXT, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all if not given), and base and spans: arrays of (kind, start, end).

    base holds the known forms, spans these and the random tokens. Null and empty
    texts have none; columns of docs named base, spans, _base, _loose or _found are
    replaced. The battery looks at a token, never at its document, so repeated
    rows come back repeated; an empty table gives no rows. The patterns and the
    battery run once: what they find is written with the columns kept.
    """
    names = [c for c in (keep if keep is not None else docs.columns) if c not in ("base", "spans", "_base", "_loose", "_found")]
    tested = cut(_tested(docs, text_col).select(*names, "_base", "_loose"), "tokens")
    every = tested.select(F.explode("_loose").alias("s")).select(stratum(F.col("s.t.n")).alias("c"), level(F.col("s.t.p_random")).alias("lv"))
    least = thresholds([tuple(r) for r in every.groupBy("c", "lv").count().collect()], fdr)

    def taken(s):
        ordinary = F.lit(False)
        for c, lv in sorted(least.items()):
            ordinary = ordinary | ((stratum(s["t"]["n"]) == c) & (level(s["t"]["p_random"]) >= lv))
        return ~ordinary & (s["t"]["p_text"] <= text)

    more = F.transform(F.filter("_loose", taken), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return tested.withColumns({"base": F.col("_base"), "spans": F.concat("_base", more)}).drop("_base", "_loose")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every secret of its text replaced by a mark; a null text stays null.

    All other columns stay, whatever their names.
    """
    found = scan(docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"), "text"))
    clean = F.when(F.col("text").isNotNull(), S.redact(F.col("text"), F.col("spans"), mark)).alias("text")
    return found.select(*[clean if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans by start, and all spans, of every document; null texts have none."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    base = F.col("base")
    return found.select("doc_id", *[S.count(base, k).alias(f"n_{k}") for k in BASE], F.sha2(S.listed(base, KINDS, False), 256).alias("base_sha256"), S.listed(F.col("spans"), KINDS, False).alias("spans"))
