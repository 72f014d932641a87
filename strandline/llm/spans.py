"""Spans of regular expressions as column expressions: no Python touches the rows.

Positions are code points, ends exclusive. A pattern must not match the empty
string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:int,end:int,text:string,left:string,right:string>"


#: Elements that a running total is made of at a time; totals of totals join them.
BLOCK = 256


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(items: Column, join, zero: Column) -> Column:
    """join over each prefix of an array, its last element included; join is associative.

    Arrays grow within blocks only, so the work is in proportion to the length. items
    must be a variable of let() or a column, and not empty.
    """

    def block(b):
        part = F.slice(items, b * BLOCK + 1, BLOCK)
        grow = lambda s, x: let(join(s["at"], x), lambda v: F.struct(v.alias("at"), F.concat(s["out"], F.array(v)).alias("out")))
        return F.aggregate(part, F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out")), grow, lambda s: s["out"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), block)
    shift = lambda s, p: F.struct(join(s["at"], F.element_at(p, -1)).alias("at"), F.concat(s["out"], F.array(F.transform(p, lambda x: join(s["at"], x)))).alias("out"))
    return F.aggregate(blocks, F.struct(zero.alias("at"), F.array().cast("array<array<int>>").alias("out")), shift, lambda s: F.flatten(s["out"]))


def find(text: Column, pattern: str, kind: str, where: Column, context: int = 0) -> Column:
    """Leftmost non-overlapping matches as an array of SPAN, in time in proportion to text and matches.

    ``where`` is a cheap condition without which there is no match. left and
    right hold up to ``context`` characters between the match and the next ones.
    """
    given = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))

    def spans(g):
        steps = F.transform(g["hits"], lambda h, i: F.length(F.get(g["gaps"], i)) + F.length(h))
        if context:
            around = lambda i: (F.right(F.get(g["gaps"], i), F.lit(context)).alias("left"), F.left(F.get(g["gaps"], i + 1), F.lit(context)).alias("right"))
        else:
            around = lambda i: (F.lit("").alias("left"), F.lit("").alias("right"))
        span = lambda h, end, i: F.struct(F.lit(kind).alias("kind"), (end - F.length(h)).alias("start"), end.alias("end"), h.alias("text"), *around(i))
        return let(steps, lambda each: let(running(each, lambda x, y: x + y, F.lit(0)), lambda ends: F.transform(g["hits"], lambda h, i: span(h, F.get(ends, i), i))))

    return F.when(where & F.rlike(text, F.lit(pattern)), let(given, spans)).otherwise(F.array().cast(f"array<{SPAN}>"))


def below(sorted_: Column, x: Column, most: int = 30) -> Column:
    """How many elements of a sorted array are less than x, by bisection. sorted_ as in running()."""
    return F.aggregate(
        F.array(*[F.lit(1 << k) for k in range(most, -1, -1)]),
        F.lit(0),
        lambda n, step: F.when((step <= F.size(sorted_) - n) & (F.get(sorted_, n + step - 1) < x), n + step).otherwise(n),
    )


def outside(spans: Column, others: Column) -> Column:
    """Spans that overlap none of the others, by bisection on the others' starts."""

    def keep(o):
        # The furthest end among the others that start before a span's end.
        ends = running(F.transform(o, lambda x: x["end"]), lambda x, y: F.greatest(x, y), F.lit(0))
        places = F.struct(F.transform(o, lambda x: x["start"]).alias("starts"), ends.alias("ends"))
        return let(places, lambda p: F.filter(spans, lambda s: let(below(p["starts"], s["end"]), lambda n: (n == 0) | (F.get(p["ends"], n - 1) <= s["start"]))))

    ordered = F.array_sort(F.transform(others, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(let(ordered, keep))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column, kinds: tuple[str, ...], by_kind: bool) -> Column:
    """kind:start:end, comma-joined; by kind as listed then start, or by start then kind."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, kinds)), s["kind"]).cast("int")
    key = (lambda s: F.struct(rank(s), s["start"], s["end"], s["kind"])) if by_kind else (lambda s: F.struct(s["start"], rank(s), s["end"], s["kind"]))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(key(s).alias("key"), F.concat_ws(":", s["kind"], s["start"], s["end"]).alias("said"))))
    return F.array_join(F.transform(ordered, lambda s: s["said"]), ",")


def redact(text: Column, spans: Column, mark: str) -> Column:
    """The text with every span, overlapping ones merged, replaced by a mark."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def cut(o):
        ends = running(F.transform(o, lambda x: x["end"]), lambda x, y: F.greatest(x, y), F.lit(0))

        def parts(e):
            # What stands before each span, with its mark; nothing for one that begins inside an earlier one.
            before = lambda x, i: let(F.when(i == 0, 0).otherwise(F.get(e, i - 1)), lambda at: F.when(x["start"] < at, "").otherwise(F.concat(F.substring(text, at + 1, x["start"] - at), F.lit(mark))))
            return F.concat(F.array_join(F.transform(o, before), ""), F.substring(text, F.element_at(e, -1) + 1, F.length(text)))

        return let(ends, parts)

    return F.when(F.size(spans) > 0, let(ordered, cut)).otherwise(text)
