"""License scans by diagonal voting.

All rolling word k-gram hashes of the documents are joined by Spark to the
positions of the same k-grams in the templates. A match votes for the diagonal
(its place in the document less its place in the template). Votes of neighbouring
diagonals merge, so a word put in or left out does not hide a template, and the
span they make is verified by the share of the template's k-grams found in it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import small_batches, table
from strandline.llm.repeats import Words, _steps

GRAM = 2
#: Diagonals at most so far apart merge; a span needs this share of its template.
BAND, SHARE = 2, 0.75

#: Phrases that must stand word for word, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Notices of common licenses, and their labels.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)

#: Bytes of words once A-Z is lower: digits, small letters, all beyond ASCII. Others become spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of all k-grams."""
    at = np.flatnonzero(words.left >= k)
    return at, words.runs(at, k)


def template_grams(phrases, templates, k: int) -> list[tuple[int, int, int]]:
    """(hash, template, place in it) of every k-gram; phrases come first."""
    texts = [t.encode() for t, _ in (*phrases, *templates)]
    words = Words(texts)
    at, h = grams(words, k)
    return list(zip(h.tolist(), words.text[at].tolist(), words.place[at].tolist(), strict=True))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, band: int = BAND, share: float = SHARE) -> DataFrame:
    """doc_id, n_words and spans (start, end, label, exact, score) of every document.

    Words are runs of digits, letters a-z and characters beyond ASCII after A-Z
    is lowered; spans count words from 0, end exclusive. A phrase's span is exact:
    all its k-grams vote for one diagonal. Null texts are empty; a document
    without matches has no spans; repeated rows come back repeated. Templates
    have k to 60 words.
    """
    spark = docs.sparkSession
    small_batches(spark)
    every = [*phrases, *templates]
    length = [len(t.split()) for t, _ in every]
    if not every or min(length) < k or max(length) > 60:
        raise ValueError("templates must have k to 60 words")
    # Template -1 matches once in each document and carries its number of words.
    mark = -(1 << 63)
    known = spark.createDataFrame([*template_grams(phrases, templates, k), (mark, -1, 0)], "h long, template int, at int")
    keyed = docs.select(F.col(id_col).cast("long").alias("key1"), F.xxhash64(text_col).alias("key2"), F.col(text_col).alias("text"))

    def emit(batches):
        for keys, texts in _steps(batches):
            words = Words([t.translate(_FOLD) for t in texts])
            at, h = grams(words, k)
            h[h == mark] += 1
            n = np.diff(words.first)
            row = np.concatenate([words.text[at], np.arange(len(texts))])
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in keys), pa.array(np.concatenate([words.place[at], n]).astype("i4")), pa.array(np.concatenate([h, np.full(len(texts), mark)]))], names=["key1", "key2", "place", "h"])

    # The templates are a few hundred rows, whatever the corpus.
    found = keyed.mapInArrow(emit, "key1 long, key2 long, place int, h long").join(F.broadcast(known), "h")
    votes = (
        found.repartition("key1", "key2")
        .groupBy("key1", "key2", "template", (F.col("place") - F.col("at")).alias("diagonal"))
        .agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("votes"), F.count("*").alias("n"))
    )
    by_doc = votes.groupBy("key1", "key2").agg(F.collect_list(F.struct("template", "diagonal", "votes", "n")).alias("votes"))
    n_phrases, span = len(phrases), "array<struct<start:int,end:int,label:string,exact:boolean,score:double>>"

    def verify(batches):
        for batch in batches:
            out = {"doc_id": [], "n_words": [], "spans": []}
            for doc, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n_words = copies = 0
                spans, loose = [], {}
                for r in sorted(rows, key=lambda r: (r["template"], r["diagonal"])):
                    t, d, bits = r["template"], r["diagonal"], r["votes"]
                    if t < 0:
                        n_words, copies = d, r["n"]
                    elif t < n_phrases:
                        if bits.bit_count() == length[t] - k + 1:
                            spans.append({"start": d, "end": d + length[t], "label": every[t][1], "exact": True, "score": 1.0})
                    else:
                        loose.setdefault(t, []).append((d, bits))
                for t, found in loose.items():
                    spans += merged(found, length[t], every[t][1])
                spans.sort(key=lambda s: (s["start"], s["end"], s["label"]))
                for _ in range(copies):
                    for c, v in (("doc_id", doc), ("n_words", n_words), ("spans", spans)):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("exact", pa.bool_()), ("score", pa.float64())])))]))

    def merged(found, words, label):
        """Spans of one template from its (diagonal, votes) in order."""
        out, need = [], words - k + 1
        at = 0
        while at < len(found):
            # The run of diagonals from here on, each within the band of the one before.
            best, bits, upto = at, 0, at
            while upto < len(found) and found[upto][0] - found[at][0] <= band:
                bits |= found[upto][1]
                if found[upto][1].bit_count() > found[best][1].bit_count():
                    best = upto
                upto += 1
            score = bits.bit_count() / need
            if score >= share:
                first, last = (bits & -bits).bit_length() - 1, bits.bit_length() - 1
                start = found[best][0] + first
                out.append({"start": max(start, 0), "end": found[best][0] + last + k, "label": label, "exact": False, "score": score})
                at = upto
            else:
                at += 1
        return out

    return by_doc.select("key1", "votes").mapInArrow(verify, f"doc_id long, n_words long, spans {span}")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["exact"])
    starts = F.transform(base, lambda s: s["start"].cast("long"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda s: s["label"]))), ",")
    return spans.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"))
