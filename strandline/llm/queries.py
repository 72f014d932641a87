"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from strandline.llm import licenses, merkle, mixing, packing, pii, quality, repeats, secrets, simhash, vectors


def queries() -> dict:
    return {
        "op1_pack": packing.op1_pack,
        "op2_pii": pii.op2_pii,
        "op3_merkle": merkle.op3_merkle,
        "op4_simhash": simhash.op4_simhash,
        "op5_vectors": vectors.op5_vectors,
        "op6_repeats": repeats.op6_repeats,
        "op7_mix": mixing.op7_mix,
        "op8_quality": quality.op8_quality,
        "op9_licenses": licenses.op9_licenses,
        "op10_secrets": secrets.op10_secrets,
        "pipeline": corpus_pipeline.run,
    }


#: merkle.PIECE without look-behind and possessive repeats, which RE2 does not know.
_PIECE = r"[\x20\x09\x0B-\x0D]*(?:[^\x20\x09-\x0D]+(?:[\x20\x09\x0B-\x0D]+|\z)){1,3}(?:[^\x20\x09-\x0D]*[^\x20\x09-\x0D%s](?:[\x20\x09\x0B-\x0D]+|\z)){0,12}(?:[^\x20\x09-\x0D]+(?:[\x20\x09\x0B-\x0D]+|\z))?|[\x20\x09\x0B-\x0D]+" % merkle.ENDS


def _root(x: str) -> str:
    """SQL for the root of a text's tree."""
    nodes = f"list_transform(string_split({x}, chr(10)), lambda p: sha256(array_to_string(list_transform(regexp_extract_all(p, '{_PIECE}'), lambda w: sha256(w)), '')))"
    sections = f"list_transform(range((len({nodes}) + 7) // 8), lambda i: sha256(array_to_string(({nodes})[i * 8 + 1:i * 8 + 8], '')))"
    return f"sha256(array_to_string({sections}, ''))"


def _pieces(x: str) -> str:
    return f"list_distinct(flatten(list_transform(string_split({x}, chr(10)), lambda p: regexp_extract_all(p, '{_PIECE}'))))"


def _likeness(a: str, b: str) -> str:
    return f"CASE WHEN root_{a} = root_{b} THEN 1.0 WHEN len(pieces_{a}) + len(pieces_{b}) = 0 THEN 0.0 ELSE 2.0::DOUBLE * len(list_intersect(pieces_{a}, pieces_{b})) / (len(pieces_{a}) + len(pieces_{b})) END::DOUBLE"


MERKLE_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, length(t)::BIGINT AS n_chars, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS x FROM d),
e AS (SELECT *, left(t, n_chars - n_chars // 4) || left(x, n_chars // 4) AS e FROM n),
h AS (SELECT doc_id, n_chars, sha256(e) AS edited_sha256, {", ".join(f"{_root(c)} AS root_{c}, {_pieces(c)} AS pieces_{c}" for c in "tex")} FROM e)
SELECT doc_id, n_chars, edited_sha256, root_t AS fingerprint, root_e AS edited_fingerprint, {_likeness("t", "e")} AS near_edited, {_likeness("t", "x")} AS near_next FROM h"""

VECTORS_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id), k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.id AS vec_id, coalesce(k.n, 0)::BIGINT AS n_links, c.root AS component_id, c.id = c.root AS kept FROM c LEFT JOIN k ON k.a = c.id"""

REPEATS_SQL = r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY s) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM rep, range(35) AS x(j)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS s, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def oracle_sql() -> dict:
    out = {"op3_merkle": MERKLE_SQL, "op5_vectors": VECTORS_SQL, "op6_repeats": REPEATS_SQL}
    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
