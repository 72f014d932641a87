"""Queries over the test tables and their SQL twins.

Doubles are rounded to six places, as sums run in another order in each engine;
counts and positions are longs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import sequence as q
from strandline.operators import batching, forward, labels, losses, selection
from strandline.plans import views
from strandline.plans.views import SQL, table
from strandline.schema import METRICS, RewardConfig
from strandline.scratch import cut
from strandline.sources.trajectories import toy_trajectories

CONFIG = RewardConfig(hidden_dim=views.DIM)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, and its SQL."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def six(x: Column) -> Column:
    """x as a double, rounded to six places as SQL does: what rounds to zero keeps its sign."""
    x = x.cast("double")
    scaled = F.abs(x) * 1e6
    return F.when(scaled < float("inf"), F.signum(x) * (F.round(scaled) / 1e6)).otherwise(x)


def r6(c, name: str) -> Column:
    return q.let(F.col(c) if isinstance(c, str) else c, six).alias(name)


def long(c, name: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("long").alias(name)


# Scores and selection


@query(SQL + "SELECT query_id, row_index, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_index) AS rn FROM rws) WHERE rn = 1")
def best_of_n(spark, d):
    scored = views.rows(spark, d).select("query_id", "row_index", "score")
    return selection.best_of_n(scored).where("selected").select("query_id", "row_index", r6("score", "score"))


@query(SQL + "SELECT query_id, row_index, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_index) = 1 AS selected FROM rws")
def best_of_n_flag(spark, d):
    scored = views.rows(spark, d).select("query_id", "row_index", "score")
    return selection.best_of_n(scored).select("query_id", "row_index", r6("score", "score"), "selected")


@query(SQL + "SELECT row_index, round(sum(gates * token_values) / greatest(sum(gates), 1e-8), 6) AS token_score FROM tok GROUP BY row_index")
def gate_weighted_score(spark, d):
    t = views.heads(spark, d)
    value = F.col("token_rewards") + views.PROGRESS_WEIGHT * F.col("progress")
    return t.groupBy("row_index").agg(r6(q.weighted_mean(value, q.sigmoid("gate_logits")), "token_score"))


@query(SQL + "SELECT row_index, pos, " + ", ".join(f"round({h}, 6) AS {h}" for h in views.HEADS) + " FROM heads")
def linear_heads(spark, d):
    return views.heads(spark, d).select("row_index", "pos", *[r6(h, h) for h in views.HEADS])


@query(SQL + "SELECT row_index, i::BIGINT AS dim, round(pooled[i + 1], 6) AS mean FROM by_row, range(64) AS x(i)")
def masked_mean(spark, d):
    return views.pooled(views.heads(spark, d)).select("row_index", F.posexplode("pooled").alias("dim", "mean")).select("row_index", long("dim", "dim"), r6("mean", "mean"))


@query(SQL + "SELECT row_index, pos, round(key_prior, 6) AS key_prior, round(complete_prior, 6) AS complete_prior FROM tok")
def masked_softmax(spark, d):
    return views.heads(spark, d).select("row_index", "pos", r6(q.softmax("key_prior_logits"), "key_prior"), r6(q.softmax("complete_prior_logits"), "complete_prior"))


@query(SQL + "SELECT row_index, pos, round(greatest(gate_logits, 0) / greatest(sum(greatest(gate_logits, 0)) OVER (PARTITION BY row_index), 1e-8), 6) AS attention FROM tok")
def normalize_attention(spark, d):
    return views.heads(spark, d).select("row_index", "pos", r6(q.normalize_attention("gate_logits"), "attention"))


@query(SQL + "SELECT row_index, pos, round(fused_prior, 6) AS fused_prior FROM tok")
def fused_prior(spark, d):
    return views.tokens(spark, d).select("row_index", "pos", r6("fused_prior", "fused_prior"))


@query(SQL + "SELECT row_index, round(sum(gates * fused_prior) / greatest(sum(gates), 1e-8), 6) AS alignment, round(avg(gates), 6) AS mean_gate FROM tok GROUP BY row_index")
def prior_gate_alignment(spark, d):
    return views.tokens(spark, d).groupBy("row_index").agg(r6(q.weighted_mean("fused_prior", "gates"), "alignment"), r6(F.avg("gates"), "mean_gate"))


# Events: sequences of a user, by time

EVENTS_SQL = """WITH seq AS (
  SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS pos, event_type, (value - 250) / 100 AS logit FROM events
)
"""


def event_tokens(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", long(F.row_number().over(order) - 1, "pos"), "event_type", ((F.col("value") - 250) / 100).alias("logit"))


@query(EVENTS_SQL + "SELECT user_id, round(1 - exp(sum(ln(1 - greatest(least(1 / (1 + exp(-logit)), 1 - 1e-6), 1e-6)))), 6) AS p FROM seq GROUP BY user_id")
def noisy_or_path_prob(spark, d):
    events = table(spark, d, "events").select("user_id", ((F.col("value") - 250) / 100).alias("logit"))
    return events.groupBy("user_id").agg(r6(q.noisy_or("logit"), "p"))


@query(EVENTS_SQL + "SELECT user_id, coalesce(min(pos) FILTER (WHERE 1 / (1 + exp(-logit)) >= 0.9), -1) AS onset FROM seq GROUP BY user_id")
def pseudo_onset(spark, d):
    return event_tokens(spark, d).groupBy("user_id").agg(q.first_crossing("logit", "pos", 0.9).alias("onset"))


@query(EVENTS_SQL + "SELECT user_id, onset, count(*) FILTER (WHERE pos >= onset) AS n_tail, round(avg(logit) FILTER (WHERE pos >= onset), 6) AS tail_mean FROM (SELECT *, min(CASE WHEN event_type = 'error' THEN pos END) OVER (PARTITION BY user_id) AS onset FROM seq) GROUP BY user_id, onset")
def tail_tokens(spark, d):
    t = event_tokens(spark, d)
    t = t.withColumn("onset", F.min(F.when(F.col("event_type") == "error", F.col("pos"))).over(Window.partitionBy("user_id")))
    tail = F.col("pos") >= F.col("onset")
    return t.groupBy("user_id", "onset").agg(F.count(F.when(tail, 1)).alias("n_tail"), r6(F.avg(F.when(tail, F.col("logit"))), "tail_mean"))


@query(SQL + "SELECT row_index, hallucination_onset::BIGINT AS onset, n_tokens::BIGINT AS n_tokens, coalesce(hallucination_onset >= n_tokens, false) AS invalid FROM rws")
def onset_validation(spark, d):
    return views.rows(spark, d).select("row_index", long("hallucination_onset", "onset"), long("n_tokens", "n_tokens"), F.coalesce(F.col("hallucination_onset") >= F.col("n_tokens"), F.lit(False)).alias("invalid"))


@query("SELECT conv_id, count(*) AS length, max(turn)::BIGINT AS last_turn FROM conversations GROUP BY conv_id")
def collate_shape(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("length"), long(F.max("turn"), "last_turn"))


# Losses by batch

BCE = "greatest({x}, 0) - {x} * {t} + ln(1 + exp(-abs({x})))"


def bce_sql(x: str, t: str) -> str:
    return "(" + BCE.format(x=x, t=t) + ")"


def mean_sql(value: str, where: str) -> str:
    return f"coalesce(avg({value}) FILTER (WHERE {where}), 0)"


LOSS_SQL = {
    "final": ("rws", f"CASE WHEN bool_or(correctness IS NOT NULL) THEN avg{bce_sql('score', 'coalesce(correctness, 0)')} ELSE 0 END"),
    "localization_token_bce": ("lab", f"CASE WHEN bool_or(onset_known) THEN {mean_sql(bce_sql('hallucination_logits', 'tail::INT'), 'onset_known')} ELSE 0 END"),
    "localization_token_reward": ("lab", f"CASE WHEN bool_or(onset_known) THEN {mean_sql('pow(token_values - CASE WHEN tail THEN -0.5 ELSE coalesce(adv, 0) END, 2)', 'adv IS NOT NULL OR tail')} ELSE 0 END"),
    "localization_tail_margin": ("lab", f"CASE WHEN bool_or(onset_known) THEN {mean_sql('pow(greatest(token_values + 0.5, 0), 2)', 'tail')} ELSE 0 END"),
    "progress": ("tok", mean_sql("pow(progress - prog, 2)", "prog IS NOT NULL")),
    "prior_key": ("tok", mean_sql(bce_sql("key_prior_logits", "key_t"), "key_t IS NOT NULL")),
    "prior_complete": ("tok", mean_sql(bce_sql("complete_prior_logits", "comp_t"), "comp_t IS NOT NULL")),
    "prior_distill": ("tok", f"2 * {mean_sql('pow(key_prior - complete_prior, 2)', 'key_t IS NOT NULL AND comp_t IS NOT NULL')}"),
    "prior_gate": ("(SELECT *, gates / greatest(sum(gates) OVER (PARTITION BY row_index), 1e-8) AS mass FROM tok)", mean_sql("pow(mass - fused_prior, 2)", "key_t IS NOT NULL AND comp_t IS NOT NULL")),
}
MIL_SQL = "SELECT batch_id, avg(-(y * greatest(ln(p), -100) + (1 - y) * greatest(ln(1 - p), -100))) AS v FROM (SELECT batch_id, row_index, any_value(path_hallucinated) AS y, 1 - exp(sum(ln(1 - greatest(least(1 / (1 + exp(-hallucination_logits)), 1 - 1e-6), 1e-6)))) AS p FROM lab WHERE path_hallucinated IS NOT NULL GROUP BY ALL) GROUP BY batch_id"
PSEUDO_SQL = "SELECT batch_id, avg(pow(greatest(token_values + 0.5, 0), 2)) AS v FROM (SELECT *, min(CASE WHEN 1 / (1 + exp(-hallucination_logits)) >= 0.5 THEN pos END) OVER (PARTITION BY row_index) AS start FROM lab WHERE path_hallucinated <> 0 AND NOT onset_known) WHERE pos >= start GROUP BY batch_id"
RECON_SQL = "SELECT batch_id, avg(pow(reconstruction[i + 1] - complete_reconstruction_target[i + 1], 2)) AS v FROM rws, range(64) AS x(i) WHERE complete_reconstruction_target IS NOT NULL GROUP BY batch_id"
PAIRS = "(SELECT a.batch_id, list_dot_product(a.representation, b.representation) AS near, a.score AS s, b.score AS t FROM rws a JOIN rws b ON a.batch_id = b.batch_id AND a.{same} = b.{same} AND a.{other} <> b.{other} AND a.row_index < b.row_index WHERE a.{same} IS NOT NULL)"
POSITIVE_SQL = "SELECT batch_id, avg(1 - near) AS v FROM " + PAIRS.format(same="semantic_key", other="style_key") + " GROUP BY batch_id"
NEGATIVE_SQL = "SELECT batch_id, avg(greatest(near - 0.2, 0)) AS v FROM " + PAIRS.format(same="style_key", other="semantic_key") + " GROUP BY batch_id"
SCORE_SQL = "SELECT batch_id, avg(pow(s - t, 2)) AS v FROM " + PAIRS.format(same="semantic_key", other="style_key") + " GROUP BY batch_id"

SPARSE_SQL = {"hallucination_mil": MIL_SQL, "pseudo_tail": PSEUDO_SQL, "prior_reconstruction": RECON_SQL, "consistency_positive": POSITIVE_SQL, "consistency_negative": NEGATIVE_SQL, "consistency_score": SCORE_SQL}


def loss_sql(metric: str, alias: str = "value") -> str:
    if metric in LOSS_SQL:
        source, value = LOSS_SQL[metric]
        return f"SELECT batch_id, {value} AS {alias} FROM {source} GROUP BY batch_id"
    return f"SELECT b.batch_id, coalesce(v, 0) AS {alias} FROM (SELECT DISTINCT batch_id FROM rws) b LEFT JOIN ({SPARSE_SQL[metric]}) x ON b.batch_id = x.batch_id"


def all_losses_sql() -> str:
    """CTEs with every metric by batch."""
    basic = [*LOSS_SQL, *SPARSE_SQL]
    parts = ", ".join(f"m_{m} AS ({loss_sql(m)})" for m in basic)
    joins = " ".join(f"JOIN m_{m} ON m_{m}.batch_id = n.batch_id" for m in basic)
    values = ", ".join(f"m_{m}.value AS {m}" for m in basic)
    return (
        SQL
        + f", {parts}, n AS (SELECT batch_id, count(*) AS batch_size FROM rws GROUP BY batch_id), one AS (SELECT n.batch_id, n.batch_size, {values} FROM n {joins}), two AS (SELECT *, consistency_positive + consistency_negative + 0.1 * consistency_score AS consistency_total, prior_key + prior_complete + 0.25 * prior_distill + 0.25 * prior_gate + 0.1 * prior_reconstruction AS prior_total FROM one), loss AS (SELECT *, final + consistency_total + localization_token_bce + 0.5 * localization_token_reward + 0.5 * localization_tail_margin + 0.25 * hallucination_mil + 0.1 * pseudo_tail + 0.25 * progress + 0.25 * prior_total AS total FROM two) "
    )


def labelled(spark, d):
    return losses.labelled_tokens(views.rows(spark, d), views.tokens(spark, d))


def sparse(spark, d, part: DataFrame, metric: str) -> DataFrame:
    """A metric for every batch, 0 where no row of the batch has it."""
    batches = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / (views.PER_ROW * views.PER_BATCH)).alias("batch_id")).distinct()
    return batches.join(part, "batch_id", "left").select("batch_id", r6(F.coalesce(metric, F.lit(0.0)), "value"))


def of_tokens(term: Callable[[], Column]) -> Callable:
    return lambda s, d: losses.token_losses(losses.prepared(labelled(s, d)), term())


def of_priors(k: int) -> Callable:
    return lambda s, d: losses.token_losses(views.tokens(s, d).withColumn("gate_mass", q.normalize_attention("gates")), losses.prior_terms()[k])


LOSSES: dict[str, tuple[str, Callable]] = {
    "correctness_bce": ("final", lambda s, d: views.rows(s, d).groupBy("batch_id").agg(losses.final_term())),
    "token_bce": ("localization_token_bce", lambda s, d: losses.token_losses(labelled(s, d), losses.localization_terms(0.5)[0])),
    "token_reward_mse": ("localization_token_reward", lambda s, d: losses.token_losses(labelled(s, d), losses.localization_terms(0.5)[1])),
    "tail_margin": ("localization_tail_margin", lambda s, d: losses.token_losses(labelled(s, d), losses.localization_terms(0.5)[2])),
    "mil_loss": ("hallucination_mil", of_tokens(losses.mil_term)),
    "pseudo_tail": ("pseudo_tail", of_tokens(lambda: losses.pseudo_tail_term(0.5))),
    "progress_mse": ("progress", lambda s, d: losses.token_losses(views.tokens(s, d), losses.progress_term())),
    "key_prior_bce": ("prior_key", of_priors(0)),
    "complete_prior_bce": ("prior_complete", of_priors(1)),
    "distill_mse": ("prior_distill", of_priors(2)),
    "gate_prior_mse": ("prior_gate", of_priors(3)),
    "reconstruction_mse": ("prior_reconstruction", lambda s, d: losses.reconstruction_loss(views.rows(s, d))),
    "consistency_positive": ("consistency_positive", lambda s, d: losses.consistency_losses(views.rows(s, d), CONFIG)),
    "consistency_negative": ("consistency_negative", lambda s, d: losses.consistency_losses(views.rows(s, d), CONFIG)),
    "consistency_score": ("consistency_score", lambda s, d: losses.consistency_losses(views.rows(s, d), CONFIG)),
}


def _add_losses() -> None:
    for name, (metric, part) in LOSSES.items():
        query(SQL + f"SELECT batch_id, round(value, 6) AS value FROM ({loss_sql(metric)})", name)(lambda s, d, m=metric, p=part: sparse(s, d, p(s, d), m))


_add_losses()


@query(all_losses_sql() + "SELECT batch_id, batch_size, " + ", ".join(f"round({m}, 6) AS {m}" for m in METRICS) + " FROM loss")
def total_objective(spark, d):
    out = losses.losses(cut(views.rows(spark, d), "rows"), views.tokens(spark, d), CONFIG)
    return out.select("batch_id", "batch_size", *[r6(m, m) for m in METRICS])


@query(all_losses_sql() + "SELECT batch_id, round(consistency_total, 6) AS consistency_total, round(prior_total, 6) AS prior_total FROM loss")
def consistency_total(spark, d):
    rows = cut(views.rows(spark, d), "rows")
    prior = losses.prior_losses(rows, views.tokens(spark, d), CONFIG)
    return losses.consistency_losses(rows, CONFIG).join(prior, "batch_id").select("batch_id", r6("consistency_total", "consistency_total"), r6("prior_total", "prior_total"))


@query(all_losses_sql() + "SELECT " + ", ".join(f"round(sum({m} * batch_size) / greatest(sum(batch_size), 1), 6) AS {m}" for m in METRICS) + " FROM loss")
def epoch_weighted_mean(spark, d):
    means = losses.epoch_means(losses.losses(cut(views.rows(spark, d), "rows"), views.tokens(spark, d), CONFIG))
    return means.select(*[r6(m, m) for m in METRICS])


# Labels of documents, with gaps

DOCS_SQL = "WITH d AS (SELECT doc_id, doc_id // 16 AS batch_id, source AS semantic_key, lang AS style_key, quality::DOUBLE AS correctness, toxic::DOUBLE AS path_hallucinated FROM documents LEFT JOIN labels USING (doc_id)) "


def labelled_documents(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return docs.select("doc_id", F.floor(F.col("doc_id") / 16).alias("batch_id"), F.col("source").alias("semantic_key"), F.col("lang").alias("style_key"), F.col("quality").cast("double").alias("correctness"), F.col("toxic").cast("double").alias("path_hallucinated"))


@query(DOCS_SQL + "SELECT batch_id, doc_id, coalesce(correctness, 0) AS correctness, correctness IS NOT NULL AS correctness_mask, bool_or(correctness IS NOT NULL) OVER (PARTITION BY batch_id) AS in_batch FROM d")
def optional_masks(spark, d):
    return labels.optional_column(labelled_documents(spark, d), "correctness").select("batch_id", "doc_id", "correctness", "correctness_mask", F.col("correctness_present").alias("in_batch"))


@query("WITH d AS (SELECT doc_id, doc_id // 16 AS batch_id, source FROM documents), f AS (SELECT *, min(doc_id) OVER (PARTITION BY batch_id, source) AS first FROM d) SELECT batch_id, doc_id, source, CASE WHEN source IS NULL THEN 0 ELSE dense_rank() OVER (PARTITION BY batch_id ORDER BY first) END::BIGINT AS code, source IS NOT NULL AS present FROM f")
def encode_ids(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 16).alias("batch_id"), "source")
    return labels.encode_ids(docs, "source", row="doc_id").select("batch_id", "doc_id", "source", "code", "present")


@query("SELECT vec_id, list_transform(range(80), lambda i: CASE WHEN i < 64 THEN round(embedding[i + 1]::DOUBLE, 6) ELSE 0 END) AS padded, list_transform(embedding[1:5]::DOUBLE[], lambda x: round(x, 6)) AS trimmed FROM embeddings")
def pad_or_trim(spark, d):
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.transform(q.pad_or_trim(doubles, 80), six).alias("padded"), F.transform(q.pad_or_trim(doubles, 5), six).alias("trimmed"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN source END WHEN doc_id % 3 = 1 THEN lang END AS semantic_id FROM documents")
def alias_resolution(spark, d):
    """A key that is present but null shadows later names."""
    docs = table(spark, d, "documents")
    first = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('"'), "source", F.lit('"'))).otherwise(F.lit("null"))
    second = F.concat(F.lit('"'), "lang", F.lit('"'))
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"semantic_id":'), first, F.lit(',"group_id":'), second, F.lit("}"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('{"group_id":'), second, F.lit("}"))).otherwise(F.lit("{}"))
    return docs.select("doc_id", labels.first_present(raw, "semantic_id").alias("semantic_id"))


# Batch plans


@query("SELECT doc_id // 32 AS batch_id, doc_id % 32 AS slot, doc_id AS row_index FROM documents")
def sequential_batches(spark, d):
    return batching.sequential_batches(table(spark, d, "documents").select("doc_id"), 32, "doc_id")


def grouped_customers(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("row_index"), F.when(F.col("c_custkey") % 10 != 0, F.col("c_nationkey").cast("string")).alias("semantic_key"))


CHUNKS_SQL = "WITH k AS (SELECT c_custkey::BIGINT AS row_index, CASE WHEN c_custkey % 10 <> 0 THEN 'key:' || c_nationkey ELSE 'row:' || c_custkey END AS group_key FROM customer), p AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY row_index) - 1 AS rank, count(*) OVER (PARTITION BY group_key) AS n FROM k), c AS (SELECT *, least(4, n - rank // 4 * 4) AS size FROM p) SELECT row_index, group_key, CASE WHEN size >= 2 THEN rank // 4 END::BIGINT AS chunk, CASE WHEN size >= 2 THEN size ELSE 1 END::BIGINT AS chunk_size FROM c"


@query(CHUNKS_SQL)
def group_chunks(spark, d):
    return batching.group_chunks(grouped_customers(spark, d), 8).select("row_index", "group_key", "chunk", "chunk_size")


@query()
def pack_batches(spark, d):
    return batching.plan_batches(grouped_customers(spark, d), 8)


@query()
def shuffled_batches(spark, d):
    return batching.plan_loader(grouped_customers(spark, d), 8, shuffle=True, group_by_semantic=True, seed=3, epoch=1)


@query("SELECT count(*) - greatest(1, (count(*) * 0.2)::INT) AS n_train, greatest(1, floor(count(*) * 0.2)::INT)::BIGINT AS n_val, count(*) AS n FROM documents")
def train_val_split(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("row_index"))
    train, val = batching.split(rows, 0.2, seed=1)
    both = train.withColumn("v", F.lit(0)).union(val.withColumn("v", F.lit(1)))
    return both.agg(F.count(F.when(F.col("v") == 0, 1)).alias("n_train"), F.count(F.when(F.col("v") == 1, 1)).alias("n_val"), F.count("*").alias("n"))


# Vectors and the model


@query("SELECT vec_id, list_transform(list_transform(embedding::DOUBLE[], lambda x: x / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)), lambda x: round(x, 6)) AS unit FROM embeddings")
def l2_normalize(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform(q.l2_normalize("embedding"), six).alias("unit"))


@query("WITH m AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_avg(embedding::DOUBLE[]) AS mean FROM embeddings), v AS (SELECT *, list_avg(list_transform(e, lambda x: (x - mean) * (x - mean))) AS var FROM m) SELECT vec_id, list_transform(e, lambda x: round((x - mean) / sqrt(var + 1e-5), 6)) AS normed FROM v")
def layer_norm(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform(q.layer_norm("embedding"), six).alias("normed"))


@query(SQL + ", cond AS (SELECT row_index, pos AS cpos, embedding AS c FROM heads WHERE pos < 3), pair AS (SELECT t.row_index, t.pos, cpos, list_dot_product(t.embedding::DOUBLE[], c::DOUBLE[]) / (sqrt(list_dot_product(t.embedding::DOUBLE[], t.embedding::DOUBLE[])) * sqrt(list_dot_product(c::DOUBLE[], c::DOUBLE[]))) AS sim FROM heads t JOIN cond USING (row_index)) SELECT row_index, pos, round(sum(sim * exp(sim)) / sum(exp(sim)), 6) AS relevance FROM pair GROUP BY row_index, pos")
def cross_attention(spark, d):
    """Each token attends to the first three tokens of its own row."""
    t = views.heads(spark, d).select("row_index", "pos", q.l2_normalize(F.col("embedding")).alias("h"))
    cond = t.where("pos < 3").select("row_index", F.col("h").alias("c"))
    sim = t.join(cond, "row_index").select("row_index", "pos", q.dot(F.col("h"), F.col("c")).alias("sim"))
    return sim.groupBy("row_index", "pos").agg(r6(F.sum(F.col("sim") * F.exp("sim")) / F.sum(F.exp("sim")), "relevance"))


def model_rows(spark, d):
    """Trajectories with condition tokens for every second row."""
    t = views.heads(spark, d).groupBy("row_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "embedding"))), lambda s: s["embedding"]).alias("hidden_states"))
    cond = F.when(F.col("row_index") % 2 == 0, F.slice("hidden_states", 1, 2))
    return t.select("row_index", F.floor(F.col("row_index") / views.PER_QUERY).cast("string").alias("query_id"), "hidden_states", cond.alias("condition_states"), F.lit(None).cast("array<float>").alias("condition_embedding"))


MODEL = RewardConfig(hidden_dim=views.DIM, projection_dim=16, condition_attention_dim=16)


@query()
def conditioned_forward(spark, d):
    out = forward.forward(model_rows(spark, d), forward.initial(MODEL), MODEL)
    return out.select("row_index", "query_id", long("n_tokens", "n_tokens"), r6("score", "score"), r6("token_score", "token_score"), r6("score_residual", "score_residual"))


@query()
def score_report(spark, d):
    return selection.score_report(forward.forward(model_rows(spark, d), forward.initial(MODEL), MODEL))


@query("WITH t AS (SELECT * FROM range(6) AS x(i)) SELECT i::BIGINT AS row_index, 'toy-' || (i // 2) AS query_id, (5 + i % 2)::BIGINT AS n_tokens, 1.0::DOUBLE - i % 2 AS correctness, CASE WHEN i % 2 = 1 THEN 3 ELSE -1 END::BIGINT AS onset FROM t")
def toy_source(spark, d):
    return toy_trajectories(spark).select("row_index", "query_id", long(F.size("hidden_states"), "n_tokens"), "correctness", long("hallucination_onset", "onset"))


# Evaluation: additions that the method's description plans


@query(SQL + ", best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_index) AS rn FROM rws) SELECT round(avg(correctness), 6) AS accuracy, round(avg(path_hallucinated), 6) AS hallucination_rate, count(*) AS n FROM best WHERE rn = 1")
def best_of_n_accuracy(spark, d):
    rows = views.rows(spark, d).select("query_id", "row_index", "score", "correctness", "path_hallucinated")
    best = selection.winners(rows)
    return best.agg(r6(F.avg("correctness"), "accuracy"), r6(F.avg("path_hallucinated"), "hallucination_rate"), F.count("*").alias("n"))


@query(SQL + "SELECT semantic_key, round(var_pop(score), 6) AS score_variance, round(min(correctness), 6) AS worst FROM rws WHERE semantic_key IS NOT NULL GROUP BY semantic_key")
def rewrite_stability(spark, d):
    rows = views.rows(spark, d).where("semantic_key is not null")
    return rows.groupBy("semantic_key").agg(r6(F.var_pop("score"), "score_variance"), r6(F.min("correctness"), "worst"))
