"""Rollout analytics over tokens derived from ``lineitem`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from sqltally.operators import rollout
from sqltally.plans import views
from sqltally.plans.registry import query

T = views.TOKENS
GAMMA, LAM, BETA, CLIP = 0.99, 0.95, 0.1, 0.02


#: keeps values on an exact decimal grid off the rounding boundary
NUDGE = 1.234567891234e-9


def _round(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query(
    "rl1_masked_stats",
    f"""WITH {T} SELECT step, round(sum(score), 4) AS sum, round(avg(score), 6) AS mean, round(var_samp(score), 6) AS var
FROM tok WHERE mask = 1 GROUP BY 1""",
)
def masked_stats(spark, sf):
    out = rollout.masked_stats(views.tokens(spark, sf, True), "score", ("step",))
    return out.select("step", F.round("sum", 4).alias("sum"), F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))


@query(
    "rl2_whiten",
    f"""WITH {T}, s AS (SELECT avg(score) AS m, var_samp(score) AS v FROM tok WHERE mask = 1)
SELECT seq_id, t, round((score - m) / sqrt(v + 1e-8), 6) AS score FROM tok, s""",
)
def whiten(spark, sf):
    out = rollout.whiten(views.tokens(spark, sf), "score")
    return out.select("seq_id", "t", F.round("score", 6).alias("score"))


@query(
    "rl3_group_advantage",
    f"""WITH {T}, q AS (SELECT seq_id, group_id, sum(score) AS s FROM tok GROUP BY 1, 2),
g AS (SELECT group_id, CASE WHEN count(*) = 1 THEN 0 ELSE avg(s) END AS m, CASE WHEN count(*) = 1 THEN 1 ELSE stddev_samp(s) END AS sd FROM q GROUP BY 1)
SELECT seq_id, group_id, round((s - m) / (sd + 1e-6), 5) AS adv FROM q JOIN g USING (group_id)""",
)
def group_advantage(spark, sf):
    scores = rollout.sequence_scores(views.tokens(spark, sf, True), keep=("group_id",))
    return _round(rollout.group_advantage(scores), "adv", digits=5)


GAE = f"""{T}, d AS (
  SELECT seq_id, t, mask, value, score + {GAMMA} * coalesce(lead(value) OVER (PARTITION BY seq_id ORDER BY t), 0) - value AS delta FROM tok),
raw AS (
  SELECT a.seq_id, a.t, any_value(a.mask) AS mask, any_value(a.value) AS value,
         sum(b.delta * pow({GAMMA} * {LAM}, b.t - a.t)) AS adv
  FROM d a JOIN d b ON a.seq_id = b.seq_id AND b.t >= a.t GROUP BY 1, 2),
st AS (SELECT avg(adv) AS m, var_samp(adv) AS v FROM raw WHERE mask = 1),
gae AS (SELECT seq_id, t, mask, value, adv + value AS ret, (adv - m) / sqrt(v + 1e-8) AS adv FROM raw, st)"""


@query(
    "rl4_gae",
    f"WITH {GAE} SELECT seq_id, t, round(adv + {NUDGE}, 5) AS adv, round(ret + {NUDGE}, 5) AS ret FROM gae",
)
def gae(spark, sf):
    out = rollout.gae(views.tokens(spark, sf), GAMMA, LAM)
    out = out.select("seq_id", "t", (F.col("adv") + NUDGE).alias("adv"), (F.col("ret") + NUDGE).alias("ret"))
    return _round(out, "adv", "ret", digits=5)


@query(
    "rl5_discounted_return",
    f"""WITH {T}, raw AS (
  SELECT a.seq_id, a.t, any_value(a.mask) AS mask,
         CASE WHEN any_value(a.mask) = 0 THEN any_value(a.score)
              ELSE sum(CASE WHEN b.mask = 1 THEN b.score * pow({GAMMA}, b.t - a.t) ELSE 0 END) END AS ret
  FROM tok a JOIN tok b ON a.seq_id = b.seq_id AND b.t >= a.t GROUP BY 1, 2),
st AS (SELECT avg(ret) AS m, var_samp(ret) AS v FROM raw WHERE mask = 1)
SELECT seq_id, t, round(ret + {NUDGE}, 5) AS ret, round(CASE WHEN mask = 1 THEN (ret - m) / sqrt(v + 1e-8) ELSE 0 END + {NUDGE}, 5) AS adv FROM raw, st""",
)
def discounted_return(spark, sf):
    out = rollout.discounted_return(views.tokens(spark, sf), GAMMA)
    out = out.select("seq_id", "t", (F.col("ret") + NUDGE).alias("ret"), (F.col("adv") + NUDGE).alias("adv"))
    return _round(out, "ret", "adv", digits=5)


KL = """CASE WHEN mask = 1 THEN least(10.0, greatest(-10.0, exp(ref_logp - old_logp) - (ref_logp - old_logp) - 1)) ELSE 0 END"""


@query(
    "rl7_penalized_rewards",
    f"WITH {T} SELECT seq_id, t, round({KL}, 8) AS kl, round(score - {BETA} * {KL}, 8) AS reward FROM tok",
)
def penalized_rewards(spark, sf):
    out, _ = rollout.penalized_rewards(views.tokens(spark, sf), BETA, "low_var_kl")
    return _round(out.select("seq_id", "t", "kl", "reward"), "kl", "reward", digits=8)


STEP_KL = f"""{T}, sq AS (SELECT seq_id, step, sum((old_logp - ref_logp) * mask) / sum(mask) AS kl FROM tok GROUP BY 1, 2),
stp AS (SELECT step, avg(kl) AS kl, count(*) AS n FROM sq GROUP BY 1)"""


@query(
    "rl7_batch_kl",
    f"WITH {STEP_KL} SELECT step, round(kl, 8) AS kl, n AS n_seqs, CAST({BETA} AS DOUBLE) AS kl_coeff FROM stp",
)
def batch_kl(spark, sf):
    _, metrics = rollout.penalized_rewards(views.tokens(spark, sf, True), BETA, "kl", ("step",))
    return _round(metrics, "kl", digits=8)


@query(
    "rl8_adaptive_coef",
    f"""WITH {STEP_KL}, m AS (SELECT step, 1 + least(0.2, greatest(-0.2, abs(kl) / 0.002 - 1)) * CASE WHEN step % 2 = 0 THEN 100000 ELSE n END / 10000 AS mult FROM stp)
SELECT step, round(0.2 * product(mult) OVER (ORDER BY step), 8) AS coef FROM m""",
)
def adaptive_coef(spark, sf):
    """Every second step counts ten horizons of tokens, so that factors turn negative."""
    _, metrics = rollout.penalized_rewards(views.tokens(spark, sf, True), BETA, "kl", ("step",))
    steps = metrics.select("step", F.abs("kl").alias("kl"), F.col("n_seqs").alias("n"))
    scaled = steps.withColumn("n", F.when(F.col("step") % 2 == 0, F.lit(100000)).otherwise(F.col("n")))
    out = rollout.adaptive_coef(scaled, init=0.2, target=0.002, horizon=10000)
    return out.select("step", F.round("coef", 8).alias("coef"))


LOSS = f"""{T}, pt AS (
  SELECT step, mask, -(logp - old_logp) AS kl, -(score - 0.5) * exp(logp - old_logp) AS l1,
         -(score - 0.5) * least(1 + {CLIP}, greatest(1 - {CLIP}, exp(logp - old_logp))) AS l2, logp, ref_logp, value FROM tok)"""


@query(
    "rl9_policy_loss",
    f"""WITH {LOSS} SELECT step, round(avg(greatest(l1, l2)), 6) AS loss, round(avg(CASE WHEN l2 > l1 THEN 1.0 ELSE 0.0 END), 6) AS clip_frac,
  round(avg(kl), 6) AS kl FROM pt WHERE mask = 1 GROUP BY 1""",
)
def policy_loss(spark, sf):
    tokens = views.tokens(spark, sf, True).withColumn("adv", F.col("score") - 0.5)
    return _round(rollout.policy_loss(tokens, CLIP, ("step",)), "loss", "clip_frac", "kl")


@query(
    "rl10_value_loss",
    f"""WITH {T}, v AS (
  SELECT step, pow(value + logp - score, 2) AS a,
         pow(greatest(least(value + logp, value + {CLIP}), value - {CLIP}) - score, 2) AS b FROM tok WHERE mask = 1)
SELECT step, round(0.5 * avg(greatest(a, b)), 6) AS loss, round(avg(CASE WHEN b > a THEN 1.0 ELSE 0.0 END), 6) AS clip_frac FROM v GROUP BY 1""",
)
def value_loss(spark, sf):
    tokens = views.tokens(spark, sf, True).withColumns(
        {"vpred": F.col("value") + F.col("logp"), "ret": F.col("score")}
    )
    return _round(rollout.value_loss(tokens, CLIP, ("step",)), "loss", "clip_frac")


ENTROPY = """lse AS (
  SELECT vec_id, label, [CAST(x AS DOUBLE) for x in embedding] AS e FROM embeddings),
ent AS (
  SELECT vec_id, label, e[label + 1] - ln(list_sum([exp(x) for x in e])) AS logprob,
         ln(list_sum([exp(x) for x in e])) - list_sum([exp(x) * x for x in e]) / list_sum([exp(x) for x in e]) AS entropy FROM lse)"""


def _logits(spark, sf):
    return views.table(spark, sf, "embeddings").withColumn("mask", (F.col("vec_id") % 5 != 0).cast("int"))


@query(
    "rl11_logprob_entropy",
    f"WITH {ENTROPY} SELECT vec_id, round(logprob, 6) AS logprob, round(entropy, 6) AS entropy FROM ent",
)
def logprob_entropy(spark, sf):
    out, _ = rollout.logprob_entropy(_logits(spark, sf), "embedding", "label", ("label",))
    return _round(out.select("vec_id", "logprob", "entropy"), "logprob", "entropy")


@query(
    "rl11_label_means",
    f"WITH {ENTROPY} SELECT label, round(avg(logprob), 6) AS logprob, round(avg(entropy), 6) AS entropy FROM ent WHERE vec_id % 5 <> 0 GROUP BY 1",
)
def label_means(spark, sf):
    _, means = rollout.logprob_entropy(_logits(spark, sf), "embedding", "label", ("label",))
    return _round(means, "logprob", "entropy")




@query(
    "rl12_batch_metrics",
    f"""WITH {T}, w AS (SELECT *, score - 0.1 * mask AS reward, score - 0.5 AS adv, score AS ret, 3 + seq_id % 4 AS prompt_len FROM tok),
sq AS (SELECT step, seq_id, sum(score) AS score, sum(reward) AS reward, sum(mask) AS rl, count(*) AS width, max(prompt_len) AS pl FROM w GROUP BY 1, 2),
mx AS (SELECT step, max(width) AS mw, max(pl) AS mp FROM sq GROUP BY 1),
a AS (
  SELECT step, avg(score) AS "critic/score/mean", max(score) AS "critic/score/max", min(score) AS "critic/score/min",
    avg(reward) AS "critic/rewards/mean", max(reward) AS "critic/rewards/max", min(reward) AS "critic/rewards/min",
    avg(rl) AS "response_length/mean", CAST(max(rl) AS DOUBLE) AS "response_length/max", CAST(min(rl) AS DOUBLE) AS "response_length/min",
    avg(pl) AS "prompt_length/mean", CAST(max(pl) AS DOUBLE) AS "prompt_length/max", CAST(min(pl) AS DOUBLE) AS "prompt_length/min",
    avg(CASE WHEN rl = mw THEN 1.0 ELSE 0.0 END) AS "response_length/clip_ratio", avg(CASE WHEN pl = mp THEN 1.0 ELSE 0.0 END) AS "prompt_length/clip_ratio"
  FROM sq JOIN mx USING (step) GROUP BY 1),
b AS (
  SELECT step, avg(adv) AS "critic/advantages/mean", max(adv) AS "critic/advantages/max", min(adv) AS "critic/advantages/min",
    avg(ret) AS "critic/returns/mean", max(ret) AS "critic/returns/max", min(ret) AS "critic/returns/min",
    avg(value) AS "critic/values/mean", max(value) AS "critic/values/max", min(value) AS "critic/values/min",
    1 - var_samp(ret - value) / (var_samp(ret) + 1e-5) AS "critic/vf_explained_var"
  FROM w WHERE mask = 1 GROUP BY 1),
j AS (SELECT * FROM a JOIN b USING (step))
SELECT step, name, round(value, 6) AS value FROM (UNPIVOT j ON COLUMNS(* EXCLUDE (step)) INTO NAME name VALUE value)""",
)
def batch_metrics(spark, sf):
    tokens = views.tokens(spark, sf, True).withColumns(
        {
            "reward": F.col("score") - 0.1 * F.col("mask"),
            "adv": F.col("score") - 0.5,
            "ret": F.col("score"),
            "prompt_len": 3 + F.col("seq_id") % 4,
        }
    )
    return _round(rollout.batch_metrics(tokens), "value")


def _years(spark, sf):
    return views.table(spark, sf, "orders").select(
        F.year("o_orderdate").alias("step"), "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"
    )


SECTIONS = "['gen','ref','adv','update_actor','testing'][o_custkey % 5 + 1]"


def _timings(spark, sf):
    names = F.array(*[F.lit(s) for s in ("gen", "ref", "adv", "update_actor", "testing")])
    return (
        _years(spark, sf)
        .groupBy("step", F.element_at(names, (F.col("o_custkey") % 5 + 1).cast("int")).alias("section"))
        .agg((F.sum("o_totalprice") / 1e6).alias("seconds"))
    )


@query(
    "rl13_timing_metrics",
    f"""WITH tm AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS step, {SECTIONS} AS section, sum(o_totalprice) / 1e6 AS seconds FROM orders GROUP BY 1, 2),
ln AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS step, sum(o_custkey % 100) AS p, sum(o_orderkey % 300) AS r FROM orders GROUP BY 1),
m AS (
  SELECT step, 'timing_s/' || section AS name, seconds AS value FROM tm
  UNION ALL SELECT step, 'timing_per_token_ms/' || section, seconds * 1000 / CASE section WHEN 'gen' THEN r ELSE p + r END
  FROM tm JOIN ln USING (step) WHERE section <> 'testing')
SELECT step, name, round(value, 6) AS value FROM m""",
)
def timing_metrics(spark, sf):
    lengths = _years(spark, sf).select(
        "step", (F.col("o_custkey") % 100).alias("prompt_tokens"), (F.col("o_orderkey") % 300).alias("response_tokens")
    )
    return _round(rollout.timing_metrics(_timings(spark, sf), lengths), "value")


@query(
    "rl14_mean_metrics",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS step, o_orderpriority AS name, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1, 2""",
)
def mean_metrics(spark, sf):
    logged = _years(spark, sf).select(
        "step", F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("value")
    )
    return _round(rollout.mean_metrics(logged), "value", digits=4)


MODEL = {"hidden": 1536, "layers": 28, "heads": 12, "kv_heads": 2, "intermediate": 8960, "vocab": 151936}


@query(
    "rl15_flops_rate",
    """WITH m AS (
  SELECT 28.0 * (3.0 * 1536 * 8960 + 1536.0 * 128 * (2 * 12 + 2 * 2)) + 2.0 * 151936 * 1536 AS n, 12.0 * 128 * 12 * 28 AS a),
l AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS step, sum(CAST(o_orderkey % 3000 AS DOUBLE)) AS s,
         sum(CAST(o_orderkey % 3000 AS DOUBLE) * (o_orderkey % 3000)) AS s2, sum(o_totalprice) / 1e6 AS sec FROM orders GROUP BY 1)
SELECT step, round(CAST((6.0 * n * s + a * s2) / sec / 1e12 AS DOUBLE), 6) AS tflops FROM l, m""",
)
def flops_rate(spark, sf):
    years = _years(spark, sf)
    lengths = years.select("step", (F.col("o_orderkey") % 3000).alias("len"))
    timings = years.groupBy("step").agg((F.sum("o_totalprice") / 1e6).alias("seconds"))
    return _round(rollout.flops_rate(lengths, timings, MODEL), "tflops")


@query(
    "rl16_loss_report",
    f"""WITH {LOSS}, p AS (
  SELECT step, avg(greatest(l1, l2)) AS pg, avg(CASE WHEN l2 > l1 THEN 1.0 ELSE 0.0 END) AS cf, avg(kl) AS ak, avg(value) AS en,
         avg(least(10.0, greatest(-10.0, exp(ref_logp - logp) - (ref_logp - logp) - 1))) AS kl
  FROM pt WHERE mask = 1 GROUP BY 1)
SELECT step, round(pg, 6) AS pg_loss, round(cf, 6) AS pg_clipfrac, round(ak, 6) AS ppo_kl, round(en, 6) AS entropy_loss,
       round(kl, 8) AS kl_loss, round(pg - en * 0.001 - kl * 0.01, 6) AS loss FROM p""",
)
def loss_report(spark, sf):
    tokens = views.tokens(spark, sf, True).withColumns(
        {"adv": F.col("score") - 0.5, "entropy": F.col("value")}
    )
    out = rollout.loss_report(tokens, ("step",), CLIP, 0.001, 0.01)
    out = _round(out, "pg_loss", "pg_clipfrac", "ppo_kl", "entropy_loss", "loss")
    return _round(out, "kl_loss", digits=8)
