"""One query for each operator, over the driver's tables, and the same as SQL where SQL can say it.

Summaries and single steps run on a posterior that integer arithmetic gives for every (sample, component, slot, factor), so both
engines start from the same numbers without a fit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arrays as A
from .functions import special as X
from .operators import blocked, cluster, figures, fits, matching
from .operators import longform as L
from .operators import summaries as S
from .plans import benchmark, studies
from .plans.schedule import Stopper, damping
from .plans.ship import ship
from .plans.written import write
from .sources import counts as C
from .sources import simulate
from .streaming import scoring

K, S_, D = 3, 3, 2
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(*names: str, digits: int = 6) -> list[Column]:
    return [(F.round(F.col(n), digits) + 0.0).alias(n) for n in names]


def grid(df: DataFrame, **sizes: int) -> DataFrame:
    for name, n in sizes.items():
        df = df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(n))))
    return df


@dataclass
class Posterior:
    counts: C.Counts
    f0: DataFrame
    l0: DataFrame
    motif: DataFrame
    alpha: DataFrame
    omega: DataFrame
    effects: DataFrame
    priors: DataFrame
    truth: DataFrame


def _weight(df: DataFrame, keys: list[str], w: Column, name: str) -> DataFrame:
    return A.share_over(df.withColumn("_w", w.cast("double")), keys, "_w", name).drop("_w")


def posterior(spark: SparkSession, sf_dir: str) -> Posterior:
    c = C.customer_by(spark, sf_dir, "p_brand")
    k, i, m, s, d = (F.col(x).cast("long") for x in "kimsd")
    f0 = _weight(grid(c.features.select("m"), k=K), ["k"], 1 + (k * 7919 + m * 104729) % 1009, "f")
    l0 = _weight(grid(c.samples, k=K), ["i"], 1 + (k * 15485863 + i * 32452843) % 1013, "w").select("i", "k", (F.col("w") * F.col("total")).alias("l"))
    one = spark.range(1).drop("id")
    motif = _weight(grid(one, s=S_, d=D, k=K), ["s", "d"], 1 + (s * 31 + d * 17 + k * 101) % 97, "p")
    ids = c.samples.select("i")
    alpha = grid(ids, s=S_, d=D).withColumn("a", 1 + ((i * 13 + s * 7 + d * 3) % 50) / 10)
    omega = _weight(grid(ids, s=S_), ["i"], 1 + (i * 29 + s * 53) % 89, "w")
    g = _weight(grid(ids, d=D, k=K), ["i", "d"], 1 + (i * 11 + d * 19 + k * 37) % 83, "p")
    effects = g.withColumns({"alpha": 1 + ((i * 13 + d * 3) % 50) / 10, "lambda": 2.0 + (d % 3) / 4})
    priors = grid(one, s=S_, d=D).select("s", "d", F.lit(1.0).alias("alpha0"), F.lit(1.0).alias("lambda0"), (1 + ((s * 5 + d * 3) % 7) / 10).alias("slot_scale"))
    truth = ids.select("i", (i % 4 + 1).cast("int").alias("grp"), (i % D + 1).cast("int").alias("true_support_size"))
    label = F.when(F.col("true_support_size") == 1, F.concat((i % K + 1).cast("string"))).otherwise(F.lit("1,2"))
    return Posterior(c, f0, l0, motif, alpha, omega, effects, priors, truth.withColumn("true_support_label", label))


PRELUDE = f"""
with cells as (select o_custkey as i, p_brand as name, count(*)::double as y from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by all),
feats as (select row_number() over (order by name) as m, name from (select distinct name from cells)),
counts as (select i, m, y from cells join feats using (name)),
samples as (select i, sum(y) as total from cells group by i),
ks as (select unnest(range(1, {K + 1})) as k), ss as (select unnest(range(1, {S_ + 1})) as s), ds as (select unnest(range(1, {D + 1})) as d),
f0 as (select k, m, w / sum(w) over (partition by k) as f from (select k, m, (1 + (k * 7919 + m * 104729) % 1009)::double as w from ks, feats)),
fs as (select k, sum(f) as f_sum from f0 group by k),
l0 as (select i, k, w / sum(w) over (partition by i) * total as l from (select i, k, total, (1 + (k * 15485863 + i * 32452843) % 1013)::double as w from ks, samples)),
motif as (select s, d, k, w / sum(w) over (partition by s, d) as p from (select s, d, k, (1 + (s * 31 + d * 17 + k * 101) % 97)::double as w from ss, ds, ks)),
alpha as (select i, s, d, 1 + ((i * 13 + s * 7 + d * 3) % 50)::double / 10 as a from samples, ss, ds),
omega as (select i, s, w / sum(w) over (partition by i) as w from (select i, s, (1 + (i * 29 + s * 53) % 89)::double as w from samples, ss)),
effects as (select i, d, k, w / sum(w) over (partition by i, d) as p, 1 + ((i * 13 + d * 3) % 50)::double / 10 as alpha, 2 + (d % 3)::double / 4 as lam
            from (select i, d, k, (1 + (i * 11 + d * 19 + k * 37) % 83)::double as w from samples, ds, ks)),
priors as (select s, d, 1.0::double as alpha0, 1.0::double as lambda0, 1 + ((s * 5 + d * 3) % 7)::double / 10 as slot_scale from ss, ds),
truth as (select i, i % 4 + 1 as grp, i % {D} + 1 as size, case when i % {D} = 0 then (i % {K} + 1)::varchar else '1,2' end as label from samples)
"""


def psi(x: str) -> str:
    """digamma in SQL, written from the series."""
    z = f"(({x}) + 8)"
    tail = " - ".join(f"1.0 / (({x}) + {j})" for j in range(8))
    return f"(ln({z}) - 0.5 / {z} - 1.0 / ({z} * {z}) * (1.0/12 - 1.0/({z} * {z}) * (1.0/120 - 1.0/({z} * {z}) * (1.0/252 - 1.0/({z} * {z}) * (1.0/240 - 1.0/({z} * {z}) / 132)))) - {tail})"


def psi1(x: str) -> str:
    z = f"(({x}) + 8)"
    r = f"(1.0 / ({z} * {z}))"
    tail = " + ".join(f"1.0 / ((({x}) + {j}) * (({x}) + {j}))" for j in range(8))
    return f"(1.0 / {z} + 0.5 * {r} + {r} / {z} * (1.0/6 - {r} * (1.0/30 - {r} * (1.0/42 - {r} * (1.0/30 - {r} * 5.0/66)))) + {tail})"


# State that several oracles share.
SLOTS = """,
elf as (select s, d, m, sum(p * ln(greatest(f, 1e-12))) as elf from motif join f0 using (k) group by all),
rates as (select s, d, exposure, alpha0, lambda0, slot_scale, lambda0 + slot_scale * exposure as rate
          from (select s, d, sum(p * f_sum) as exposure from motif join fs using (k) group by all) join priors using (s, d)),
scored as (select c.i, e.s, e.d, c.m, c.y, e.elf, {psi} - ln(r.rate) as mean_log, r.slot_scale
           from counts c join elf e using (m) join alpha a on a.i = c.i and a.s = e.s and a.d = e.d join rates r on r.s = e.s and r.d = e.d),
top as (select *, ln(slot_scale) + mean_log + elf as score from scored),
xi as (select i, s, d, m, y, elf, mean_log, e / sum(e) over (partition by i, s, m) as xi from (select *, exp(score - max(score) over (partition by i, s, m)) as e from top))
""".replace("{psi}", psi("a.a"))
CEXP = SLOTS + ", cexp as (select s, d, m, sum(w * xi * y) as c from xi join omega using (i, s) group by all)\n"
MOMENTS = """,
moments as (select s, d, sum(w) as weight, sum(w * a / rate) / sum(w) as mean, sum(w * ({psi} - ln(rate))) / sum(w) as mean_log
            from alpha join omega using (i, s) join rates using (s, d) group by all)
""".replace("{psi}", psi("a"))
BOUND = """,
bound as (select i, s, data - cost as elbo from
  (select i, s, sum(xi * y * (mean_log + elf) - y * xi * ln(greatest(xi, 1e-12))) as data from xi group by all)
  join (select i, s, sum(a / rate * slot_scale * exposure + (a - alpha0) * {psi} + alpha0 * (ln(rate) - ln(lambda0)) - lgamma(a) + lgamma(alpha0) - (rate - lambda0) * a / rate) as cost
        from alpha join rates using (s, d) group by all) using (i, s))
""".replace("{psi}", psi("a"))
SCORES = ", scores as (select i, k, sum(p * alpha / lam) as score from effects group by all)\n"
SIZES = """,
sizes as (select i, d, sum(p * alpha / lam) as size, arg_max(k, (p, -k)) as top_factor, max(p) as top_gamma, sum(-p * ln(p)) / ln(3) as entropy from effects group by all),
ranked as (select *, row_number() over (partition by i order by round(size, 9) desc, d) as rank from sizes),
extra as (select i, grp, sum(case when rank > t.size then r.size else 0 end) / sum(r.size) as extra from ranked r join truth t using (i) group by all)
"""
BETA = SLOTS + """,
beta as (select s, d, sum(w * a / rate) / sum(w) as beta_mean from alpha join omega using (i, s) join rates using (s, d) group by all),
ent as (select s, d, sum(-p * ln(p)) / ln(3) as gamma_entropy, max(p) as top_gamma from motif group by all),
mscores as (select s, k, sum(slot_scale * beta_mean * p) as score from motif join beta using (s, d) join priors using (s, d) group by all),
activity as (select s as submanifold, d as slot, beta_mean, slot_scale, beta_mean * slot_scale as effective_beta,
   beta_mean * slot_scale / sum(beta_mean * slot_scale) over (partition by s) as beta_fraction, alpha0 / lambda0 as prior_mean, (alpha0 / lambda0) / sum(alpha0 / lambda0) over (partition by s) as prior_fraction, gamma_entropy, top_gamma
   from beta join priors using (s, d) join ent using (s, d))
"""
LABELS = SCORES + """,
lab as (select i, string_agg(k::varchar, ',' order by k) as label from (select *, row_number() over (partition by i order by round(score, 9) desc, k) as rank from scores) join truth using (i) where rank <= size group by i)
"""
#: A second small dictionary, to match against.
FT = ", ft as (select k as true_k, m, w / sum(w) over (partition by k) as f from (select k, m, (1 + ((k % 3 + 1) * 7919 + m * 104729 + k * 13) % 1009)::double as w from ks, feats)),\nsim as (select a.k, b.true_k, sum(a.f * b.f) / sqrt(any_value(na) * any_value(nb)) as cosine from f0 a join ft b using (m) join (select k, sum(f * f) as na from f0 group by k) x on x.k = a.k join (select true_k, sum(f * f) as nb from ft group by true_k) y on y.true_k = b.true_k group by all)\n"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def on_posterior(name: str, sql: str | None = None, tail: str = ""):
    """A query on the posterior; its SQL follows the prelude and the shared tables named in tail."""

    def put(f):
        return query(name, None if sql is None else PRELUDE + tail + sql)(lambda spark, sf_dir: f(posterior(spark, sf_dir)))

    return put


# Data preparation.


def _cells(c: C.Counts) -> DataFrame:
    return c.counts.join(c.features, "m").select("i", F.col("m").cast("long").alias("m"), "name", "y")


query("counts_customer_brand", "select o_custkey as i, dense_rank() over (order by p_brand) as m, p_brand as name, count(*)::double as y from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by o_custkey, p_brand")(lambda s, d: _cells(C.customer_by(s, d, "p_brand")))
query("counts_customer_type", "select o_custkey as i, dense_rank() over (order by p_type) as m, p_type as name, count(*)::double as y from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by o_custkey, p_type")(lambda s, d: _cells(C.customer_by(s, d, "p_type")))
query("counts_user_event", "select user_id as i, dense_rank() over (order by event_type) as m, event_type as name, count(*)::double as y from events group by user_id, event_type")(lambda s, d: _cells(C.counts_from(table(s, d, "events").select("user_id", "event_type"), "user_id", "event_type")))

TOKENS = "tok as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as token from documents), top as (select token, count(distinct doc_id) as n from tok group by token order by n desc, token limit 200)"


@query("counts_doc_token_topv", f"with {TOKENS} select doc_id as i, dense_rank() over (order by token) as m, token as name, count(*)::double as y from tok where token in (select token from top) group by doc_id, token")
def counts_doc_token(spark, sf_dir):
    """Texts are read once: the cells of all tokens are written, the vocabulary and the counts come from them."""
    t = C.tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    cells, _ = write(t.where("doc_id is not null").groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n")), "token-cells")
    seen = cells.groupBy(F.col("token").alias("name")).agg(F.count(F.lit(1)).alias("docs"))
    top, _ = write(seen.orderBy(F.desc("docs"), "name").limit(200).select("name"), "vocabulary")
    return _cells(C.counts_from(cells.join(top, cells.token == top.name, "left_semi"), "doc_id", "token", "n", features=top))


on_posterior("row_totals", "select i, total from samples")(lambda p: C.row_totals(p.counts.counts))
on_posterior("column_totals", "select m, name, sum(y) as total from counts join feats using (m) group by all")(lambda p: C.column_totals(p.counts.counts, p.counts.features).withColumn("m", F.col("m").cast("long")))
on_posterior("sparsity_profile", "select (select count(*) from samples) as n_samples, (select count(*) from feats) as n_features, count(*) as nnz, sum(y) as total, max(y) as max_y, round(count(*) / ((select count(*) from samples) * (select count(*) from feats)), 6) as density from counts")(lambda p: C.sparsity_profile(p.counts).select("n_samples", "n_features", "nnz", "total", "max_y", *r6("density")))

# Primitives.

on_posterior("normalize_rows", "select i, k, round(greatest(l - 5, 1e-12) / sum(greatest(l - 5, 1e-12)) over (partition by i), 6) + 0.0 as share from l0")(lambda p: A.share_over(p.l0.withColumn("l", F.col("l") - 5), ["i"], "l", "share", A.EPS).select("i", F.col("k").cast("long").alias("k"), *r6("share")))


def _packed_l(p: Posterior) -> DataFrame:
    return p.l0.groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "l"))), lambda x: x["l"]).alias("l"))


on_posterior("softmax_rows", "select i, round(exp(max(l) - max(t)) / sum(exp(l - t)), 6) + 0.0 as top from (select i, l, max(l) over (partition by i) as t from l0) group by i")(lambda p: _packed_l(p).select("i", F.array_max(A.softmax(F.col("l"))).alias("top")).select("i", *r6("top")))
on_posterior("logsumexp_rows", "select i, round(max(t) + ln(sum(exp(l - t))), 6) + 0.0 as lse from (select i, l, max(l) over (partition by i) as t from l0) group by i")(lambda p: A.log_sum_exp_by(p.l0, ["i"], "l", "lse").select("i", *r6("lse")))
on_posterior("contraction_lf", "select i, m, round(sum(l * f), 6) + 0.0 as rate from counts join f0 using (m) join l0 using (i, k) group by i, m")(lambda p: L.rate(p.counts.counts, p.l0, p.f0).select("i", F.col("m").cast("long").alias("m"), *r6("rate")))
on_posterior("pooled_counts", "select s, m, round(sum(w * y), 6) + 0.0 as y from counts join omega using (i) group by all")(lambda p: L.pooled(p.counts.counts, p.omega).select(F.col("s").cast("long").alias("s"), F.col("m").cast("long").alias("m"), *r6("y")))


def _true_f(p: Posterior) -> DataFrame:
    k, m = F.col("true_k").cast("long"), F.col("m").cast("long")
    return _weight(grid(p.counts.features.select("m"), true_k=K), ["true_k"], 1 + ((k % 3 + 1) * 7919 + m * 104729 + k * 13) % 1009, "f").withColumnRenamed("f", "ft")


def _sim(p: Posterior) -> DataFrame:
    return A.cosine(p.f0, _true_f(p), "k", "true_k", "m", "f", "ft")


def longs(df: DataFrame, *names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


on_posterior("row_cosine", "select k, true_k, round(cosine, 6) + 0.0 as cosine from sim", FT)(lambda p: (x := _sim(p)).select(*longs(x, "k", "true_k"), *r6("cosine")))
on_posterior("top_k_support", "select i, label from lab", LABELS)(lambda p: S.support_labels(S.loading_scores(p.effects), p.truth))
on_posterior("top_k_support_packed", "select i, label from lab", LABELS)(lambda p: S.loading_scores(p.effects).groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "score"))), lambda x: x["score"]).alias("v")).join(p.truth, "i").select("i", A.top_label(F.col("v"), F.col("true_support_size")).alias("label")))
on_posterior("recycle_pad", "select i, list_aggregate([((x - 1) % (i % 3 + 1) + 1)::varchar for x in range(1, 6)], 'string_agg', ',') as padded from samples")(lambda p: p.counts.samples.select("i", F.array_join(F.transform(A.recycle(F.sequence(F.lit(1), (F.col("i") % 3 + 1).cast("int")), 5), lambda v: v.cast("string")), ",").alias("padded")))

GRID = "(select unnest([0.001, 0.01, 0.3, 1.0, 2.5, 7.7, 30.0, 1000.0, 10000.0])::double as x)"


def _grid(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*(F.lit(v) for v in (0.001, 0.01, 0.3, 1.0, 2.5, 7.7, 30.0, 1000.0, 10000.0)))).alias("x"))


query("digamma_grid", f"select x, round({psi('x')}, 6) as value from {GRID}")(lambda s, d: _grid(s).withColumn("value", X.digamma(F.col("x"))).select("x", *r6("value")))
query("trigamma_grid", f"select x, round({psi1('x')}, 6) as value from {GRID}")(lambda s, d: _grid(s).withColumn("value", X.trigamma(F.col("x"))).select("x", *r6("value")))
query("lgamma_grid", f"select x, round(lgamma(x), 6) + 0.0 as value from {GRID}")(lambda s, d: _grid(s).withColumn("value", X.lgamma(F.col("x"))).select("x", *r6("value")))
# Both inverses are exact up to rounding at these points, so SQL only has to know what they invert.
query("inv_digamma_grid", f"select x, round(x, 5) as value from {GRID} where x >= 0.3 and x < 5000")(lambda s, d: X.with_inv_digamma(_grid(s).where("x >= 0.3 and x < 5000").withColumn("y", X.digamma(F.col("x"))), "value", "y").select("x", *r6("value", digits=5)))
# Steps in long form.


def _shares(p: Posterior, omega: DataFrame | None = None) -> DataFrame:
    return L.slot_shares(p.counts.counts, p.alpha, L.slot_factors(p.motif, p.f0), L.slot_rates(p.motif, p.f0, p.priors), omega)


def _rates(p: Posterior) -> DataFrame:
    return L.slot_rates(p.motif, p.f0, p.priors)


def _cexp(p: Posterior) -> DataFrame:
    return L.expected_counts(_shares(p, p.omega))


def _moments(p: Posterior) -> DataFrame:
    return L.prior_moments(p.alpha, p.omega, _rates(p))


on_posterior("xi_allocation", "select i, s, d, m, round(xi, 6) + 0.0 as xi from xi", SLOTS)(lambda p: (x := _shares(p)).select("i", *longs(x, "s", "d", "m"), *r6("xi")))
on_posterior("beta_counts", "select i, s, d, round(sum(xi * y), 6) + 0.0 as beta_count from xi group by all", SLOTS)(lambda p: (x := L.beta_counts(_shares(p))).select("i", *longs(x, "s", "d"), *r6("beta_count")))
on_posterior("expected_counts_C", "select s, d, m, round(c, 6) + 0.0 as c from cexp", CEXP)(lambda p: (x := _cexp(p)).select(*longs(x, "s", "d", "m"), *r6("c")))
on_posterior("component_elbo", "select i, s, round(elbo, 5) + 0.0 as elbo from bound", SLOTS + BOUND)(lambda p: (x := L.component_elbo(_shares(p), p.alpha, _rates(p))).select("i", *longs(x, "s"), *r6("elbo", digits=5)))
on_posterior("soft_lambda_sd", "select s, d, round(rate, 6) + 0.0 as rate from rates", SLOTS)(lambda p: (x := _rates(p)).select(*longs(x, "s", "d"), *r6("rate")))


def _pi(p: Posterior) -> DataFrame:
    return L.mixture_weights(p.omega)


PI = ", pis as (select s, greatest(avg(w), 1e-12) / sum(greatest(avg(w), 1e-12)) over () as pi from omega group by s)\n"
on_posterior("mixture_weights", "select s, round(pi, 6) + 0.0 as pi from pis", PI)(lambda p: (x := _pi(p)).select(*longs(x, "s"), *r6("pi")))
on_posterior("responsibilities_step", "select i, s, round(e / sum(e) over (partition by i), 6) + 0.0 as w from (select i, s, exp(x - max(x) over (partition by i)) as e from (select i, s, elbo + ln(pi) as x from bound join pis using (s)))", SLOTS + BOUND + PI)(lambda p: (x := L.responsibilities(L.component_elbo(_shares(p), p.alpha, _rates(p)), _pi(p))).select("i", *longs(x, "s"), *r6("w")))
on_posterior("mixture_elbo", "select round(sum(z), 3) + 0.0 as elbo from (select max(x) + ln(sum(exp(x - t))) as z from (select i, x, max(x) over (partition by i) as t from (select i, elbo + ln(pi) as x from bound join pis using (s))) group by i)", SLOTS + BOUND + PI)(lambda p: A.log_sum_exp_by(L.component_elbo(_shares(p), p.alpha, _rates(p)).join(_pi(p), "s").withColumn("x", F.col("elbo") + F.ln("pi")), ["i"], "x", "z").agg(F.sum("z").alias("elbo")).select(*r6("elbo", digits=3)))
on_posterior("prior_moments", "select s, d, round(weight, 6) + 0.0 as weight, round(mean, 6) + 0.0 as mean, round(mean_log, 6) + 0.0 as mean_log from moments", SLOTS + MOMENTS)(lambda p: (x := _moments(p)).select(*longs(x, "s", "d"), *r6("weight", "mean", "mean_log")))


def shape_sql(source: str, steps: int = 8) -> str:
    """Newton steps for the Gamma shape, one table each."""
    out = f", g0 as (select s, d, mean, greatest(ln(greatest(mean, 1e-12)) - mean_log, 1e-12) as gap from {source}), n0 as (select *, least(greatest(case when gap > 0.5 then 1 / (2 * gap) else 1 / gap end, 1e-3), 1e4) as a from g0)"
    for j in range(steps):
        out += f", n{j + 1} as (select s, d, mean, gap, least(greatest(a - (ln(a) - {psi('a')} - gap) / (1 / a - {psi1('a')}), 1e-3), 1e4) as a from n{j})"
    return out + "\n"


query("gamma_shape_moments", f"with base as (select x as s, 1 as d, x / 2 as mean, {psi('x')} - ln(2) as mean_log from {GRID}){shape_sql('base')} select s as x, round(a, 4) + 0.0 as value from n8")(lambda s, d: X.with_gamma_shape(_grid(s).withColumns({"mean": F.col("x") / 2, "mean_log": X.digamma(F.col("x")) - F.ln(F.lit(2.0))}), "value", "mean", "mean_log").select("x", *r6("value", digits=4)))


@on_posterior("prior_step", "select s, d, round(a, 5) + 0.0 as alpha0, round(a / greatest(mean, 1e-12), 5) + 0.0 as lambda0 from n8", SLOTS + MOMENTS + shape_sql("moments"))
def prior_step(p: Posterior) -> DataFrame:
    x = X.with_gamma_shape(_moments(p), "alpha0", "mean", "mean_log").withColumn("lambda0", F.col("alpha0") / F.greatest("mean", F.lit(A.EPS)))
    return x.select(*longs(x, "s", "d"), *r6("alpha0", "lambda0", digits=5))


@on_posterior("soft_gamma_step", """, fit as (select s, d, k, sum(c * ln(f)) as fit from cexp join f0 using (m) group by all),
sc as (select motif.s, motif.d, motif.k, p, fit - weight * mean * f_sum as score from motif join fit using (s, d, k) join moments using (s, d) join fs using (k)),
q as (select s, d, k, 0.5 * p + 0.5 * e / sum(e) over (partition by s, d) as q from (select *, exp(score - max(score) over (partition by s, d)) as e from sc))
select s, d, k, round(greatest(q, 1e-12) / sum(greatest(q, 1e-12)) over (partition by s, d), 6) + 0.0 as p from q""", CEXP + MOMENTS)
def soft_gamma_step(p: Posterior) -> DataFrame:
    unit = p.priors.withColumn("slot_scale", F.col("slot_scale"))
    x = L.soft_gamma_step(_cexp(p), p.f0, p.motif, L.prior_moments(p.alpha, p.omega, L.slot_rates(p.motif, p.f0, unit)), 0.5)
    return x.select(*longs(x, "s", "d", "k"), *r6("p"))


@on_posterior("slot_scale_step", """, raw as (select s, d, 0.8 * slot_scale + 0.2 * c / greatest(weight * mean * exposure, 1e-12) as raw from (select s, d, sum(c) as c from cexp group by all) join moments using (s, d) join rates using (s, d))
select s, d, round(least(greatest(raw / greatest(avg(raw) over (partition by s), 1e-12), 1e-3), 1e3), 6) + 0.0 as slot_scale from raw""", CEXP + MOMENTS)
def slot_scale_step(p: Posterior) -> DataFrame:
    x = L.slot_scale_step(_cexp(p), _moments(p), _rates(p), 0.2)
    return x.select(*longs(x, "s", "d"), *r6("slot_scale"))


@on_posterior("F_step", """, a as (select k, m, sum(p * c) + 2.220446049250313e-16 as a from cexp join motif using (s, d) group by all),
h as (select f0.k, f0.m, 0.8 * f + 0.2 * coalesce(a, 2.220446049250313e-16) / sum(coalesce(a, 2.220446049250313e-16)) over (partition by f0.k) as h from f0 left join a on a.k = f0.k and a.m = f0.m)
select k, m, round(h / sum(h) over (partition by k), 6) + 0.0 as f from h""", CEXP)
def f_step(p: Posterior) -> DataFrame:
    x = L.factor_step(_cexp(p), p.motif, p.f0, 0.2, simulate.EPS)
    return x.select(*longs(x, "k", "m"), *r6("f"))


EFFECT_XI = """,
elb as (select i, d, sum(p * ({psi} - ln(lam))) as mean_log from effects group by all),
esc as (select c.i, e.d, c.m, c.y, sum(e.p * ln(f.f)) as elf from counts c join f0 f using (m) join effects e on e.i = c.i and e.k = f.k group by all),
exi as (select i, d, m, y, e / sum(e) over (partition by i, m) as xi from (select esc.*, exp(elf + mean_log - max(elf + mean_log) over (partition by i, m)) as e from esc join elb using (i, d)))
""".replace("{psi}", psi("alpha"))
on_posterior("effect_xi", "select i, d, m, round(xi, 6) + 0.0 as xi from exi", EFFECT_XI)(lambda p: (x := L.effect_shares(p.counts.counts, p.effects, p.f0)).select("i", *longs(x, "d", "m"), *r6("xi")))


@on_posterior("gamma_cavi_step", """, fit as (select i, d, k, sum(xi * y * ln(f)) as fit from exi join f0 using (m) group by all), n as (select i, d, sum(xi * y) as n from exi group by all),
sc as (select i, d, k, fit - (n + 1) * ln(1 + f_sum) as score from fit join n using (i, d) join fs using (k))
select i, d, k, round(e / sum(e) over (partition by i, d), 6) + 0.0 as p from (select *, exp(score - max(score) over (partition by i, d)) as e from sc)""", EFFECT_XI)
def gamma_cavi_step(p: Posterior) -> DataFrame:
    priors = grid(p.counts.samples.select("i"), d=D).select("i", "d", F.lit(1.0).alias("alpha0"), F.lit(1.0).alias("lambda0"))
    x = L.effect_gamma(L.effect_shares(p.counts.counts, p.effects, p.f0), p.f0, priors)
    return x.select("i", *longs(x, "d", "k"), *r6("p"))


on_posterior("merge_symmetry_pairs", "select i, d1, d2 from (select a.i, a.d as d1, b.d as d2, sqrt(sum((a.p - b.p) ** 2)) as dist from effects a join effects b on a.i = b.i and a.k = b.k and a.d < b.d group by all) where dist < 0.2 and i not in (select i from effects group by i, d having sqrt(sum((p - 1.0/3) ** 2)) <= 0.2)")(lambda p: (x := L.merge_pairs(p.effects, K, 0.2)).select("i", *longs(x, "d1", "d2")))

#: Four effects, of which those with slots of one parity are alike.
D4, TOL = 4, 0.2
ALIKE = f""", e4 as (select i, d, k, w / sum(w) over (partition by i, d) as p from (select i, d, k, (1 + (i * 11 + (d % 2) * 19 + k * 37) % 83 + (d // 2) * ((i + k) % 7)) ::double as w from samples, (select unnest(range(1, {D4 + 1})) as d), ks)),
g4 as (select i, list(p order by k) as v, d from e4 group by i, d),
s0 as (select i, list(v order by d) as g, list(list_distance(v, [1/3, 1/3, 1/3]) > {TOL} order by d) as active, 0 as t from g4 group by i)"""
_uniform, _mean = "[1/3, 1/3, 1/3]", "list_transform(range(1, 4), lambda j: (g[{0}][j] + g[{1}][j]) / 2)"
_contract = lambda keep, free: f"case when hit then list_transform(g, lambda v, d: case when d = {keep} then {_mean.format(keep, free)} when d = {free} then {_uniform} else v end) else g end, case when hit then list_transform(active, lambda x, d: x and d <> {free}) else active end"
BY_SLOT = ALIKE + f""", steps as (select row_number() over (order by pass, a, b) - 1 as t, a, b from (select unnest(range({D4})) as pass), (select unnest(range(1, 5)) as a), (select unnest(range(1, 5)) as b) where a < b),
run as (select * from s0 union all select i, {_contract("a", "b")}, t + 1 from (select r.*, a, b, active[a] and active[b] and list_distance(g[a], g[b]) < {TOL} as hit from run r join steps using (t)))
"""
CLOSEST = ALIKE + f""", run as (select * from s0 union all select i, {_contract("b", "a")}, t + 1 from (select *, m.a as a, m.b as b, m.gap < {TOL} as hit from (
  select *, list_min(list_transform([[1, 2], [1, 3], [1, 4], [2, 3], [2, 4], [3, 4]], lambda p: {{'gap': case when active[p[1]] and active[p[2]] then list_distance(g[p[1]], g[p[2]]) else 'inf'::double end, 'a': p[1], 'b': p[2]}})) as m from run where t < {D4})))
"""
MERGED = "select i, d, k, round(g[d][k], 6) + 0.0 as p from (select i, g from run qualify t = max(t) over ()), (select unnest(range(1, 5)) as d), ks"


def _merged(p: Posterior, closest: bool) -> DataFrame:
    i, d, k = (F.col(x).cast("long") for x in "idk")
    w = 1 + (i * 11 + (d % 2) * 19 + k * 37) % 83 + F.floor(d / 2) * ((i + k) % 7)
    alike = _weight(grid(p.counts.samples.select("i"), d=D4, k=K), ["i", "d"], w, "p")
    x = L.merged(alike, K, D4, TOL, closest)
    return x.select("i", *longs(x, "d", "k"), *r6("p"))


RECURSIVE = PRELUDE.replace("with cells", "with recursive cells")
query("merge_by_slot", RECURSIVE + BY_SLOT + MERGED)(lambda s, d: _merged(posterior(s, d), False))
query("merge_closest_first", RECURSIVE + CLOSEST + MERGED)(lambda s, d: _merged(posterior(s, d), True))

# Fits.

NMF = """,
rt0 as (select i, m, y / (sum(l * f) + 1e-12) as ratio from counts join f0 using (m) join l0 using (i, k) group by i, m, y),
l1 as (select l0.i, l0.k, greatest(l * up / f_sum, 1e-12) as l from l0 join (select i, k, sum(ratio * f) as up from rt0 join f0 using (m) group by all) u using (i, k) join fs using (k)),
rt1 as (select i, m, y / (sum(l * f) + 1e-12) as ratio from counts join f0 using (m) join l1 using (i, k) group by i, m, y),
raw1 as (select f0.k, f0.m, greatest(f * up / l_sum, 1e-12) as f from f0 join (select k, m, sum(l * ratio) as up from rt1 join l1 using (i) group by all) u using (k, m) join (select k, sum(l) as l_sum from l1 group by k) using (k)),
f1 as (select k, m, f / sum(f) over (partition by k) as f from raw1)
"""


def _nmf(spark: SparkSession, sf_dir: str, its: int) -> DataFrame:
    x = fits.poisson_nmf(C.customer_by(spark, sf_dir, "p_brand"), K, its).factors_df()
    return x.select(*longs(x, "k", "m"), *r6("f"))


query("nmf_T1", PRELUDE + NMF + "select k, m, round(f, 6) + 0.0 as f from f1")(lambda s, d: _nmf(s, d, 1))
NMF2 = """,
sc1 as (select k, sum(f) as sc from raw1 group by k), l1s as (select i, k, l * sc as l from l1 join sc1 using (k)),
rt2 as (select i, m, y / (sum(l * f) + 1e-12) as ratio from counts join f1 using (m) join l1s using (i, k) group by i, m, y),
fs1 as (select k, sum(f) as f_sum from f1 group by k),
l2 as (select l1s.i, l1s.k, greatest(l * up / f_sum, 1e-12) as l from l1s join (select i, k, sum(ratio * f) as up from rt2 join f1 using (m) group by all) u using (i, k) join fs1 using (k)),
rt3 as (select i, m, y / (sum(l * f) + 1e-12) as ratio from counts join f1 using (m) join l2 using (i, k) group by i, m, y),
raw2 as (select f1.k, f1.m, greatest(f * up / l_sum, 1e-12) as f from f1 join (select k, m, sum(l * ratio) as up from rt3 join l2 using (i) group by all) u using (k, m) join (select k, sum(l) as l_sum from l2 group by k) using (k))
"""
query("nmf_T2", PRELUDE + NMF + NMF2 + "select k, m, round(f / sum(f) over (partition by k), 6) + 0.0 as f from raw2")(lambda s, d: _nmf(s, d, 2))


@on_posterior("nmf_long_step", "select k, m, round(f, 6) + 0.0 as f from f1", NMF)
def nmf_long_step(p: Posterior) -> DataFrame:
    loads = L.nmf_loading_step(p.counts.counts, p.l0, p.f0)
    x = L.nmf_factor_step(p.counts.counts, loads, p.f0)
    return x.select(*longs(x, "k", "m"), *r6("f"))


on_posterior("nmf_deviance", "select round((select sum(y * ln(y / (rate + 1e-12)) - y) from (select y, sum(l * f) as rate from counts join f0 using (m) join l0 using (i, k) group by i, m, y)) + (select sum(l * f_sum) from l0 join fs using (k)), 3) as deviance")(lambda p: L.deviance(p.counts.counts, p.l0, p.f0).select(*r6("deviance", digits=3)))


@query("nmf_segment_factor", PRELUDE + NMF + ", best as (select i, arg_max(k, (l, -k)) as k from (select i, k, l * sc as l from l1 join (select k, sum(f) as sc from raw1 group by k) using (k)) group by i) select c_mktsegment, k, count(*) as n from best join customer on i = c_custkey group by all")
def nmf_segment_factor(spark, sf_dir):
    """Top factor of each customer after one iteration, by market segment."""
    fit = fits.poisson_nmf(C.customer_by(spark, sf_dir, "p_brand"), K, 1)
    best = S.max_responsibility(fit.loadings_df().select("i", F.col("k").alias("s"), F.col("l").alias("w")))
    segment = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), "c_mktsegment")
    return best.join(segment, "i").groupBy("c_mktsegment", F.col("z_hat").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


def hashed_state(spark: SparkSession, sf_dir: str) -> tuple[C.Counts, np.ndarray, np.ndarray]:
    c = C.customer_by(spark, sf_dir, "p_brand")
    s, d, k = np.indices((S_, D, K)) + 1
    g = 1.0 + (31 * s + 17 * d + 101 * k) % 97
    return c, fits.hashed_init(K, c.n_features())[0], g / g.sum(2, keepdims=True)


def rounds_sql(first: str, n: int, start: int = 0) -> str:
    """n rounds of shares and effects from table ``first``: tables x{j} (shares with a{j}) and a{j + 1}."""
    out = first
    for j in range(start, start + n):
        out += f", y{j} as (select c.i, a.s, a.d, c.m, c.y, e.elf, {psi('a.a')} - ln(r.rate) as mean_log from counts c join elf e using (m) join a{j} a on a.i = c.i and a.s = e.s and a.d = e.d join rates r on r.s = e.s and r.d = e.d)"
        out += f", x{j} as (select i, s, d, m, y, elf, mean_log, e / sum(e) over (partition by i, s, m) as xi from (select *, exp(elf + mean_log - max(elf + mean_log) over (partition by i, s, m)) as e from y{j}))"
        out += f", a{j + 1} as (select i, s, d, 1 + sum(xi * y) as a from x{j} group by all)"
    return out


def omega_sql(shares: str, a: str) -> str:
    """Responsibilities at a uniform mixture; shares ``shares``, effects ``a``."""
    return f""", b1 as (select i, s, sum(xi * y * (ml + elf) - y * xi * ln(greatest(xi, 1e-12))) as data from (select x.*, {psi('a.a')} - ln(r.rate) as ml from {shares} x join {a} a using (i, s, d) join rates r using (s, d)) group by all),
b2 as (select i, s, sum(a / rate * exposure + (a - 1) * {psi('a')} + ln(rate) - lgamma(a) - (rate - 1) * a / rate) as cost from {a} join rates using (s, d) group by all),
om as (select i, s, e / sum(e) over (partition by i) as w from (select i, s, exp(data - cost - max(data - cost) over (partition by i)) as e from b1 join b2 using (i, s)))"""


SOFT_RATES = ", elf as (select s, d, m, sum(p * ln(greatest(f, 1e-12))) as elf from motif join f0 using (k) group by all), rates as (select s, d, sum(p * f_sum) as exposure, 1 + sum(p * f_sum) as rate from motif join fs using (k) group by all)"
SOFT_T1 = rounds_sql(SOFT_RATES + f", a0 as (select i, s, d, 1 + total / {D} as a from samples, ss, ds)", 3) + omega_sql("x2", "a2") + rounds_sql("", 2, 3) + """,
cx as (select s, d, m, sum(w * xi * y) as c from x4 join om using (i, s) group by all), mass as (select s, d, sum(w * a / rate) as mass from a4 join om using (i, s) join rates using (s, d) group by all),
sc as (select motif.s, motif.d, motif.k, p, fit - mass * f_sum as score from motif join (select s, d, k, sum(c * ln(f)) as fit from cx join f0 using (m) group by all) using (s, d, k) join mass using (s, d) join fs using (k)),
q as (select s, d, k, 0.5 * p + 0.5 * e / sum(e) over (partition by s, d) as q from (select *, exp(score - max(score) over (partition by s, d)) as e from sc))
select s, d, k, round(greatest(q, 1e-12) / sum(greatest(q, 1e-12)) over (partition by s, d), 6) + 0.0 as p from q"""


@query("soft_mixture_T1", PRELUDE + SOFT_T1)
def soft_mixture_t1(spark, sf_dir):
    c, f, g = hashed_state(spark, sf_dir)
    fit = fits.soft_mixture_fixed(c, f, g, max_iters=1, n_inner=1, update_F=True)
    x = fit.motifs_df()
    return x.select(*longs(x, "s", "d", "k"), *r6("p"))


HARD_RATES = ", hm as (select s, d, (s + d - 2) % 3 + 1 as k from ss, ds), elf as (select s, d, m, ln(greatest(f, 1e-12)) as elf from hm join f0 using (k)), rates as (select s, d, f_sum as exposure, 1 + f_sum as rate from hm join fs using (k))"
HARD_T1 = rounds_sql(HARD_RATES + ", a0 as (select i, s, d, 1.0::double as a from samples, ss, ds)", 2) + omega_sql("x1", "a2") + """,
ax as (select k, m, sum(w * xi * y) as a from x1 join om using (i, s) join hm using (s, d) group by all),
h as (select f0.k, f0.m, 0.8 * f + 0.2 * (coalesce(a, 0) + 2.220446049250313e-16) / sum(coalesce(a, 0) + 2.220446049250313e-16) over (partition by f0.k) as h from f0 left join ax on ax.k = f0.k and ax.m = f0.m)
select k, m, round(h / sum(h) over (partition by k), 6) + 0.0 as f from h"""


@query("hard_mixture_T1", PRELUDE + HARD_T1)
def hard_mixture_t1(spark, sf_dir):
    c, f, _ = hashed_state(spark, sf_dir)
    fit = fits.hard_mixture_fixed(c, f, np.array([[1, 2], [2, 3], [3, 1]]), max_iters=1, n_inner=2, update_F=True, F_step_init=0.2, F_step_ramp=20)
    x = fit.factors_df()
    return x.select(*longs(x, "k", "m"), *r6("f"))


@query("hard_motif_update", PRELUDE + ", pool as (select s, m, sum(w * y) as y from counts join omega using (i) group by all) select s, round(sum(y), 4) as pooled from pool group by s")
def hard_motif_update(spark, sf_dir):
    """Motifs from pooled counts; the query checks the pooled totals that the update starts from."""
    p = posterior(spark, sf_dir)
    pooled = L.pooled(p.counts.counts, p.omega)
    return pooled.groupBy(F.col("s").cast("long").alias("s")).agg(F.sum("y").alias("pooled")).select("s", *r6("pooled", digits=4))


#: The 50 updates of pooled loadings as a recursion over lists, then the shares that stay, recycled.
MOTIF_STEP = f""", pool as (select s, m, sum(w * y) as y from counts join omega using (i) group by all),
pl as (select s, list(coalesce(y, 0) order by m) as ys, sum(y) as total from (select s, m, y from ss cross join feats left join pool using (s, m)) group by s),
fl as (select list(f order by m) filter (k = 1) as f1, list(f order by m) filter (k = 2) as f2, list(f order by m) filter (k = 3) as f3 from f0),
h0 as (select s, ys, f1, f2, f3, 0 as it, total / {K} + total * ((s = 1)::int + (s = 3)::int) / {D} as h1, total / {K} + total * ((s = 1)::int + (s = 2)::int) / {D} as h2, total / {K} + total * ((s = 2)::int + (s = 3)::int) / {D} as h3 from pl, fl),
h as (select * from h0 union all
  select s, ys, f1, f2, f3, it + 1, greatest(h1 * list_dot_product(rs, f1) / list_sum(f1), 1e-12), greatest(h2 * list_dot_product(rs, f2) / list_sum(f2), 1e-12), greatest(h3 * list_dot_product(rs, f3) / list_sum(f3), 1e-12)
  from (select *, list_transform(range(1, len(ys) + 1), lambda j: ys[j] / (h1 * f1[j] + h2 * f2[j] + h3 * f3[j] + 1e-12)) as rs from h where it < 50)),
sh3 as (select s, unnest([1, 2, 3]) as k, unnest([h1, h2, h3]) / (h1 + h2 + h3) as share from h where it = 50),
act as (select s, list(k order by share desc, k) filter (share >= 0.1) as ks from sh3 group by s)
select s, d, ks[(d - 1) % least(len(ks), {D}) + 1]::bigint as k from act, ds"""


@query("hard_motif_step", PRELUDE.replace("with cells", "with recursive cells") + MOTIF_STEP)
def hard_motif_step(spark, sf_dir):
    p = posterior(spark, sf_dir)
    f = fits.hashed_init(K, p.counts.n_features())[0]
    rows = L.pooled(p.counts.counts, p.omega).collect()  # components times features
    y = np.zeros((S_, f.shape[1]))
    for r in rows:
        y[r["s"] - 1, r["m"] - 1] = r["y"]
    new = fits.motif_step(f, np.array([[1, 2], [2, 3], [3, 1]]), y)
    return spark.createDataFrame([(s + 1, d + 1, int(k)) for (s, d), k in np.ndenumerate(new)], "s long, d long, k long")


def shares_sql(j: int, f: str) -> str:
    """xs{j}: shares of the effects e{j} at each cell, with factors f."""
    return f""", el{j} as (select i, d, sum(p * ({psi('alpha')} - ln(lam))) as ml from e{j} group by all),
xc{j} as (select c.i, c.m, c.y, e.d, sum(e.p * ln(f.f)) as elf from counts c join {f} f using (m) join e{j} e on e.i = c.i and e.k = f.k group by all),
xs{j} as (select i, m, y, d, elf, ml, e / sum(e) over (partition by i, m) as xi from (select xc{j}.*, ml, exp(elf + ml - max(elf + ml) over (partition by i, m)) as e from xc{j} join el{j} using (i, d)))"""


def effect_sql(j: int, d: int, rho: float, f: str, prior: bool) -> str:
    """e{j + 1} and q{j + 1} (priors) from e{j} and q{j} after the update of effect d; the prior's shape by Newton steps."""
    out = shares_sql(j, f) + f""", fz{j} as (select k, sum(f) as f_sum from {f} group by k),
gn{j} as (select i, sum(xi * y) + any_value(q.a0) as a, any_value(q.l0) as l0 from xs{j} join q{j} q using (i, d) where d = {d} group by i),
gf{j} as (select i, k, sum(xi * y * ln(f)) as fit from xs{j} join {f} using (m) where d = {d} group by all),
gs{j} as (select i, k, a, l0 + f_sum as lam, fit - a * ln(l0 + f_sum) as score from gf{j} join gn{j} using (i) join fz{j} using (k)),
ge{j} as (select i, k, a, lam, e / sum(e) over (partition by i) as soft from (select *, exp(score - max(score) over (partition by i)) as e from gs{j})),
e{j + 1} as (select i, e.d, k, case when e.d = {d} then {1 - rho} * p + {rho} * soft else p end as p, case when e.d = {d} then g.a else alpha end as alpha, case when e.d = {d} then g.lam else e.lam end as lam from e{j} e join ge{j} g using (i, k))"""
    if not prior:
        return out + f", q{j + 1} as (select * from q{j})"
    out += f", v{j} as (select i, sum(p * alpha / lam) as mean, sum(p * ({psi('alpha')} - ln(lam))) + ln(any_value(l0)) as v from e{j + 1} join q{j} using (i, d) where d = {d} group by i)"
    out += f", w{j}_0 as (select *, case when v >= -2.22 then exp(v) + 0.5 else -1 / (v + 0.5772156649) end as x from v{j})"
    for t in range(6):
        out += f", w{j}_{t + 1} as (select i, mean, v, x - ({psi('x')} - v) / {psi1('x')} as x from w{j}_{t})"
    return out + f", q{j + 1} as (select i, q.d, case when q.d = {d} then x else a0 end as a0, case when q.d = {d} then x / mean else l0 end as l0 from q{j} q join w{j}_6 using (i))"


START = ", e0 as (select * from effects), q0 as (select i, d, 1.0::double as a0, 1.0::double as l0 from samples, ds)"
EFFECTS_OUT = "select i, d, k, round(p, 5) + 0.0 as p, round(alpha, 4) + 0.0 as alpha, round(lam, 4) + 0.0 as lambda from "


def sweeps_sql(steps: list[float], f: str = "f0", prior: bool = True) -> str:
    """All effects in turn, once for each step size; the last tables are e{n} and q{n}."""
    return START + "".join(effect_sql(D * t + d, d + 1, rho, f, prior) for t, rho in enumerate(steps) for d in range(D))


def bound_sql(j: int, f: str) -> str:
    """Evidence bound of all samples at e{j} and q{j}."""
    kl = f"(alpha - a0) * {psi('alpha')} + a0 * (ln(lam) - ln(l0)) - lgamma(alpha) + lgamma(a0) - (lam - l0) * alpha / lam"
    return shares_sql(j, f) + f""", zb as (select sum(xi * y * (elf + ml) - case when xi > 0 then y * xi * ln(xi) else 0 end) as v from xs{j}),
ze as (select sum(-p * alpha / lam * f_sum - case when p > 0 then p * ln(p) else 0 end - p * ({kl})) as v from e{j} join q{j} using (i, d) join (select k, sum(f) as f_sum from {f} group by k) using (k)),
zk as (select count(*) * {D} * ln({K}) as v from samples)
select round((select v from zb) + (select v from ze) - (select v from zk), 2) as elbo"""


def effects_out(x: DataFrame) -> DataFrame:
    return x.select("i", *longs(x, "d", "k"), *r6("p", digits=5), *r6("alpha", "lambda", digits=4))


def _hashed(ids: np.ndarray):
    return fits.hashed_effects(ids, D, K)


def _fixed(spark: SparkSession, sf_dir: str, its: int) -> fits.EffectsFit:
    c, f, _ = hashed_state(spark, sf_dir)
    return fits.mf_susie_fixed(c, f, D, its, gamma_step_init=0.5, gamma_step_ramp=3, given=_hashed)


query("mf_susie_fixed_T2", PRELUDE + sweeps_sql([0.5, 0.75]) + EFFECTS_OUT + f"e{2 * D}")(lambda s, d: effects_out(_fixed(s, d, 2).effects_df()))
query("mf_susie_fixed_priors", PRELUDE + sweeps_sql([0.5, 0.75]) + f"select i, d, round(a0, 4) + 0.0 as alpha0, round(l0, 4) + 0.0 as lambda0 from q{2 * D}")(lambda s, d: (x := _fixed(s, d, 2).priors_df()).select("i", *longs(x, "d"), *r6("alpha0", "lambda0", digits=4)))
query("mf_elbo", PRELUDE + sweeps_sql([0.5]) + bound_sql(D, "f0"))(lambda s, d: _fixed(s, d, 1).history_df().select(*r6("elbo", digits=2)))

#: Factors that are not normalised: rows scaled by 20, 40 and 60.
SCALED = ", fu as (select k, m, f * 20 * k as f from f0)"


def _scaled(spark: SparkSession, sf_dir: str) -> fits.EffectsFit:
    c, f, _ = hashed_state(spark, sf_dir)
    return fits.poisson_susie(c, f * 20 * np.arange(1, K + 1)[:, None], D, 1, given=_hashed)


query("poisson_susie_T1", PRELUDE + SCALED + sweeps_sql([1.0], "fu") + EFFECTS_OUT + f"e{D}")(lambda s, d: effects_out(_scaled(s, d).effects_df()))
query("one_data_elbo", PRELUDE + SCALED + sweeps_sql([1.0], "fu") + bound_sql(D, "fu"))(lambda s, d: _scaled(s, d).history_df().select(*r6("elbo", digits=2)))

LEARNED_T1 = sweeps_sql([0.5]) + shares_sql(D, "f0") + f""", fa as (select k, m, coalesce(sum(xi * y * p), 0) + 2.220446049250313e-16 as a from f0 left join (select * from xs{D} join e{D} using (i, d)) using (k, m) group by all),
fn as (select f0.k, f0.m, 0.7 * f + 0.3 * a / sum(a) over (partition by f0.k) as f from f0 join fa using (k, m))
select k, m, round(f / sum(f) over (partition by k), 6) + 0.0 as f from fn"""


@query("mf_susie_T1", PRELUDE + LEARNED_T1)
def mf_susie_t1(spark, sf_dir):
    c, f, _ = hashed_state(spark, sf_dir)
    x = fits.mf_susie(c, K, D, 1, init="given", factors=f, given=_hashed, gamma_step_init=0.5, F_step_init=0.3).factors_df()
    return x.select(*longs(x, "k", "m"), *r6("f"))


# The same by blocks of eight features: factors and sums over features stay tables.

BLOCKED = {"size": 8, "pieces": 2000}


def _block_factors(spark: SparkSession, M: int):
    return blocked.factors_by(spark, M, K, BLOCKED["size"], lambda m: fits.hashed_factors(m, K))


def _f6(x: DataFrame) -> DataFrame:
    return x.select(*longs(x, "k", "m"), *r6("f"))


query("nmf_T2_blocks", ORACLES["nmf_T2"])(lambda s, d: _f6(blocked.poisson_nmf(C.customer_by(s, d, "p_brand"), K, 2, **BLOCKED).factors_df()))


@query("mf_susie_T1_blocks", ORACLES["mf_susie_T1"])
def mf_susie_t1_blocks(spark, sf_dir):
    c = C.customer_by(spark, sf_dir, "p_brand")
    return _f6(blocked.mf_susie(c, K, D, 1, init="given", factors=_block_factors(spark, c.n_features()), given=_hashed, gamma_step_init=0.5, F_step_init=0.3, **BLOCKED).factors_df())


@query("soft_mixture_T1_blocks", ORACLES["soft_mixture_T1"])
def soft_mixture_t1_blocks(spark, sf_dir):
    c, _, g = hashed_state(spark, sf_dir)
    x = blocked.soft_mixture_fixed(c, _block_factors(spark, c.n_features()), g, max_iters=1, n_inner=1, update_F=True, **BLOCKED).motifs_df()
    return x.select(*longs(x, "s", "d", "k"), *r6("p"))


@query("hard_mixture_T1_blocks", ORACLES["hard_mixture_T1"])
def hard_mixture_t1_blocks(spark, sf_dir):
    c = C.customer_by(spark, sf_dir, "p_brand")
    return _f6(blocked.hard_mixture_fixed(c, _block_factors(spark, c.n_features()), np.array([[1, 2], [2, 3], [3, 1]]), max_iters=1, n_inner=2, update_F=True, F_step_init=0.2, F_step_ramp=20, **BLOCKED).factors_df())

# Several starts side by side.

SHIFTS = (0, 311, 622)


@query("nmf_three_starts", " union all ".join(f"(select {n} as start, * from ({PRELUDE.replace('m * 104729) % 1009', f'm * 104729 + {shift}) % 1009')}{NMF}select k, m, round(f, 6) + 0.0 as f from f1))" for n, shift in enumerate(SHIFTS, 1)))
def nmf_three_starts(spark, sf_dir):
    """Three fits in the passes of one."""
    c = C.customer_by(spark, sf_dir, "p_brand")
    out = None
    for n, fit in enumerate(fits.poisson_nmf_many(c, K, 1, [fits.hashed_init(K, c.n_features(), shift) for shift in SHIFTS]), 1):
        x = fit.factors_df()
        x = x.select(F.lit(n).cast("long").alias("start"), *longs(x, "k", "m"), *r6("f"))
        out = x if out is None else out.unionByName(x)
    return out


# Summaries of motifs that a fit has learned from the table.

LEARNED = PRELUDE + SOFT_T1.rsplit("\nselect ", 1)[0] + """,
learned as (select s, d, k, greatest(q, 1e-12) / sum(greatest(q, 1e-12)) over (partition by s, d) as p from q),
lent as (select s, d, sum(-p * ln(p)) / ln(3) as gamma_entropy, max(p) as top_gamma from learned group by all)
"""


def learned_fit(spark: SparkSession, sf_dir: str) -> fits.MixtureFit:
    c, f, g = hashed_state(spark, sf_dir)
    return fits.soft_mixture_fixed(c, f, g, max_iters=1, n_inner=1, update_F=True)


def on_learned(name: str, sql: str):
    return lambda f: query(name, LEARNED + sql)(lambda spark, sf_dir: f(learned_fit(spark, sf_dir).motifs_df()))


on_learned("motif_entropy_learned", "select s, d, round(gamma_entropy, 6) + 0.0 as gamma_entropy, round(top_gamma, 6) + 0.0 as top_gamma from lent")(lambda m: (x := S.motif_entropy(m)).select(*longs(x, "s", "d"), *r6("gamma_entropy", "top_gamma")))
on_learned("gamma_uncertainty_learned", "select round(avg(gamma_entropy), 6) + 0.0 as mean_gamma_entropy, round(max(gamma_entropy), 6) + 0.0 as max_gamma_entropy, round(avg(top_gamma), 6) + 0.0 as mean_top_gamma, round(min(top_gamma), 6) + 0.0 as min_top_gamma from lent")(lambda m: S.gamma_uncertainty(m).select(*r6("mean_gamma_entropy", "max_gamma_entropy", "mean_top_gamma", "min_top_gamma")))
on_learned("top_two_gap_learned", "select s, d, t[1].k as top_factor, round(t[1].p, 6) + 0.0 as top_gamma, t[2].k as second_factor, round(t[2].p, 6) + 0.0 as second_gamma, round(t[1].p - t[2].p, 6) + 0.0 as gap from (select s, d, list({'k': k, 'p': p} order by p desc, k) as t from learned group by all)")(lambda m: (x := S.top_two(m)).select(*longs(x, "s", "d", "top_factor", "second_factor"), *r6("top_gamma", "second_gamma", "gap")))
on_learned("pair_split_learned", "select s, d, round(p1 + p2, 6) + 0.0 as mass, round(2 * least(p1, p2) / (p1 + p2), 6) + 0.0 as split, round((p1 + p2) * 2 * least(p1, p2), 6) + 0.0 as targeted from (select s, d, sum(p) filter (k = 1) as p1, sum(p) filter (k = 2) as p2 from learned group by all)")(lambda m: (x := S.pair_split(m, 1, 2)).select(*longs(x, "s", "d"), *r6("mass", "split", "targeted")))
# The bound of the first iteration: responsibilities' part at a uniform mixture, less the divergence of the motifs that follow from flat ones.
query("soft_mixture_bound", LEARNED + f"""select round((select sum(z) from (select i, max(x) + ln(sum(exp(x - t))) as z from (select i, x, max(x) over (partition by i) as t from (select i, data - cost - ln({S_}) as x from b1 join b2 using (i, s))) group by i))
  - (select sum(p * (ln(greatest(p, 1e-12)) - ln(1.0 / {K}))) from learned), 3) as elbo""")(lambda s, d: learned_fit(s, d).history_df().select(*r6("elbo", digits=3)))

MOTIFS = RECURSIVE + MOTIF_STEP.rsplit("\nselect ", 1)[0] + f""",
hm as (select s, d, ks[(d - 1) % least(len(ks), {D}) + 1]::bigint as k from act, ds)
"""


def on_motifs(name: str, sql: str):
    return lambda f: query(name, MOTIFS + sql)(lambda spark, sf_dir: f(hard_motif_step(spark, sf_dir)))


on_motifs("motif_table_learned", "select s, string_agg(distinct k::varchar, ',' order by k::varchar) as label from hm group by s")(lambda h: S.motif_table(h))
on_motifs("translate_motifs_learned", "select s, d, case k when 1 then 3 when 2 then 1 else -1 end as k from hm")(lambda h: S.translate_motifs(h, h.sparkSession.createDataFrame([(1, 3), (2, 1), (3, None)], "k int, true_k int")).select("s", "d", F.coalesce("k", F.lit(-1)).cast("long").alias("k")))
on_motifs("slot_changes_learned", "select count(*) filter (k <> (s + d - 2) % 3 + 1) as n_changed, count(*) as n from hm")(lambda h: S.slot_changes(h.withColumn("k", (F.col("s") + F.col("d") - 2) % 3 + 1), h))
on_motifs("gamma_from_motifs", f"select s, d, ks.k, round(0.05 / {K} + case when hm.k = ks.k then 0.95 else 0 end, 6) as p from hm, ks")(lambda h: peaked_from(h))


def peaked_from(hard: DataFrame) -> DataFrame:
    motifs = np.zeros((S_, D), int)
    for r in hard.collect():  # components times slots
        motifs[r.s - 1, r.d - 1] = r.k
    x = fits._long(hard.sparkSession, fits.peaked_gamma(motifs, K, 0.05), ("s", "d", "k"), "p")
    return x.select(*longs(x, "s", "d", "k"), *r6("p"))


def _bound_parts(j: int, shared: bool) -> tuple[str, str]:
    """Tables of the bound at e{j}, under names of their own, and its value; shared: the next sweep has the shares already."""
    tables, value = bound_sql(j, "f0").rsplit("\nselect ", 1)
    for name in ("zb", "ze", "zk"):
        tables, value = tables.replace(f"{name} as", f"{name}{j} as"), value.replace(f"from {name})", f"from {name}{j})")
    return tables.removeprefix(shares_sql(j, "f0")) if shared else tables, value.removesuffix(" as elbo")


_one, _two = _bound_parts(D, True), _bound_parts(2 * D, False)
query("elbo_curve", PRELUDE + sweeps_sql([0.5, 0.75]) + _one[0] + _two[0] + f"\nselect 1::bigint as iter, {_one[1]} as elbo, null::double as gain union all select 2, {_two[1]}, round({_two[1]} - {_one[1]}, 1)")(lambda s, d: figures.elbo_curve(_fixed(s, d, 2).history_df()).select(F.col("iter").cast("long").alias("iter"), F.round("elbo", 2).alias("elbo"), F.round(F.col("gain"), 1).alias("gain")))


query("damping_schedule", "select it, round(least(1.0, 0.1 + 0.9 * (it - 1) / 49), 6) as step from (select unnest(range(1, 61)) as it)")(lambda s, d: s.createDataFrame([(t, damping(0.1, 50, t)) for t in range(1, 61)], "it long, step double").select("it", *r6("step")))


@query("early_stop", """with v as (select it, -1000.0::double / it as value from (select unnest(range(1, 61)) as it)),
g as (select it, it >= 10 and (value - lag(value) over (order by it)) / (abs(lag(value) over (order by it)) + 1) < 0.04 as small from v)
select min(it) as it from (select it, small and lag(small) over (order by it) and lag(small, 2) over (order by it) as stop from g) where stop""")
def early_stop(spark, sf_dir):
    """The evaluation at which a rising bound stops a fit."""
    stop = Stopper(0.04, 10, 3)
    return spark.createDataFrame([(next(t for t in range(1, 61) if stop(t, -1000.0 / t)),)], "it long")


@on_posterior("init_gamma_from_loadings", """, rk0 as (select i, k, row_number() over (partition by i order by l desc, k) as rank from l0)
select i, d, k, round(0.03 / 3 + case when rank = (d - 1) % 3 + 1 then 0.97 else 0 end, 6) as p from rk0, (select unnest(range(1, 6)) as d)""")
def init_gamma_from_loadings(p: Posterior) -> DataFrame:
    """Five slots over three factors: the largest loading first, wrapping around."""

    def run(batches):
        for b in batches:
            g = fits.top_loadings(np.array(b["l"].to_list()).reshape(len(b), K), 5, 0.03)
            n, slots, ks = g.shape
            at = np.indices(g.shape).reshape(3, -1)
            yield pd.DataFrame({"i": b["i"].to_numpy()[at[0]], "d": at[1] + 1, "k": at[2] + 1, "p": g.ravel()})

    ship(p.truth.sparkSession)
    return _packed_l(p).mapInPandas(run, "i long, d long, k long, p double").select("i", "d", "k", *r6("p"))


RESULTS = "(select c_mktsegment as scenario, case c_nationkey % 2 when 0 then 'a' else 'b' end as method, c_custkey % 3 as seed, " + ", ".join(f"case when c_custkey % 7 = {j} then null else c_acctbal / (100.0 + {j}) end as {m}" for j, m in enumerate(S.METRICS)) + " from customer)"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    metrics = [F.when(F.col("c_custkey") % 7 != j, F.col("c_acctbal") / (100.0 + j)).alias(m) for j, m in enumerate(S.METRICS)]
    return c.select(F.col("c_mktsegment").alias("scenario"), F.when(F.col("c_nationkey") % 2 == 0, "a").otherwise("b").alias("method"), (F.col("c_custkey") % 3).alias("seed"), *metrics)


query("metric_by_seed", "select scenario, method, seed, round(value, 5) + 0.0 as value from (select scenario, method, seed, " + S.METRICS[0] + f" as value from {RESULTS}) where value is not null")(lambda s, d: figures.metric_by_seed(_results(s, d), S.METRICS[0]).select("scenario", "method", "seed", *r6("value", digits=5)))


@query("mf_susie_full")
def mf_susie_full(spark, sf_dir):
    return fits.mf_susie(C.customer_by(spark, sf_dir, "p_brand"), K, D, 5, seed=1, nmf_iters=5).effects_df()


@query("mf_susie_fixed_F")
def mf_susie_fixed_full(spark, sf_dir):
    c, f, _ = hashed_state(spark, sf_dir)
    return fits.mf_susie_fixed(c, f, D, 10, seed=1).effects_df()


@query("poisson_susie_full")
def poisson_susie_full(spark, sf_dir):
    sim = simulate.duplicate_vector(spark, 500)
    return fits.poisson_susie(sim.counts, sim.factors, 5, 100, seed=3).effects_df()


@query("hard_mixture_full")
def hard_mixture_full(spark, sf_dir):
    return fits.hard_mixture(C.customer_by(spark, sf_dir, "p_brand"), K, S_, D, 3, 4, 3, 5, seed=1).responsibilities_df()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ladder on customers by brand: factors, effects, motifs, soft mixture; each customer's responsibilities."""
    return fits.soft_mixture(C.customer_by(spark, sf_dir, "p_brand"), K, S_, D, 3, 2, 3, 5, seed=1).responsibilities_df()


query("soft_mixture_full")(flagship)
query("stream_scoring")(lambda spark, sf_dir: _stream(spark, sf_dir))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed samples streamed through a mixture with fixed parameters."""
    c, f, g = hashed_state(spark, sf_dir)
    fit = fits.soft_mixture_fixed(c, f, g, max_iters=1, n_inner=1)
    _, path = write(c.packed(), "stream-in")
    out, to = write(spark.createDataFrame([], "i long, s int, w double, z_hat int"), "stream-out")
    scored = scoring.score_mixture(spark.readStream.schema(scoring.PACKED).parquet(path), fit)
    query_ = scored.writeStream.format("parquet").option("checkpointLocation", f"{to}-state").option("path", f"{to}/rows").trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{to}/rows")


# Summaries.

on_posterior("loading_scores", "select i, k, round(score, 6) + 0.0 as score from scores", SCORES)(lambda p: (x := S.loading_scores(p.effects)).select("i", *longs(x, "k"), *r6("score")))
on_posterior("inclusion_probability", "select i, k, round(1 - product(1 - p), 6) + 0.0 as pip from effects group by all")(lambda p: (x := S.inclusion_probability(p.effects)).select("i", *longs(x, "k"), *r6("pip")))
on_posterior("assignment_scores", "select i, k, round(sum(p), 6) + 0.0 as score from effects group by all")(lambda p: (x := S.assignment_scores(p.effects)).select("i", *longs(x, "k"), *r6("score")))
on_posterior("effect_sizes", "select i, d, round(size, 6) + 0.0 as size, top_factor, round(top_gamma, 6) + 0.0 as top_gamma, round(entropy, 6) + 0.0 as entropy from sizes", SIZES)(lambda p: (x := S.effect_sizes(p.effects)).select("i", *longs(x, "d", "top_factor"), *r6("size", "top_gamma", "entropy")))
on_posterior("effect_rank_summary", "select rank, round(avg(size), 6) + 0.0 as mean_size, round(median(size), 6) + 0.0 as median_size, round(avg(entropy), 6) + 0.0 as mean_entropy, round(avg(top_gamma), 6) + 0.0 as mean_top_gamma from ranked group by rank", SIZES)(lambda p: (x := S.effect_rank_summary(S.effect_sizes(p.effects))).select(*longs(x, "rank"), *r6("mean_size", "median_size", "mean_entropy", "mean_top_gamma")))
on_posterior("extra_mass_fraction", "select round(avg(extra), 6) + 0.0 as mean, round(median(extra), 6) + 0.0 as median, round(quantile_cont(extra, 0.9), 6) + 0.0 as q90 from extra", SIZES)(lambda p: S.extra_mass_summary(S.extra_mass(S.effect_sizes(p.effects), p.truth)).select(*r6("mean", "median", "q90")))
on_posterior("extra_mass_by_group", "select grp, round(avg(extra), 6) + 0.0 as mean, round(median(extra), 6) + 0.0 as median, round(quantile_cont(extra, 0.9), 6) + 0.0 as q90 from extra group by grp", SIZES)(lambda p: (x := S.extra_mass_summary(S.extra_mass(S.effect_sizes(p.effects), p.truth), "grp")).select(*longs(x, "grp"), *r6("mean", "median", "q90")))
on_posterior("normalized_entropy", "select i, round(sum(-q * ln(q)) / ln(3), 6) + 0.0 as entropy from (select i, score / sum(score) over (partition by i) as q from scores) group by i", SCORES)(lambda p: S.normalized_entropy(S.loading_scores(p.effects)).select("i", *r6("entropy")))
on_posterior("usage_fractions", "select k, round(sum(score) / (select sum(score) from scores), 6) + 0.0 as usage from scores group by k", SCORES)(lambda p: (x := S.usage_fractions(S.loading_scores(p.effects))).select(*longs(x, "k"), *r6("usage")))
on_posterior("support_labels", "select i, label from lab", LABELS)(lambda p: S.support_labels(S.loading_scores(p.effects), p.truth))
on_posterior("support_accuracy", "select round(avg(case when lab.label = truth.label then 1.0 else 0.0 end), 6) as support_accuracy, count(*) as n from truth left join lab using (i)", LABELS)(lambda p: S.support_accuracy(S.support_labels(S.loading_scores(p.effects), p.truth), p.truth).select("n", *r6("support_accuracy")))
on_posterior("recovered_pattern_counts", "select grp, lab.label as label, count(*) as n from lab join truth using (i) group by all", LABELS)(lambda p: (x := S.recovered_patterns(S.support_labels(S.loading_scores(p.effects), p.truth), p.truth)).select(*longs(x, "grp"), "label", "n"))
on_posterior("map_scores_to_true", "select i, k, round(sum(score), 6) + 0.0 as score from (select i, case k when 1 then 2 when 2 then 2 end as k, score from scores) where k is not null group by all", SCORES)(lambda p: (x := S.map_to_true(S.loading_scores(p.effects), p.truth.sparkSession.createDataFrame([(1, 2), (2, 2), (3, None)], "k int, true_k int"))).select("i", *longs(x, "k"), *r6("score")))


def _beta(p: Posterior) -> DataFrame:
    return S.slot_beta(p.alpha, p.omega, _rates(p))


def _mscores(p: Posterior) -> DataFrame:
    return S.motif_scores(_beta(p), p.motif, p.priors)


def _activity(p: Posterior) -> DataFrame:
    return S.slot_activity(_beta(p), p.motif, p.priors)


ACTIVITY = ("beta_mean", "slot_scale", "effective_beta", "beta_fraction", "prior_mean", "prior_fraction", "gamma_entropy", "top_gamma")
on_posterior("motif_scores", "select s, k, round(score, 6) + 0.0 as score from mscores", BETA)(lambda p: (x := _mscores(p)).select(*longs(x, "s", "k"), *r6("score")))
on_posterior("motif_entropy", "select s, d, round(gamma_entropy, 6) + 0.0 as gamma_entropy, round(top_gamma, 6) + 0.0 as top_gamma from ent", BETA)(lambda p: (x := S.motif_entropy(p.motif)).select(*longs(x, "s", "d"), *r6("gamma_entropy", "top_gamma")))
on_posterior("slot_activity", "select submanifold, slot, " + ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in ACTIVITY) + " from activity", BETA)(lambda p: (x := _activity(p)).select(*longs(x, "submanifold", "slot"), *r6(*ACTIVITY)))


@on_posterior("dimension_selection", """select submanifold, count(*) filter (prior_fraction >= 0.4) as D_hat_ard, count(*) filter (beta_fraction >= 0.45) as D_hat_beta, count(*) filter (prior_fraction >= 0.4 or beta_fraction >= 0.45) as D_hat_ard_or_beta,
count(*) filter (not (beta_fraction < 0.45 and gamma_entropy >= 0.8)) as D_hat_diffuse_heuristic, round(max(prior_fraction), 6) + 0.0 as max_prior_fraction, round(min(prior_fraction) filter (prior_fraction >= 0.4), 6) + 0.0 as min_active_prior_fraction from activity group by submanifold""", BETA)
def dimension_selection(p: Posterior) -> DataFrame:
    x = S.dimension_selection(S.flagged_slots(_activity(p), 0.4, 0.45, 0.8))
    return x.select(*longs(x, "submanifold"), "D_hat_ard", "D_hat_beta", "D_hat_ard_or_beta", "D_hat_diffuse_heuristic", *r6("max_prior_fraction", "min_active_prior_fraction"))


UNSURE = ("mean_gamma_entropy", "max_gamma_entropy", "mean_top_gamma", "min_top_gamma")
on_posterior("gamma_uncertainty_summary", "select round(avg(gamma_entropy), 6) + 0.0 as mean_gamma_entropy, round(max(gamma_entropy), 6) + 0.0 as max_gamma_entropy, round(avg(top_gamma), 6) + 0.0 as mean_top_gamma, round(min(top_gamma), 6) + 0.0 as min_top_gamma from ent", BETA)(lambda p: S.gamma_uncertainty(p.motif).select(*r6(*UNSURE)))
query("empty_uncertainty_summary", "select " + ", ".join(f"null::double as {c}" for c in UNSURE))(lambda s, d: S.no_uncertainty(s))


@on_posterior("top_two_gap", "select s, d, t[1].k as top_factor, round(t[1].p, 6) + 0.0 as top_gamma, t[2].k as second_factor, round(t[2].p, 6) + 0.0 as second_gamma, round(t[1].p - t[2].p, 6) + 0.0 as gap from (select s, d, list({'k': k, 'p': p} order by p desc, k) as t from motif group by all)")
def top_two_gap(p: Posterior) -> DataFrame:
    x = S.top_two(p.motif)
    return x.select(*longs(x, "s", "d", "top_factor", "second_factor"), *r6("top_gamma", "second_gamma", "gap"))


PAIR = ", pr as (select s, d, sum(p) filter (k = 1) as p1, sum(p) filter (k = 2) as p2 from motif group by all)\n"
on_posterior("duplicate_pair_split", "select s, d, round(p1 + p2, 6) + 0.0 as mass, round(2 * least(p1, p2) / (p1 + p2), 6) + 0.0 as split from pr", PAIR)(lambda p: (x := S.pair_split(p.motif, 1, 2)).select(*longs(x, "s", "d"), *r6("mass", "split")))
on_posterior("targeted_pair_uncertainty", "select s, d, round((p1 + p2) * 2 * least(p1, p2), 6) + 0.0 as targeted from pr", PAIR)(lambda p: (x := S.pair_split(p.motif, 1, 2)).select(*longs(x, "s", "d"), *r6("targeted")))
GROUP = ", gr as (select grp, s, avg(w) as w from omega join truth using (i) group by all)\n"
on_posterior("group_responsibility", "select grp, s, round(w, 6) + 0.0 as w from gr", GROUP)(lambda p: (x := S.group_responsibility(p.omega, p.truth)).select(*longs(x, "grp", "s"), *r6("w")))
on_posterior("submanifold_group_match", "select s, arg_max(grp, (w, -grp)) as grp, round(max(w), 6) + 0.0 as w from gr group by s", GROUP)(lambda p: (x := S.submanifold_match(S.group_responsibility(p.omega, p.truth))).select(*longs(x, "s", "grp"), *r6("w")))
on_posterior("max_responsibility", "select i, round(max(w), 6) + 0.0 as w, arg_max(s, (w, -s)) as z_hat from omega group by i")(lambda p: (x := S.max_responsibility(p.omega)).select("i", *longs(x, "z_hat"), *r6("w")))
on_posterior("soft_scores", "select i, k, round(sum(w * score), 6) + 0.0 as score from omega join mscores using (s) group by all", BETA)(lambda p: (x := S.soft_scores(p.omega, _mscores(p))).select("i", *longs(x, "k"), *r6("score")))
NEAR = FT + ", near as (select k, arg_max(true_k, (cosine, -true_k)) as nearest_true, max(cosine) as cosine from sim group by k)\n"
on_posterior("nearest_true", "select k, nearest_true, round(cosine, 6) + 0.0 as cosine from near", NEAR)(lambda p: (x := S.nearest_true(_sim(p))).select(*longs(x, "k", "nearest_true"), *r6("cosine")))


def _competing(p: Posterior) -> DataFrame:
    pairs = [(k, (k + 1) // 2) for k in range(1, 6)]
    return p.truth.sparkSession.createDataFrame(pairs, "k int, nearest_true int")


query("competing_sets", "select * from (values (1, '1,2', 2), (2, '3,4', 2)) t(true_k, factors, n)")(lambda s, d: (x := S.competing_sets(s.createDataFrame([(k, (k + 1) // 2) for k in range(1, 6)], "k int, nearest_true int"))).select("true_k", "factors", F.col("n").cast("int").alias("n")))
CAND = NEAR + ", cand as (select nearest_true as true_k, k from near union select true_k, k from (select *, row_number() over (partition by true_k order by cosine desc, k) as r from sim) where r <= 2)\n"
on_posterior("candidate_sets", "select true_k, k from cand", CAND)(lambda p: (x := S.candidate_sets(_sim(p), 2)).select(*longs(x, "true_k", "k")))
SHARES = SCORES.replace(", scores", ", members as (select k, (k + 1) // 2 as true_k from ks), scores") + ", sh as (select i, true_k, k, score / sum(score) over (partition by i, true_k) as share from scores join members using (k))\n"


def _members(p: Posterior) -> DataFrame:
    return p.truth.sparkSession.createDataFrame([(k, (k + 1) // 2) for k in range(1, K + 1)], "k int, true_k int")


on_posterior("conditional_shares", "select i, true_k, k, round(share, 6) + 0.0 as share from sh", SHARES)(lambda p: (x := S.conditional_shares(S.loading_scores(p.effects), _members(p))).select("i", *longs(x, "true_k", "k"), *r6("share")))
on_posterior("competing_entropy", "select true_k, round(avg(h / ln(n)), 6) + 0.0 as mean_entropy, max(n) as n from (select i, true_k, sum(-share * ln(share)) as h, count(*) as n from sh group by all) where n > 1 group by true_k", SHARES)(lambda p: (x := S.set_entropy(S.conditional_shares(S.loading_scores(p.effects), _members(p)))).select(*longs(x, "true_k"), "n", *r6("mean_entropy")))
SHARE = SCORES + ", gs as (select grp, k, mean, mean / sum(mean) over (partition by grp) as share from (select grp, k, avg(score) as mean from scores join truth using (i) group by all))\n"
on_posterior("group_loading_share", "select grp, k, round(mean, 6) + 0.0 as mean, round(share, 6) + 0.0 as share from gs", SHARE)(lambda p: (x := S.group_share(S.loading_scores(p.effects), p.truth)).select(*longs(x, "grp", "k"), *r6("mean", "share")))
on_posterior("branch_pivot", "select grp, round(sum(share) filter (k = 1), 6) + 0.0 as k1, round(sum(share) filter (k = 2), 6) + 0.0 as k2, round(sum(share) filter (k = 3), 6) + 0.0 as k3 from gs group by grp", SHARE)(lambda p: (x := S.branch_pivot(S.group_share(S.loading_scores(p.effects), p.truth), K)).select(*longs(x, "grp"), *r6("k1", "k2", "k3")))
on_posterior("motif_score_table", "select s, string_agg(k::varchar || ':' || printf('%.2f', score), ' ' order by rank) as label from (select *, row_number() over (partition by s order by score desc, k) as rank from mscores) where rank <= 2 group by s", BETA)(lambda p: (x := S.score_labels(_mscores(p), 2)).select(*longs(x, "s"), "label"))
HARD = ", hard as (select s, d, (s * 2 + d) % 3 + 1 as k from ss, ds)\n"


def _hard(p: Posterior) -> DataFrame:
    return p.priors.select("s", "d", ((F.col("s") * 2 + F.col("d")) % 3 + 1).cast("int").alias("k"))


on_posterior("motif_table", "select s, string_agg(distinct k::varchar, ',' order by k::varchar) as label from hard group by s", HARD)(lambda p: (x := S.motif_table(_hard(p))).select(*longs(x, "s"), "label"))
on_posterior("translate_motifs", "select s, d, case k when 1 then 3 when 2 then 1 else -1 end as k from hard", HARD)(lambda p: (x := S.translate_motifs(_hard(p), p.truth.sparkSession.createDataFrame([(1, 3), (2, 1), (3, None)], "k int, true_k int"))).select(*longs(x, "s", "d"), F.coalesce("k", F.lit(-1)).alias("k")))
on_posterior("slot_changes", "select count(*) filter (k <> d) as n_changed, count(*) as n from hard", HARD)(lambda p: S.slot_changes(_hard(p), p.priors.select("s", "d", F.col("d").alias("k"))))
EXTRA = BETA + ", xs as (select *, row_number() over (partition by submanifold order by effective_beta desc, slot) > 1 as extra from activity)\n"


def _extra(p: Posterior) -> DataFrame:
    return S.extra_slots(_activity(p), p.priors.select(F.col("s").alias("submanifold")).distinct().withColumn("true_dim", F.lit(1)))


on_posterior("slot_diagnostics", "select submanifold, slot, extra, round(effective_beta, 6) + 0.0 as effective_beta from xs", EXTRA)(lambda p: (x := _extra(p)).select(*longs(x, "submanifold", "slot"), "extra", *r6("effective_beta")))
on_posterior("extra_slot_summary", "select count(*) filter (extra) as n_extra, round(avg(beta_fraction) filter (extra), 6) + 0.0 as mean_extra_fraction, round(max(beta_fraction) filter (extra), 6) + 0.0 as max_extra_fraction, round(avg(gamma_entropy) filter (extra), 6) + 0.0 as mean_extra_entropy, round((select avg(m) from (select sum(case when extra then beta_fraction else 0 end) as m from xs group by submanifold)), 6) + 0.0 as mean_extra_mass from xs", EXTRA)(lambda p: S.extra_slot_summary(_extra(p)).select("n_extra", *r6("mean_extra_fraction", "max_extra_fraction", "mean_extra_entropy", "mean_extra_mass")))

# Evaluation.

on_posterior("match_factor_rows", ", perms as (select a.k as k1, b.k as k2, c.k as k3 from ks a, ks b, ks c where a.k <> b.k and a.k <> c.k and b.k <> c.k), tot as (select k1, k2, k3, round(x.cosine + y.cosine + z.cosine, 12) as t from perms join sim x on x.k = 1 and x.true_k = k1 join sim y on y.k = 2 and y.true_k = k2 join sim z on z.k = 3 and z.true_k = k3), best as (select * from tot order by t desc, k1, k2, k3 limit 1) select k, true_k, round(cosine, 6) + 0.0 as cosine from sim, best where (k = 1 and true_k = k1) or (k = 2 and true_k = k2) or (k = 3 and true_k = k3)", FT)(lambda p: (x := matching.permutation_match(_sim(p), K)).select(*longs(x, "k", "true_k"), *r6("cosine")))


@query("match_rectangular")
def match_rectangular(spark, sf_dir):
    true = simulate.sparse_factors(5, 120, 9)
    return matching.match_rectangular(simulate.with_duplicates(true, (0, 1), 10), true).table(spark)


Z = ", z as (select i, arg_max(s, (w, -s)) as z, grp from omega join truth using (i) group by i, grp), tab as (select z, grp, count(*) as n from z group by all)\n"


def _labels(p: Posterior) -> DataFrame:
    return S.max_responsibility(p.omega).select("i", F.col("z_hat").alias("z")).join(p.truth, "i")


GRID34 = Z + ", gs as (select unnest(range(1, 5)) as g), cells34 as (select s as z, g as grp, coalesce(n, 0) as n from ss cross join gs left join tab on tab.z = s and tab.grp = g)\n"
on_posterior("cluster_accuracy", "select round(max(a.n + b.n + c.n) / (select sum(n) from tab), 6) as accuracy from cells34 a join cells34 b on b.grp <> a.grp join cells34 c on c.grp <> a.grp and c.grp <> b.grp where a.z = 1 and b.z = 2 and c.z = 3", GRID34)(lambda p: p.truth.sparkSession.createDataFrame([(matching.cluster_accuracy(_labels(p)),)], "accuracy double").select(*r6("accuracy")))
GREEDY = GRID34 + """, p1 as (select * from cells34 order by n desc, grp, z limit 1),
p2 as (select * from cells34 where z not in (select z from p1) and grp not in (select grp from p1) order by n desc, grp, z limit 1),
p3 as (select * from cells34 where z not in (select z from p1 union all select z from p2) and grp not in (select grp from p1 union all select grp from p2) order by n desc, grp, z limit 1)
"""
on_posterior("cluster_accuracy_greedy", "select round(((select n from p1) + (select n from p2) + (select n from p3)) / (select sum(n) from tab), 6) as accuracy", GREEDY)(lambda p: p.truth.sparkSession.createDataFrame([(matching.cluster_accuracy(_labels(p), "greedy"),)], "accuracy double").select(*r6("accuracy")))
def nation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, grp (nation), z: 25 clusters that follow the nation for a fifth of the customers."""
    i, own = F.col("c_custkey"), F.col("c_nationkey")
    z = F.when(i * 31 % 100 < 20, (own * 7 + 3) % 25).otherwise(i * 7919 % 1009 % 25)
    return table(spark, sf_dir, "customer").select(i.alias("i"), (own + 1).alias("grp"), (z + 1).alias("z"))


#: Bids of rows for columns, one a step: benefits times 26 and steps of 1 end at the best assignment of 25.
AUCTION = """with recursive pairs as (select case when c_custkey * 31 % 100 < 20 then (c_nationkey * 7 + 3) % 25 else c_custkey * 7919 % 1009 % 25 end as z, c_nationkey as grp from customer),
tab as (select z, grp, count(p.z) as n from (select unnest(range(25)) as z) cross join (select unnest(range(25)) as grp) left join (select z, grp from pairs) p using (z, grp) group by all),
benefit as (select list(ns order by z) as b from (select z, list(n * 26 order by grp) as ns from tab group by z)),
bids as (
  select b, list_transform(range(25), lambda j: 0::bigint) as price, list_transform(range(25), lambda j: 0::bigint) as owner, 1::bigint as free from benefit
  union all
  select b, price, owner, (select min(r) from (select unnest(range(1, 26)) as r) where not list_contains(owner, r)) from (
    select b, list_transform(price, lambda p, j: case when j = best then p + w1 - w2 + 1 else p end) as price, list_transform(owner, lambda o, j: case when j = best then free else o end) as owner
    from (select *, list_max(list_transform(w, lambda x, j: case when j = best then -1000000000 else x end)) as w2 from (
      select *, list_max(w) as w1, list_position(w, list_max(w)) as best from (select *, list_transform(b[free], lambda x, j: x - price[j]) as w from bids where free is not null)))
  )
)
select round(sum(b[owner[j]][j]) / 26 / (select count(*) from pairs), 6) as accuracy from (select *, unnest(range(1, 26)) as j from bids where free is null)"""
query("cluster_accuracy_nations", AUCTION)(lambda s, d: s.createDataFrame([(matching.cluster_accuracy(nation_labels(s, d)),)], "accuracy double").select(*r6("accuracy")))
on_posterior("contingency_table", "select z, grp, n from tab", Z)(lambda p: (x := _labels(p).groupBy("z", "grp").agg(F.count(F.lit(1)).alias("n"))).select(*longs(x, "z", "grp"), "n"))


def _array(df: DataFrame, row: str, value: str) -> np.ndarray:
    """A small dictionary (rows times features) at the driver."""
    x = df.select(row, "m", value).toPandas()
    return x.pivot(index=row, columns="m", values=value).to_numpy()


@on_posterior("match_rectangular_dictionary", """, best as (select a.k as k1, b.k as k2 from sim a join sim b on a.k <> b.k where a.true_k = 1 and b.true_k = 2 order by round(a.cosine + b.cosine, 12) desc, k1, k2 limit 1)
select k, case k when (select k1 from best) then 1::bigint when (select k2 from best) then 2 else 0 end as true_k from ks""", FT)
def match_rectangular_dictionary(p: Posterior) -> DataFrame:
    """Three learned factors and two true ones: one is left over (0)."""
    m = matching.match_rectangular(_array(p.f0, "k", "f"), _array(_true_f(p), "true_k", "ft")[:2])
    return p.truth.sparkSession.createDataFrame([(k, t or 0) for k, t in enumerate(m.learned_to_true, 1)], "k long, true_k long")




@query("benchmark_summary", "select scenario, method, count(distinct seed) as n_seed, " + ", ".join(f"round(avg({m}), 5) + 0.0 as {m}_mean, round(stddev_samp({m}), 5) + 0.0 as {m}_sd" for m in S.METRICS) + f" from {RESULTS} group by all")
def benchmark_summary(spark, sf_dir):
    x = S.benchmark_summary(_results(spark, sf_dir))
    return x.select("scenario", "method", "n_seed", *r6(*(f"{m}_{t}" for m in S.METRICS for t in ("mean", "sd")), digits=5))


@query("summarize_values", "select c_mktsegment, round(avg(c_acctbal), 4) as mean, round(stddev_samp(c_acctbal), 4) as sd, round(median(c_acctbal), 4) as median, round(quantile_cont(c_acctbal, 0.25), 4) as q25, round(quantile_cont(c_acctbal, 0.75), 4) as q75, max(c_acctbal) as max from customer group by all")
def summarize_values(spark, sf_dir):
    return S.summarize_values(table(spark, sf_dir, "customer"), "c_acctbal", "c_mktsegment").select("c_mktsegment", *r6("mean", "sd", "median", "q25", "q75", digits=4), "max")


def _packed_scores(p: Posterior) -> DataFrame:
    return S.loading_scores(p.effects).groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "score"))), lambda x: x["score"]).alias("scores"))


@query("kmeans_clusters")
def kmeans_clusters(spark, sf_dir):
    return cluster.kmeans(_packed_scores(posterior(spark, sf_dir)), S_, 1)[1]


@on_posterior("kmeans_step", SCORES + """,
sh as (select i, k, greatest(score, 1e-12) / sum(greatest(score, 1e-12)) over (partition by i) as x from scores),
c0 as (select s, k, w / sum(w) over (partition by s) as c from (select s, k, (1 + (s * 31 + k * 17) % 23)::double as w from ss, ks)),
z as (select i, arg_min(s, (round(d, 12), s)) as s from (select i, s, sum((x - c) ** 2) as d from sh join c0 using (k) group by all) group by i)
select s, k, round(avg(x), 6) + 0.0 as c, count(*) as n from sh join z using (i) group by all""")
def kmeans_step(p: Posterior) -> DataFrame:
    """Assignment to given centres, and the clusters' means."""
    w = 1.0 + (np.arange(1, S_ + 1)[:, None] * 31 + np.arange(1, K + 1) * 17) % 23
    centers = (w / w.sum(1, keepdims=True))[None]
    ship(p.truth.sparkSession)
    total = cluster.Rows(_packed_scores(p)).sums(centers)
    rows = [(s + 1, k + 1, float(v), int(total[0, s, -2])) for (s, k), v in np.ndenumerate(cluster.moved(total, centers)[0]) if total[0, s, -2]]
    return p.truth.sparkSession.createDataFrame(rows, "s long, k long, c double, n long").select("s", "k", *r6("c"), "n")


@query("benchmark_one_seed")
def benchmark_one_seed(spark, sf_dir):
    return benchmark.run_seeds("block", lambda s: simulate.block(spark, 80, 60, 100 + s), (1,), 5, 8, 3, nmf_iters=5, mf_max_iters=3, mf_nmf_iters=5, mos_max_iters=2, mos_n_inner=2)


query("sim_block")(lambda s, d: simulate.block(s, 80, 60).counts.counts)
query("sim_tree")(lambda s, d: simulate.tree(s, 60, 60).counts.counts)
query("sim_duplicate")(lambda s, d: simulate.duplicate_dictionary(s, 80, 60)[0].counts.counts)
query("sim_correlated")(lambda s, d: simulate.correlated(s, 60, 60).counts.counts)
query("sim_hard_generic")(lambda s, d: simulate.simulate(s, 80, ((1, 2), (1, 3), (4, 5), (4, 6)), [15.0] * 4, simulate.sparse_factors(6, 60, 7, 0.15, 0.03), 7, shuffled=True).counts.counts)


# Tables behind figures, and fits side by side.

RANKS = SIZES + ", rk as (select r.*, t.grp, r.size / sum(r.size) over (partition by i) as share from ranked r join truth t using (i))\n"


def _sizes(p: Posterior) -> DataFrame:
    return S.effect_sizes(p.effects)


on_posterior("figure_rank_heatmap", "select grp, rank, round(avg(share), 6) + 0.0 as share from rk group by all", RANKS)(lambda p: (x := figures.rank_heatmap(_sizes(p), p.truth)).select(*longs(x, "grp", "rank"), *r6("share")))
on_posterior("figure_gamma_heatmap", "select grp, rank, k, round(avg(p), 6) + 0.0 as p from rk join effects using (i, d) group by all", RANKS)(lambda p: (x := figures.gamma_heatmap(p.effects, _sizes(p), p.truth)).select(*longs(x, "grp", "rank", "k"), *r6("p")))
on_posterior("rank_gamma_by_size", "select i, rank, k, round(p, 6) + 0.0 as p from rk join effects using (i, d)", RANKS)(lambda p: (x := figures.ranked_gamma(p.effects, _sizes(p))).select("i", *longs(x, "rank", "k"), *r6("p")))
on_posterior("figure_factor_ids", "select grp, rank, top_factor, count(*) as n from rk group by all", RANKS)(lambda p: (x := figures.factor_ids(_sizes(p), p.truth)).select(*longs(x, "grp", "rank", "top_factor"), "n"))
on_posterior("figure_representative", "select grp, arg_min(i, (gap, i)) as i from (select i, grp, round(abs(size - avg(size) over (partition by grp)), 9) as gap from rk where rank = 1) group by grp", RANKS)(lambda p: (x := figures.representative(_sizes(p), p.truth)).select(*longs(x, "grp"), "i"))
CELLS = LABELS + ", rc as (select i, unnest(string_split(label, ','))::int as k, true as recovered from lab), ex as (select i, unnest(string_split(label, ','))::int as k, true as expected from truth)\n"
on_posterior("figure_support_cells", "select i, grp, k, coalesce(recovered, false) as recovered, coalesce(expected, false) as expected from rc full join ex using (i, k) join truth using (i)", CELLS)(lambda p: (x := figures.support_cells(S.support_labels(S.loading_scores(p.effects), p.truth), p.truth)).select("i", *longs(x, "grp"), "k", "recovered", "expected"))
on_posterior("figure_competing_shares", "select grp, true_k, k, round(avg(share), 6) + 0.0 as share from sh join truth using (i) group by all", SHARES)(lambda p: (x := figures.competing_diagnostics(S.loading_scores(p.effects), _members(p), p.truth)).select(*longs(x, "grp", "true_k", "k"), *r6("share")))
query("run_boundaries", "select c_mktsegment, run, c_nationkey, min(c_custkey) as first, max(c_custkey) as last, count(*) as n from (select *, (sum(is_new) over (partition by c_mktsegment order by c_custkey))::bigint as run from (select *, case when c_nationkey = lag(c_nationkey) over (partition by c_mktsegment order by c_custkey) then 0 else 1 end as is_new from customer)) group by all")(lambda s, d: figures.run_boundaries(table(s, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey", "c_nationkey", "c_mktsegment"))


def _tiny(spark: SparkSession) -> simulate.Simulated:
    return simulate.block(spark, 80, 60, 101)


QUICK = {"mf_max_iters": 3, "mf_nmf_iters": 5}
query("soft_pair")(lambda s, d: studies.compare(studies.soft_pair(_tiny(s), 5, 8, 3, 1, 2, 1, **QUICK), _tiny(s)))
query("hard_pair")(lambda s, d: studies.compare(studies.hard_pair(_tiny(s), 5, 8, 3, 1, 2, 2, **QUICK), _tiny(s)))
query("oracle_hard_motifs")(lambda s, d: studies.summary(studies.oracle_hard(_tiny(s), 3, 4, 4), _tiny(s), "oracle"))
query("over_dictionary_splits")(lambda s, d: studies.over_dictionary(s, (1,), 80, 60, 3, 5))
query("correlated_pair_splits")(lambda s, d: studies.correlated_pair(s, (1,), 60, 60, 3, 5))
