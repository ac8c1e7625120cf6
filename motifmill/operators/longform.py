"""Single update steps in long form: one row for each tensor cell, joins on shared indices, sums by group.

counts(i, m, y > 0), factors(k, m, f), motif(s, d, k, p), alpha(i, s, d, a), omega(i, s, w), priors and rates (s, d, ..), each complete in s, d and k. A
sample's slots are packed into one row that meets its cells by i, so cells are shuffled once and unfold into shares where they are; features' rows
are written, so Spark broadcasts them by their size; rows of slots are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import EPS, share_over, softmax_over
from ..functions.special import digamma, lgamma
from ..plans.written import write


def rate(counts: DataFrame, loadings: DataFrame, factors: DataFrame) -> DataFrame:
    """i, m, y, rate = sum of l * f over k, at the positive cells."""
    return counts.join(factors, "m").join(loadings, ["i", "k"]).groupBy("i", "m", "y").agg(F.sum(F.col("l") * F.col("f")).alias("rate"))


def pooled(counts: DataFrame, omega: DataFrame) -> DataFrame:
    """s, m, y: counts weighted by responsibility."""
    return counts.join(omega, "i").groupBy("s", "m").agg(F.sum(F.col("w") * F.col("y")).alias("y"))


def factor_sums(factors: DataFrame) -> DataFrame:
    return factors.groupBy("k").agg(F.sum("f").alias("f_sum"))


def slot_factors(motif: DataFrame, factors: DataFrame) -> DataFrame:
    """s, d, m, elf: expected log factor of a slot."""
    return motif.join(factors, "k").groupBy("s", "d", "m").agg(F.sum(F.col("p") * F.ln(F.greatest("f", F.lit(EPS)))).alias("elf"))


def slot_rates(motif: DataFrame, factors: DataFrame, priors: DataFrame) -> DataFrame:
    """s, d, exposure, rate = lambda0 + scale * exposure."""
    e = motif.join(factor_sums(factors), "k").groupBy("s", "d").agg(F.sum(F.col("p") * F.col("f_sum")).alias("exposure"))
    return e.join(priors, ["s", "d"]).withColumn("rate", F.col("lambda0") + F.col("slot_scale") * F.col("exposure"))


def _packed(df: DataFrame, keys: list[str], columns: list[str | Column], name: str) -> DataFrame:
    """keys, name: a sorted array of structs of the columns."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))


def _unfolded(cells: DataFrame, keys: list[str], slots: Column, *columns: str) -> DataFrame:
    """keys, columns, xi: a row for each of the slots (structs with score), with the softmax of the scores."""
    scored = cells.select(*keys, slots.alias("slots")).select(*keys, "slots", F.array_max(F.transform("slots", lambda x: x["score"])).alias("top"))
    shifted = scored.select(*keys, F.transform("slots", lambda x: F.struct(*(x[c].alias(c) for c in columns), F.exp(x["score"] - F.col("top")).alias("e"))).alias("slots"))
    total = shifted.select(*keys, "slots", F.aggregate("slots", F.lit(0.0), lambda a, x: a + x["e"]).alias("z"))
    return total.select(*keys, "z", F.inline("slots")).select(*keys, *columns, (F.col("e") / F.col("z")).alias("xi"))


def slot_shares(counts: DataFrame, alpha: DataFrame, elf: DataFrame, rates: DataFrame, omega: DataFrame | None = None) -> DataFrame:
    """i, s, d, m, y, elf, mean_log, xi; with omega also w, the responsibility of s."""
    a = alpha.join(F.broadcast(rates), ["s", "d"]).withColumn("mean_log", digamma(F.col("a")) - F.ln("rate"))
    level = F.ln(F.greatest("slot_scale", F.lit(EPS))).alias("level")
    samples = _packed(_packed(a, ["i", "s"], ["d", "mean_log", level], "ds"), ["i"], ["s", "ds"], "components")
    keys = ["i", "s", "m", "y"]
    if omega is not None:
        weights = omega.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("s", "w"))).alias("ws"))
        samples = samples.join(weights, "i")
        keys.append("w")
    cells = counts.join(samples, "i")
    cells = cells.select("i", "m", "y", *(["ws"] if omega is not None else []), F.inline("components"))
    if omega is not None:
        cells = cells.withColumn("w", F.col("ws")[F.col("s")])
    features, _ = write(_packed(elf, ["m", "s"], ["d", "elf"], "es"), "slot-factors")
    score = lambda x, e: F.struct(x["d"].alias("d"), e["elf"].alias("elf"), x["mean_log"].alias("mean_log"), (x["level"] + x["mean_log"] + e["elf"]).alias("score"))
    shares = _unfolded(cells.join(features, ["m", "s"]), keys, F.zip_with("ds", "es", score), "d", "elf", "mean_log")
    return shares.select("i", "s", "d", "m", "y", "elf", "mean_log", "xi", *keys[4:])


def beta_counts(shares: DataFrame) -> DataFrame:
    return shares.groupBy("i", "s", "d").agg(F.sum(F.col("xi") * F.col("y")).alias("beta_count"))


def expected_counts(shares: DataFrame, omega: DataFrame | None = None) -> DataFrame:
    """s, d, m, c. Without omega shares have w already, which needs no shuffle of them."""
    weighted = shares if omega is None else shares.join(omega, ["i", "s"])
    return weighted.groupBy("s", "d", "m").agg(F.sum(F.col("w") * F.col("xi") * F.col("y")).alias("c"))


def gamma_divergence(df: DataFrame, a: str, rate: str, a0: str, rate0: str) -> Column:
    x, l, x0, l0 = (F.col(c) for c in (a, rate, a0, rate0))  # noqa: E741
    return (x - x0) * digamma(x) + x0 * (F.ln(l) - F.ln(l0)) - lgamma(x) + lgamma(x0) - (l - l0) * x / l


def component_elbo(shares: DataFrame, alpha: DataFrame, rates: DataFrame) -> DataFrame:
    """i, s, elbo of each sample under each component; samples without counts have the prior part alone."""
    got = F.col("xi") * F.col("y")
    data = shares.groupBy("i", "s").agg(F.sum(got * (F.col("mean_log") + F.col("elf")) - F.col("y") * F.col("xi") * F.ln(F.greatest("xi", F.lit(EPS)))).alias("data"))
    slots = alpha.join(F.broadcast(rates), ["s", "d"])
    cost = F.col("a") / F.col("rate") * F.col("slot_scale") * F.col("exposure") + gamma_divergence(slots, "a", "rate", "alpha0", "lambda0")
    prior = slots.groupBy("i", "s").agg(F.sum(cost).alias("cost"))
    return prior.join(data, ["i", "s"], "left").select("i", "s", (F.coalesce("data", F.lit(0.0)) - F.col("cost")).alias("elbo"))


def responsibilities(elbo: DataFrame, pi: DataFrame) -> DataFrame:
    """i, s, w."""
    scored = elbo.join(pi, "s").withColumn("score", F.col("elbo") + F.ln(F.greatest("pi", F.lit(EPS))))
    return softmax_over(scored, ["i"], "score", "w").select("i", "s", "w")


def mixture_weights(omega: DataFrame) -> DataFrame:
    """s, pi: clamped means, normalised."""
    means = omega.groupBy("s").agg(F.greatest(F.avg("w"), F.lit(EPS)).alias("m"))
    total = means.agg(F.sum("m").alias("t"))
    return means.crossJoin(F.broadcast(total)).select("s", (F.col("m") / F.col("t")).alias("pi"))  # t is one row


def prior_moments(alpha: DataFrame, omega: DataFrame, rates: DataFrame) -> DataFrame:
    """s, d, weight, mean, mean_log: responsibility-weighted moments of the loadings."""
    rows = alpha.join(omega, ["i", "s"]).join(F.broadcast(rates), ["s", "d"])
    b, lb = F.col("a") / F.col("rate"), digamma(F.col("a")) - F.ln("rate")
    sums = rows.groupBy("s", "d").agg(F.sum("w").alias("weight"), F.sum(F.col("w") * b).alias("b"), F.sum(F.col("w") * lb).alias("lb"))
    return sums.where(F.col("weight") > EPS).select("s", "d", "weight", (F.col("b") / F.col("weight")).alias("mean"), (F.col("lb") / F.col("weight")).alias("mean_log"))


def soft_gamma_step(c: DataFrame, factors: DataFrame, motif: DataFrame, moments: DataFrame, step: float) -> DataFrame:
    """s, d, k, p: damped softmax of the motif scores under a flat prior over k."""
    fit = c.join(factors, "m").groupBy("s", "d", "k").agg(F.sum(F.col("c") * F.ln(F.greatest("f", F.lit(EPS)))).alias("fit"))
    cost = moments.select("s", "d", (F.col("weight") * F.col("mean")).alias("mass"))
    scored = motif.join(fit, ["s", "d", "k"]).join(cost, ["s", "d"]).join(factor_sums(factors), "k").withColumn("score", F.col("fit") - F.col("mass") * F.col("f_sum"))
    new = softmax_over(scored, ["s", "d"], "score", "q").withColumn("q", (1 - step) * F.col("p") + step * F.col("q"))
    return share_over(new, ["s", "d"], "q", "p_new", EPS).select("s", "d", "k", F.col("p_new").alias("p"))


def slot_scale_step(c: DataFrame, moments: DataFrame, rates: DataFrame, step: float, low: float = 1e-3, high: float = 1e3) -> DataFrame:
    """s, d, slot_scale: damped, divided by the component's mean, then clamped."""
    counted = c.groupBy("s", "d").agg(F.sum("c").alias("c"))
    x = counted.join(moments, ["s", "d"]).join(rates, ["s", "d"])
    raw = x.withColumn("raw", (1 - step) * F.col("slot_scale") + step * F.col("c") / F.greatest(F.col("weight") * F.col("mean") * F.col("exposure"), F.lit(EPS)))
    means = raw.groupBy("s").agg(F.greatest(F.avg("raw"), F.lit(EPS)).alias("level"))
    scaled = raw.join(means, "s")
    return scaled.select("s", "d", F.least(F.greatest(F.col("raw") / F.col("level"), F.lit(low)), F.lit(high)).alias("slot_scale"))


def factor_step(c: DataFrame, motif: DataFrame, factors: DataFrame, step: float, pseudocount: float) -> DataFrame:
    """k, m, f: damped, with every feature present."""
    a = c.join(motif, ["s", "d"]).groupBy("k", "m").agg(F.sum(F.col("p") * F.col("c")).alias("a"))
    full = factors.join(a, ["k", "m"], "left").withColumn("a", F.coalesce("a", F.lit(0.0)) + pseudocount)
    new = share_over(full, ["k"], "a", "g", EPS).withColumn("h", (1 - step) * F.col("f") + step * F.col("g"))
    return share_over(new, ["k"], "h", "f_new", EPS).select("k", "m", F.col("f_new").alias("f"))


def effect_shares(counts: DataFrame, effects: DataFrame, factors: DataFrame) -> DataFrame:
    """i, d, m, y, xi for per-sample effects (i, d, k, p, alpha, lambda)."""
    mean_log = F.sum(F.col("p") * (digamma(F.col("alpha")) - F.ln("lambda"))).alias("mean_log")
    each = effects.groupBy("i", "d").agg(mean_log, F.sort_array(F.collect_list(F.struct("k", "p"))).alias("ks"))
    features, _ = write(_packed(factors, ["m"], ["k", F.ln("f").alias("lf")], "fs"), "log-factors")
    cells = counts.join(_packed(each, ["i"], ["d", "mean_log", "ks"], "ds"), "i").join(features, "m")
    elf = lambda x: F.aggregate(F.zip_with(x["ks"], F.col("fs"), lambda a, b: a["p"] * b["lf"]), F.lit(0.0), lambda t, v: t + v)
    slots = F.transform("ds", lambda x: F.struct(x["d"].alias("d"), (elf(x) + x["mean_log"]).alias("score")))
    return _unfolded(cells, ["i", "m", "y"], slots, "d").select("i", "d", "m", "y", "xi")


def effect_gamma(shares: DataFrame, factors: DataFrame, priors: DataFrame) -> DataFrame:
    """i, d, k, p: undamped distribution over factors of each effect, from given shares. priors: i, d, alpha0, lambda0."""
    features, _ = write(factors.select("k", "m", F.ln("f").alias("lf")), "log-factors")
    got = F.col("xi") * F.col("y")
    fit = shares.join(features, "m").groupBy("i", "d", "k").agg(F.sum(got * F.col("lf")).alias("fit"), F.sum(got).alias("n"))
    x = fit.join(priors, ["i", "d"]).join(F.broadcast(factor_sums(factors)), "k")
    scored = x.withColumn("score", F.col("fit") - (F.col("n") + F.col("alpha0")) * F.ln(F.col("lambda0") + F.col("f_sum")))
    return softmax_over(scored, ["i", "d"], "score", "p").select("i", "d", "k", "p")


def nmf_loading_step(counts: DataFrame, loadings: DataFrame, factors: DataFrame, eps: float = EPS) -> DataFrame:
    r = rate(counts, loadings, factors).withColumn("ratio", F.col("y") / (F.col("rate") + eps))
    up = r.join(factors, "m").groupBy("i", "k").agg(F.sum(F.col("ratio") * F.col("f")).alias("up"))
    x = loadings.join(up, ["i", "k"], "left").join(factor_sums(factors), "k")
    return x.select("i", "k", F.greatest(F.col("l") * F.coalesce("up", F.lit(0.0)) / F.col("f_sum"), F.lit(eps)).alias("l"))


def nmf_factor_step(counts: DataFrame, loadings: DataFrame, factors: DataFrame, eps: float = EPS) -> DataFrame:
    """k, m, f (rows sum to 1) and scale, by which loadings are to be multiplied."""
    r = rate(counts, loadings, factors).withColumn("ratio", F.col("y") / (F.col("rate") + eps))
    up = r.join(loadings, "i").groupBy("k", "m").agg(F.sum(F.col("l") * F.col("ratio")).alias("up"))
    total = loadings.groupBy("k").agg(F.sum("l").alias("l_sum"))
    raw = factors.join(up, ["k", "m"], "left").join(total, "k").select("k", "m", F.greatest(F.col("f") * F.coalesce("up", F.lit(0.0)) / F.col("l_sum"), F.lit(eps)).alias("f"))
    scale = raw.groupBy("k").agg(F.sum("f").alias("scale"))
    return raw.join(scale, "k").select("k", "m", (F.col("f") / F.col("scale")).alias("f"), "scale")


def deviance(counts: DataFrame, loadings: DataFrame, factors: DataFrame, eps: float = EPS) -> DataFrame:
    """deviance = sum of y ln(y / rate) - y + rate, over all cells (zero cells through the factor sums)."""
    r = rate(counts, loadings, factors)
    cells = r.agg(F.sum(F.col("y") * F.ln(F.col("y") / (F.col("rate") + eps)) - F.col("y")).alias("d"))
    level = loadings.join(factor_sums(factors), "k").agg(F.sum(F.col("l") * F.col("f_sum")).alias("r"))
    return cells.crossJoin(level).select((F.col("d") + F.col("r")).alias("deviance"))  # one row each


def merge_pairs(effects: DataFrame, K: int, tol: float) -> DataFrame:
    """i, d1, d2: pairs of active effects whose distributions are nearer than tol."""
    g = effects.groupBy("i", "d").agg(F.sort_array(F.collect_list(F.struct("k", "p"))).alias("g"))
    flat = F.sqrt(F.aggregate("g", F.lit(0.0), lambda a, x: a + (x["p"] - 1 / K) * (x["p"] - 1 / K)))
    g = g.where(flat > tol)
    a, b = g.select("i", F.col("d").alias("d1"), F.col("g").alias("a")), g.select("i", F.col("d").alias("d2"), F.col("g").alias("b"))
    near = F.sqrt(F.aggregate(F.zip_with("a", "b", lambda x, y: (x["p"] - y["p"]) * (x["p"] - y["p"])), F.lit(0.0), lambda s, v: s + v))
    return a.join(b, "i").where("d1 < d2").where(near < tol).select("i", "d1", "d2")




def merged(effects: DataFrame, K: int, D: int, tol: float, closest: bool = False) -> DataFrame:
    """i, d, k, p: effects of a sample whose distributions are nearer than tol become one, again and again until none are.

    Effects that start out within tol of uniform take no part. By slots, pairs go in their order, the mean goes to the first slot, and passes repeat (every
    pass but the last frees a slot, so D of them are enough); closest first, one pair at a time, and the mean goes to the later slot. The freed
    slot becomes uniform. A fold over each sample's own D x K numbers.
    """
    rows = effects.groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "k", "p"))), lambda x: x["p"]).alias("flat"))
    g = F.transform(F.sequence(F.lit(0), F.lit(D - 1)), lambda d: F.slice("flat", d * K + 1, F.lit(K)))
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    distance = lambda a, b: length(F.zip_with(a, b, lambda x, y: x - y))
    uniform = F.transform(F.sequence(F.lit(1), F.lit(K)), lambda _: F.lit(1.0 / K))
    rows = rows.select("i", g.alias("g")).withColumn("s", F.struct("g", F.transform("g", lambda v: distance(v, uniform) > tol).alias("active")))

    def joined(s: Column, keep: Column, free: Column, when: Column) -> Column:
        """State with slots keep and free (from 0) merged if ``when``."""
        mean = F.zip_with(F.get(s["g"], keep), F.get(s["g"], free), lambda x, y: (x + y) / 2)
        new_g = F.transform(s["g"], lambda v, d: F.when(d == keep, mean).when(d == free, uniform).otherwise(v))
        new_active = F.transform(s["active"], lambda a, d: a & (d != free))
        return F.when(when, F.struct(new_g.alias("g"), new_active.alias("active"))).otherwise(s)

    pairs = [(a, b) for a in range(D) for b in range(a + 1, D)]
    pair = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
    both_active = lambda s, p: F.get(s["active"], p["a"]) & F.get(s["active"], p["b"])
    apart = lambda s, p: distance(F.get(s["g"], p["a"]), F.get(s["g"], p["b"]))
    all_pairs = F.array(*(pair(a, b) for a, b in pairs))
    if not closest:
        steps = F.flatten(F.array_repeat(all_pairs, D))
        state = F.aggregate(steps, F.col("s"), lambda s, p: joined(s, p["a"], p["b"], both_active(s, p) & (apart(s, p) < tol)))
    else:
        far = F.lit(float("inf"))
        found = lambda s: F.array_min(F.transform(all_pairs, lambda p: F.struct(F.when(both_active(s, p), apart(s, p)).otherwise(far).alias("gap"), p["a"].alias("a"), p["b"].alias("b"))))
        one = lambda s: F.element_at(F.transform(F.array(found(s)), lambda m: joined(s, m["b"], m["a"], m["gap"] < tol)), 1)
        state = F.aggregate(F.sequence(F.lit(1), F.lit(D)), F.col("s"), lambda s, _: one(s))
    out = rows.select("i", F.posexplode(state["g"]).alias("d", "v")).select("i", (F.col("d") + 1).alias("d"), F.posexplode("v").alias("k", "p"))
    return out.select("i", "d", (F.col("k") + 1).alias("k"), "p")
