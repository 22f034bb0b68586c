"""Mixing to target weights with soft domain membership.

A Bernoulli naive Bayes over telling words, fitted on the labelled table, gives every document a posterior over domains. Rates
per document minimise the squared distance between expected domain token totals and their targets, by projected gradient steps:
one small aggregate per step, no document leaves its row. Column expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut_lineage, lower_ascii

# Target weights of the domains; the first one sets the scale: its expected tokens are kept as they are.
TARGETS = {"clean": 0.90, "low": 0.08, "toxic": 0.02}
# At most so many labelled rows are used for fitting, chosen by the hash of their id.
MAX_LABELLED = 200_000
BUCKETS = 1 << 16
MAX_FEATURES = 4096
MIN_SCORE, MIN_LIFT = 5.0, 3.0
STEPS, TOLERANCE = 30, 1e-6


def domain_of_labels() -> Column:
    return F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean")


@dataclass(frozen=True)
class Classifier:
    """Index of word buckets to features, log-odds per feature and domain, intercept per domain; at most MAX_FEATURES features."""

    domains: list[str]
    index: list[int]
    weights: list[list[float]]
    intercept: list[float]

    def posteriors(self, text: Column) -> Column:
        """Array of the posterior of every domain; texts without telling words get what the intercepts say."""
        index = F.split(F.lit(",".join(map(str, self.index))), ",").cast("array<int>")
        found = F.array_distinct(F.filter(F.transform(
            F.split(lower_ascii(text), SPACE),
            lambda w: F.element_at(index, F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int") + 1)), lambda x: x > 0))
        def total(features: Column, d: int) -> Column:
            weights = F.split(F.lit(",".join(repr(w[d]) for w in self.weights) or "0"), ",").cast("array<double>")
            return F.aggregate(features, F.lit(self.intercept[d]), lambda a, x: a + F.element_at(weights, x))

        hits = F.transform(F.array(F.struct(found.alias("f"))), lambda s: F.array(*[total(s.f, d) for d in range(len(self.domains))]))
        soft = F.transform(hits, lambda s: F.transform(s, lambda v: F.exp(v - F.array_max(s))))
        return F.element_at(F.transform(soft, lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, x: a + x))), 1)


def fit(docs: DataFrame, labels: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LABELLED) -> Classifier:
    """Fits on at most about ``limit`` labelled rows; rows whose label or text is null are left out.

    A word tells a domain if its log-odds against the rest lie MIN_SCORE standard errors above zero and it is MIN_LIFT times
    as frequent there; the MAX_FEATURES most certain ones are used.
    """
    marked = labels.select(F.col("doc_id").alias("_id"), domain_of_labels().alias("domain")).filter("_id is not null AND domain is not null")
    n = marked.count()
    if n > limit:
        marked = marked.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * limit / n))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).filter("_t is not null").join(F.broadcast(marked), "_id")
    buckets = F.array_distinct(F.transform(F.split(lower_ascii(F.col("_t")), SPACE), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))
    rows = texts.select("domain", F.explode(F.array_append(buckets, F.lit(-1))).alias("bucket"))  # -1 counts documents
    counts = rows.groupBy("bucket").agg(*[F.sum((F.col("domain") == d).cast("long")).alias(f"n{i}") for i, d in enumerate(domains)])
    table = counts.filter("bucket >= -1").toPandas().sort_values("bucket")  # at most BUCKETS + 1 rows
    cols = [f"n{i}" for i in range(len(domains))]
    total = table.loc[table["bucket"] == -1, cols].to_numpy(float)
    total = total[0] if len(total) else np.zeros(len(domains))
    table = table[table["bucket"] >= 0]
    own = table[cols].to_numpy(float).reshape(-1, len(domains))
    rest = own.sum(axis=1, keepdims=True) - own
    out = total.sum() - total
    a, b, c, d = own + 0.5, total - own + 0.5, rest + 0.5, out - rest + 0.5
    score = (np.log(a / b) - np.log(c / d)) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    lift = (a / (total + 1)) / (c / (out + 1))
    best = np.where((score >= MIN_SCORE) & (lift >= MIN_LIFT), score, 0).max(axis=1) if len(own) else np.zeros(0)
    chosen = np.argsort(-best, kind="stable")[:MAX_FEATURES]
    chosen = chosen[best[chosen] > 0]
    index = [0] * BUCKETS
    for k, i in enumerate(chosen):
        index[int(table["bucket"].iloc[i])] = k + 1
    p = (own[chosen] + 0.5) / (total + 1) if len(chosen) else np.zeros((0, len(domains)))
    prior = np.log((total + 1) / (total.sum() + len(domains)))
    return Classifier(domains, index, np.log(p / (1 - p)).tolist(), (prior + np.log(1 - p).sum(axis=0)).tolist())


def _members(docs: DataFrame, model: Classifier, text_col: str) -> DataFrame:
    """Adds _n (words) and _p (posteriors)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.withColumn("_n", F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("double")).withColumn("_p", model.posteriors(text))


def _rate(steps: list[list[float]]) -> Column:
    """Rate after the given steps, from the posteriors alone."""
    rate = F.lit(1.0)
    for step in steps:
        rate = F.greatest(F.lit(0.0), rate - sum((F.element_at("_p", d + 1) * F.lit(x) for d, x in enumerate(step)), F.lit(0.0)))
    return rate


def solve(members: DataFrame, weights: list[float], steps: int = STEPS, tolerance: float = TOLERANCE) -> list[list[float]]:
    """Projected gradient steps for the rates; ``members`` has _n and _p and is read once per step.

    With G = sum of n p p', the squared residual weighted by the inverse of G has a gradient of Lipschitz constant one in the
    metric of the token counts, so steps of length one descend; the projection on rates of zero or more is a plain cut.
    """
    k = len(weights)
    parts = [F.sum(F.col("_n") * F.element_at("_p", i + 1)).alias(f"s{i}") for i in range(k)]
    parts += [F.sum(F.col("_n") * F.element_at("_p", i + 1) * F.element_at("_p", j + 1)).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    first = members.agg(*parts).first().asDict()
    now = np.array([first[f"s{i}"] or 0.0 for i in range(k)])
    gram = np.array([[first[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    share = np.array(weights) / sum(weights)
    target = share * (now[0] / share[0] if share[0] > 0 and now[0] > 0 else now.sum())
    inverse = np.linalg.pinv(gram, rcond=1e-9, hermitian=True)
    done: list[list[float]] = []
    for _ in range(steps):
        if np.abs(now - target).max(initial=0) <= tolerance * max(target.sum(), 1.0):
            break
        step = inverse @ (now - target)
        if not np.isfinite(step).all() or np.abs(step).max(initial=0) < 1e-12:
            break
        done.append([float(f"{x:.12g}") for x in step])
        r = _rate(done)
        row = members.select("_n", "_p", r.alias("_r")).agg(*[F.sum(F.col("_n") * F.col("_r") * F.element_at("_p", i + 1)) for i in range(k)]).first()
        now = np.array([x or 0.0 for x in row])
    return done


def _copies(rate: Column, key: Column) -> Column:
    """Rate rounded down or up to whole copies, up with the probability of its fraction, decided by the hash of the id."""
    return F.floor(F.round(rate, 9) + F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 20)) / float(1 << 20)).cast("long")


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: doc_id, n_tokens, p_<domain> for every domain, rate, copies.

    Null or empty texts have no tokens and do not influence the totals. Null ids and repeated rows are worked on one by one.
    Without labels all posteriors are alike and one rate results. Extra columns are not read; an empty table gives no rows.
    """
    targets = targets or TARGETS
    model = fit(docs, labels, list(targets), id_col, text_col, **how)
    members = cut_lineage(_members(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model, "text").drop("text"))
    rate = _rate(solve(members, list(targets.values())))
    out = members.withColumn("_r", rate)
    return out.select("doc_id", F.col("_n").cast("long").alias("n_tokens"),
                      *[F.round(F.element_at("_p", i + 1), 6).alias(f"p_{d}") for i, d in enumerate(targets)],
                      F.round("_r", 6).alias("rate"), _copies(F.col("_r"), F.col("doc_id")).alias("copies"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says, all columns unchanged; nothing is joined or shuffled."""
    targets = targets or TARGETS
    model = fit(docs, labels, list(targets), id_col, text_col, **how)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    found = _members(row.withColumn("_text", F.col(f"_row.`{text_col}`")), model, "_text")
    steps = solve(cut_lineage(found.select("_n", "_p")), list(targets.values()))
    # the row number keeps the condition above the projection; pushed below, the posteriors would be worked out twice
    found = found.select("_row", _copies(_rate(steps), F.col(f"_row.`{id_col}`")).alias("_c"), F.monotonically_increasing_id().alias("_no"))
    return found.filter("_c > 0 AND _no >= 0").select("_row", F.explode(F.expr("sequence(1L, _c)"))).select("_row.*")
