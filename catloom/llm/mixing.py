"""Mixing to target weights: domain posteriors of a labelled classifier, then rates by projected gradient. Native only."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from catloom.llm.common import SPACE, drop_rows, row_key, stored, text_of

#: Domains of the labels: toxic texts, texts of low quality, and the rest.
DOMAINS = ("clean", "toxic", "low")
#: Shares of expected tokens after mixing. The first domain keeps all of its own.
TARGETS = {"clean": 0.97, "toxic": 0.02, "low": 0.01}


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, F.lit("toxic")).when(quality == 0, F.lit("low")).when(quality == 1, F.lit("clean"))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SPACE), "")


def _shape(text: Column, words: Column, distinct: Column) -> Column:
    """A few tokens for the look of a text; a blank in front keeps them apart from words."""
    size = F.greatest(F.length(text), F.lit(1))
    share = lambda chars: F.floor(10 * (size - F.length(F.translate(text, chars, ""))) / size)
    unique = F.floor(10 * F.size(distinct) / F.greatest(F.size(words), F.lit(1)))
    upper = "".join(chr(c) for c in range(65, 91))
    return F.array(
        F.concat(F.lit(" symbols "), share("#*$%&|<>!").cast("string")),
        F.concat(F.lit(" capitals "), share(upper).cast("string")),
        F.concat(F.lit(" distinct "), unique.cast("string")),
    )


def tokens_of(docs: DataFrame, text: str) -> DataFrame:
    """Add _n (words of the whole text) and _tokens (its distinct words and shape)."""
    df = docs.withColumn("_t", text_of(text)).withColumn("_w", _words(F.col("_t")))
    df = df.withColumn("_d", F.array_distinct("_w"))
    tokens = F.concat("_d", _shape(F.col("_t"), F.col("_w"), F.col("_d")))
    return df.withColumn("_n", F.size("_w").cast("long")).withColumn("_tokens", tokens).drop("_t", "_w", "_d")


def fit_domains(
    docs: DataFrame, labels: DataFrame, id: str, text: str, domains: Sequence[str], sample_rows: int, features: int,
) -> tuple[list[float], dict[str, list[float]]]:
    """(constant per domain, weights per token) of a multinomial logistic model over the most telling tokens.

    Fitted on at most ``sample_rows`` labelled rows, those with the smallest hash of their id; of their tokens
    the ``features`` with the largest log-likelihood ratio for each domain are used. With rows of fewer than two
    domains there is nothing to tell apart: the constants are the smoothed shares, and no token counts.
    """
    marked = labels.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("_lid")).agg(
        F.min("quality").alias("_q"), F.max("toxic").alias("_x"))
    marked = marked.withColumn("_domain", domain_of(F.col("_q"), F.col("_x"))).where("_domain is not null")
    chosen = stored(marked.orderBy(F.xxhash64(F.lit("mix"), F.col("_lid")), "_lid").limit(sample_rows).select("_lid", "_domain"))
    # At most sample_rows ids.
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).join(
        F.broadcast(chosen), F.col("_id") == F.col("_lid"))
    held = stored(tokens_of(rows.select("_domain", "_text"), "_text").select("_domain", "_tokens"))
    totals = {r["_domain"]: r["count"] for r in held.groupBy("_domain").count().collect()}
    sizes = [float(totals.get(d, 0)) for d in domains]
    everyone = sum(sizes)
    if sum(n > 0 for n in sizes) < 2:
        return [math.log((n + 1) / (everyone + len(domains))) for n in sizes], {}
    counts = held.select("_domain", F.explode("_tokens").alias("token")).groupBy("token").agg(
        *[F.sum((F.col("_domain") == d).cast("double")).alias(d) for d in domains])
    counts = stored(counts.withColumn("seen", sum((F.col(d) for d in domains), F.lit(0.0))).where("seen >= 5"))
    tokens: set[str] = set()
    for d, n in zip(domains, sizes, strict=True):
        score = _likelihood_ratio(F.col(d), F.col("seen"), n, everyone)
        tokens |= {r["token"] for r in counts.orderBy(F.desc(score), "token").limit(features).select("token").collect()}
    names = sorted(tokens)
    if not names:
        return [math.log((n + 1) / (everyone + len(domains))) for n in sizes], {}
    place = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("_domain")) - 1
    every = F.array(*[F.lit(t) for t in names])
    rows = stored(held.select(place.cast("double").alias("label"), F.array_intersect("_tokens", every).alias("_hits")))
    own = F.transform(every, lambda t: F.array_contains("_hits", t).cast("double"))
    model = LogisticRegression(maxIter=60, regParam=2e-4, family="multinomial").fit(
        rows.select("label", array_to_vector(own).alias("features")))
    matrix, constant = model.coefficientMatrix.toArray(), list(model.interceptVector)
    constant += [-50.0] * (len(domains) - len(constant))  # no row of the last domains was seen
    weights = {t: [float(row[i]) for row in matrix] + [0.0] * (len(domains) - len(matrix)) for i, t in enumerate(names)}
    return [float(c) for c in constant], weights


def _likelihood_ratio(hits: Column, seen: Column, size: float, everyone: float) -> Column:
    """Of the two-by-two table of a token against a domain."""

    def cell(x: Column, row: Column, column: float) -> Column:
        return F.when(x > 0, x * F.log(x * everyone / (row * column))).otherwise(0.0)

    missing, rest = everyone - seen, everyone - size
    return (cell(hits, seen, size) + cell(seen - hits, seen, rest)
            + cell(size - hits, missing, size) + cell(rest - seen + hits, missing, rest))


def _sum_of(hits: str, weights: Mapping[str, float], constant: float) -> Column:
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.aggregate(hits, F.lit(constant), lambda total, token: total + table[token])


def domain_posteriors(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", domains: Sequence[str] = DOMAINS,
    sample_rows: int = 20_000, features: int = 64,
) -> DataFrame:
    """(id, text_key, n_tokens, p_<domain> ...) of every whole text; the key is a hash of the text."""
    constant, weights = fit_domains(docs, labels, id, text, domains, sample_rows, features)
    rows = tokens_of(docs.select(F.col(id).alias("_id"), row_key(id, text)[1], F.col(text).alias("_text")), "_text")
    tokens = F.array(*[F.lit(t) for t in weights]) if weights else F.array().cast("array<string>")
    # At most 3 * features distinct tokens meet the table of weights.
    rows = rows.select("_id", "_h", "_n", F.array_intersect("_tokens", tokens).alias("_hits"))
    logs = {d: F.lit(constant[i]) for i, d in enumerate(domains)}
    if weights:
        logs = {d: _sum_of("_hits", {t: w[i] for t, w in weights.items()}, constant[i]) for i, d in enumerate(domains)}
    rows = rows.select("_id", "_h", "_n", *[c.alias(f"_l_{d}") for d, c in logs.items()])
    top = F.greatest(*[F.col(f"_l_{d}") for d in domains])
    rows = rows.withColumn("_top", top)
    total = sum((F.exp(F.col(f"_l_{d}") - F.col("_top")) for d in domains), F.lit(0.0))
    return rows.select(
        F.col("_id").alias(id), F.col("_h").alias("text_key"), F.col("_n").alias("n_tokens"),
        *[(F.exp(F.col(f"_l_{d}") - F.col("_top")) / total).alias(f"p_{d}") for d in domains],
    )


def _rate(steps: list[list[float]], columns: list[Column]) -> Column:
    """The rate after the given gradient steps from 1, each projected to the nonnegative numbers."""
    if not steps:
        return F.lit(1.0)
    table = F.array(*[F.array(*[F.lit(float(x)) for x in step]) for step in steps])

    def down(rate: Column, step: Column) -> Column:
        for place, column in enumerate(columns):
            rate = rate - column * step[place]
        return F.greatest(rate, F.lit(0.0))

    return F.aggregate(table, F.lit(1.0), down)


def fit_rates(
    table: DataFrame, domains: Sequence[str], targets: Mapping[str, float], upsample: bool = False, rounds: int = 40,
    tolerance: float = 1e-3,
) -> Column:
    """Nonnegative rates, as a column, so that sums of rate * n_tokens * p_domain come to the target totals.

    Least squares of the relative misses by projected gradient from rate 1, in the metric weighted by tokens.
    A step is known by one number per domain, so a round is one aggregate over ``table`` and any task can be run
    again; the targets' total is set so that the first domain keeps its expected tokens. Domains without tokens are left out.
    Unless ``upsample``, a domain that has less than its share keeps what it has: its few documents are not repeated.
    """
    shares = [F.col(f"p_{d}") for d in domains]
    amount = F.col("n_tokens").cast("double")
    sums = lambda rate: table.agg(*[F.coalesce(F.sum(rate * amount * p), F.lit(0.0)) for p in shares]).first()
    start = sums(F.lit(1.0))
    total = start[0] / targets[domains[0]]
    wanted = [targets[d] * total if upsample else min(targets[d] * total, s) for d, s in zip(domains, start, strict=True)]
    steps: list[list[float]] = []
    now = start
    for _ in range(rounds):
        miss = [(n - w) / s if s > 0 else 0.0 for n, w, s in zip(now, wanted, start, strict=True)]
        if max(map(abs, miss)) <= tolerance:
            break
        steps.append(miss)
        now = sums(_rate(steps, shares))
    return _rate(steps, shares)


def mix(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", domains: Sequence[str] = DOMAINS,
    targets: Mapping[str, float] = TARGETS, sample_rows: int = 20_000, features: int = 64, upsample: bool = False,
    seed: str = "mix",
) -> DataFrame:
    """Per row: id, text_key, n_tokens, p_<domain> ..., rate, copies.

    ``rate`` is the expected number of copies of the document in the mixture; ``copies`` rounds it without bias by a
    hash of the id. Null and empty texts have no tokens and take the prior's posteriors; a null id is a row like any other; labels of one id
    count as the worst of them; without labels all domains share every document alike. Repeated rows have equal results.
    """
    table = stored(domain_posteriors(docs, labels, id, text, domains, sample_rows, features))
    rate = fit_rates(table, domains, targets, upsample)
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col(id)), F.lit(1 << 32)) / float(1 << 32)
    out = table.withColumn("rate", rate)
    whole = F.floor("rate")
    return out.withColumn("copies", whole + (chance < F.col("rate") - whole).cast("long"))


def keep_mixture(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that get no copy; same columns. Nothing is repeated.

    Rows are told apart by id and text, so another text under the same id has a fate of its own; rows without id stay. An empty
    table gives an empty one; texts of any length and columns of any name are left as they are.
    """
    none = mix(docs, labels, id, text).where("copies = 0")
    return drop_rows(docs, none.select(F.col(id).cast("long").alias("_id"), F.col("text_key").alias("_h")), id, text)
