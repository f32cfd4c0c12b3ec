"""Mixing to target weights with soft domain membership.

A naive Bayes classifier over words and shape marks, fitted on a labelled table, gives
each document a posterior for each domain. Projected-gradient least squares then fits
a nonnegative rate for each document (its expected copies), so that the expected
tokens of each domain, rate * tokens * posterior summed over documents, match the
targets.

Only DataFrame functions: the gradient of a round is one aggregate of as many sums as
there are domains, and a document's rate is a fold over the rounds' gradients.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citygrid.lineage import cut
from citygrid.llm.common import min_rounds

ABSENT = -1e9  # prior logit of a domain without documents where others have some


@dataclass(frozen=True)
class Settings:
    rows: int = 4000  # labelled documents used for fitting
    words: int = 5000  # words that the classifier knows
    least: int = 3  # documents that must have a word
    clear: float = 4.0  # standard deviations by which a word's count in a domain must differ
    sharpness: float = 0.5  # of the posteriors: evidence is scaled by this
    rounds: int = 40
    tolerance: float = 1e-6  # of the largest target


def label_domains(labels: DataFrame) -> DataFrame:
    """labels(doc_id, quality, toxic) -> (id, domain): toxic, else poor or good by quality."""
    return labels.select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").otherwise("good").alias("domain"))


def marks(text: Column) -> Column:
    """Shape marks of a text: symbols, capitals, bars, digits and repeats, in steps."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda pattern: F.floor(F.log2(1 + 200 * F.length(F.regexp_replace(text, pattern, "")) / n)).cast("string")
    return F.array(
        F.concat(F.lit("\u0001symbols"), share(r"[^#$%&*!|]+")), F.concat(F.lit("\u0001capitals"), share(r"[^\p{Lu}]+")), F.concat(F.lit("\u0001digits"), share(r"[^0-9]+")),
    )


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def terms(docs: DataFrame) -> DataFrame:
    """(id, n_tokens, term): distinct words and marks of each document, and a mark for its repeats."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select("id", text.alias("text")).withColumn("words", tokens(F.col("text")))
    words = words.select("id", F.size("words").cast("long").alias("n_tokens"), F.array_distinct("words").alias("kinds"), marks(F.col("text")).alias("marks"))
    again = F.concat(F.lit("\u0001distinct"), F.floor(F.log2(1 + 20 * F.size("kinds") / F.greatest("n_tokens", F.lit(1)))).cast("string"))
    return words.select("id", "n_tokens", F.explode(F.concat("kinds", "marks", F.array(again))).alias("term"))


def fit_terms(docs: DataFrame, labelled: DataFrame, domains: list[str], s: Settings) -> tuple[DataFrame, dict[str, float]]:
    """-> (term, one log-odds column per domain) of at most ``s.words`` terms, and prior logits.

    ``labelled``: (id, domain). The documents used are those of ``docs`` whose id hashes
    least; labels of other documents count for nothing.
    """
    known = labelled.filter(F.col("domain").isin(domains) & F.col("id").isNotNull()).groupBy("id").agg(F.min("domain").alias("domain"))
    picked = cut(min_rounds(known.join(docs.select("id"), "id", "left_semi"), "id", s.rows))
    present = docs.join(F.broadcast(picked.select("id")), "id", "left_semi")  # at most s.rows ids
    sizes = {r["domain"]: r["count"] for r in present.select("id").join(F.broadcast(picked), "id").groupBy("domain").count().collect()}
    chosen = terms(present).join(F.broadcast(picked), "id")
    total = sum(sizes.values())
    held = [F.count_if(F.col("domain") == d).alias(f"has{k}") for k, d in enumerate(domains)]
    counted = chosen.select("id", "term", "domain").groupBy("term").agg(F.count("*").alias("df"), *held).filter(F.col("df") >= s.least)
    odds, apart = [], []
    for k, d in enumerate(domains):
        own, n = F.col(f"has{k}"), sizes.get(d, 0)
        odds.append(F.log((own + 0.5) / (n + 1)) - F.log((F.col("df") - own + 0.5) / (total - n + 1)))
        share = n / total if total else 0.0
        apart.append(F.abs(own - F.col("df") * share) / F.sqrt(F.col("df") * max(share * (1 - share), 1e-9)))
    # terms that chance does not explain, clearest first
    model = counted.select("term", *[o.alias(f"w{k}") for k, o in enumerate(odds)], F.greatest(F.lit(0.0), *apart).alias("apart")).filter(F.col("apart") >= s.clear).orderBy(F.desc("apart"), "term").limit(s.words).drop("apart")
    prior = {d: math.log((sizes.get(d, 0) + 0.5) / (total - sizes.get(d, 0) + 0.5)) for d in domains}
    # rare words would speak for a domain of which no document is there
    return cut(model), {d: x if sizes.get(d) or not total else ABSENT for d, x in prior.items()}


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], s: Settings) -> DataFrame:
    """-> id, n_tokens, p (array, one posterior per domain, summing to 1); a row per row of ``docs``.

    ``docs``: (id, text). Evidence is summed per document before anything is shuffled.
    """
    model, prior = fit_terms(docs, labelled, domains, s)
    row = F.struct(F.monotonically_increasing_id().alias("row"), F.col("id"))
    found = terms(docs.select(row.alias("id"), "text")).join(F.broadcast(model), "term", "left")  # at most s.words rows
    summed = found.groupBy("id").agg(F.max("n_tokens").alias("n_tokens"), *[F.sum(f"w{k}").alias(f"w{k}") for k in range(len(domains))])
    logits = F.array(*[s.sharpness * (F.coalesce(F.col(f"w{k}"), F.lit(0.0)) + F.lit(prior[d])) for k, d in enumerate(domains)])
    soft = F.transform("logits", lambda x: F.exp(x - F.array_max("logits")))
    return (
        summed.select("id.id", "n_tokens", logits.alias("logits")).select("id", "n_tokens", soft.alias("soft"))
        .select("id", "n_tokens", F.transform("soft", lambda x: x / F.aggregate("soft", F.lit(0.0), lambda a, b: a + b)).alias("p"))
    )


def rate_of(gradients: list[list[float]], top: float | None) -> Column:
    """A document's rate after the rounds' steps from 1; each step goes back into [0, top]."""
    rate = F.lit(1.0)
    if gradients:
        steps = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in gradients])

        def step(r: Column, g: Column) -> Column:
            moved = r - sum((g[k] * F.col("p")[k] for k in range(len(gradients[0]))), F.lit(0.0))
            return F.greatest(F.lit(0.0), moved if top is None else F.least(F.lit(float(top)), moved))

        rate = F.aggregate(steps, rate, step)
    return rate


def fit_rates(held: DataFrame, targets: dict[str, float], s: Settings = Settings(), top: float | None = None) -> list[list[float]]:
    """``held`` (id, n_tokens, p) -> the gradients of the rounds.

    Least squares over domains, each residual over the domain's tokens; steps are taken
    in the metric of the documents' tokens, so a rate moves by the same whatever a
    document's length. ``targets``: tokens for each domain.
    """
    names = list(targets)
    p = lambda k: F.col("p")[k]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    now = held.agg(*[F.sum(F.col("n_tokens") * p(k)).alias(f"m{k}") for k in range(len(names))], *[F.sum(F.col("n_tokens") * p(i) * p(j)).alias(f"c{i}_{j}") for i, j in pairs]).first()
    mass = [max(now[f"m{k}"] or 0.0, 1.0) for k in range(len(names))]
    # a step of 1/L, L bounded by the largest row sum of the scaled moments
    moment = {(i, j): (now[f"c{min(i, j)}_{max(i, j)}"] or 0.0) for i in range(len(names)) for j in range(len(names))}
    bound = max(sum(moment[i, j] / (mass[i] * mass[j]) ** 0.5 for j in range(len(names))) for i in range(len(names)))
    eta = 1 / max(bound, 1e-9)
    gradients: list[list[float]] = []
    limit = s.tolerance * max(map(abs, targets.values()), default=0.0)
    last = None
    for _ in range(s.rounds):
        rate = rate_of(gradients, top)
        sums = held.select("n_tokens", "p", rate.alias("rate")).agg(*[F.sum(F.col("rate") * F.col("n_tokens") * p(k)).alias(f"t{k}") for k in range(len(names))]).first()
        apart = [(sums[f"t{k}"] or 0.0) - targets[d] for k, d in enumerate(names)]
        if max(map(abs, apart), default=0.0) <= limit or last is not None and max(abs(a - b) for a, b in zip(apart, last)) <= limit * 0.01:
            break
        last = apart
        gradients.append([eta * a / mass[k] for k, a in enumerate(apart)])
    return gradients


def mix_documents(
    docs: DataFrame, labelled: DataFrame, weights: dict[str, float], s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", top: float | None = None, absolute: bool = False
) -> DataFrame:
    """-> id, n_tokens, domain (likeliest), one ``p_<domain>`` each, rate, copies.

    ``labelled``: (id, domain) rows; documents without a label get posteriors like all
    others. ``weights``: the share of the tokens each domain should have (with
    ``absolute``, times its present expected tokens). ``copies`` is the rate rounded up
    with the chance of its fraction, by a hash of the id. Null and empty texts have no
    tokens; null ids are kept; long texts count whole. A row per row of ``docs``, none
    for an empty table; other columns are ignored.
    ``top`` bounds the rates from above (1: choose without repeating).
    """
    names = sorted(weights)
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = labelled.select(F.col("id").cast("long").alias("id"), F.col("domain").cast("string").alias("domain"))
    held = cut(posteriors(given, known, names, s))
    sums = held.agg(F.sum("n_tokens").alias("all"), *[F.sum(F.col("n_tokens") * F.col("p")[k]).alias(f"m{k}") for k in range(len(names))]).first()
    share = sum(weights.values())
    targets = {d: weights[d] * (sums[f"m{k}"] or 0.0) if absolute else weights[d] / share * (sums["all"] or 0) for k, d in enumerate(names)}
    rate = rate_of(fit_rates(held, targets, s, top), top)
    likeliest = F.array(*[F.lit(d) for d in names])[F.array_position("p", F.array_max("p")).cast("int") - 1]
    chance = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return held.select("id", "n_tokens", likeliest.alias("domain"), *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(names)], rate.alias("rate")).select(
        F.col("id").alias(id_col), "n_tokens", "domain", *[f"p_{d}" for d in names], "rate",
        (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int").alias("copies"),
    )


def apply_copies(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with each row as often as its document's copies say; columns as given.

    Rows whose id is null or not in ``mixed`` stay once. Names of columns are free: the
    row travels as one value.
    """
    times = mixed.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("of")).agg(F.max("copies").alias("copies"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"))
    joined = rows.join(times, rows["id"] == times["of"], "left").select("row", F.coalesce("copies", F.lit(1)).alias("copies"))
    return joined.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
