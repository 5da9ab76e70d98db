"""Mixing sources to target weights with soft domain membership.

1. A labelled table names the domain of some documents.  A softmax classifier over
   words and binned text statistics is fitted on a bounded, hash-chosen sample of
   them (``sample``) and gives every document a posterior over the domains.
2. Nonnegative rates x (expected copies per document) are fitted so that the
   expected tokens of domain d, sum_i x_i * tokens_i * p_id, meet the targets:
   least squares in the metric of the domains' mass matrix M, plus ``RIDGE`` times
   the token-weighted distance from one copy each, which makes the optimum unique.
   Every step is a projection of one copy moved against an accumulated gradient,
   x = max(least, 1 - p.g), so the rates are one expression over a narrow table.
   A step needs D + D^2 sums over the corpus; it is scaled by the mass matrix of
   the documents not at their bound, damped while it does not descend, and repeated
   until the optimality conditions hold to ``OPTIMALITY`` of all tokens.
3. Documents likeliest in a domain of ``whole`` are drawn once at least: their
   rates are projected onto x >= 1.  The total is ``headroom`` times the least at
   which those domains need no thinning, so the bound leaves room for the targets.
4. ``copies`` rounds the rate up or down by a hash of the id, with the right mean.

Null text counts as empty, null labels as no label, label rows without a document
as absent.  Repeated rows get the same result each; documents without words keep
the rate of their posterior and add no tokens.  Targets that the rates cannot meet
leave a residual, the largest difference of a domain's share of tokens from its
target, which is returned.  Columns named ``mix_rate`` or ``mix_copies`` in the
input of ``mix`` are replaced.  With an empty table the result is empty; without a labelled document every rate is 1 and
no domain is named.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import bounded_rows, bounded_share, chars_in, keyed, words_of

SAMPLE, FEATURES = 8000, 192
RIDGE, OPTIMALITY, MOST_STEPS = 1e-7, 1e-9, 500
TARGETS = {"good": 0.85, "poor": 0.13, "toxic": 0.02}
WHOLE = ("good", "poor")
HEADROOM = 1.25


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labels table: toxic, else by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain")).where("domain IS NOT NULL AND doc_id IS NOT NULL")


def with_features(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text_key, text) -> doc_id, text_key, n_tokens, features (distinct words and bins)."""
    rows = rows.select("doc_id", "text_key", "text", words_of(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "text_key", F.size("words").cast("long").alias("n_tokens"),
                       F.array_distinct("words").alias("distinct"),
                       F.greatest(F.length("text"), F.lit(1)).alias("chars"),
                       chars_in(F.col("text"), "[A-Z]").alias("upper"),
                       chars_in(F.col("text"), r"[!-/:-@\[-`{-~]").alias("marks"))
    binned = lambda name, value, step: F.concat(F.lit(f"~{name}:"), F.floor(value / step).cast("string"))
    n = F.greatest("n_tokens", F.lit(1))
    bins = F.array(binned("upper", F.col("upper") / F.col("chars"), 0.05), binned("marks", F.col("marks") / F.col("chars"), 0.02),
                   binned("distinct", F.size("distinct") / n, 0.1), binned("length", F.col("chars") / n, 0.5))
    return rows.select("doc_id", "text_key", "n_tokens", F.concat("distinct", bins).alias("features"))


@dataclass(frozen=True)
class DomainModel:
    """Softmax over domains: a base score, plus for each feature that is present a weight per domain."""

    domains: tuple[str, ...]
    base: tuple[float, ...]
    weights: dict[str, tuple[float, ...]]

    def scores(self, features: Column) -> Column:
        base = F.array(*[F.lit(b) for b in self.base])
        if not self.weights:
            return base
        present = F.array_intersect(features, F.array(*[F.lit(f) for f in self.weights]))
        table = F.create_map(*[c for f, w in self.weights.items() for c in (F.lit(f), F.array(*[F.lit(x) for x in w]))])
        return F.aggregate(present, base, lambda a, f: F.zip_with(a, F.element_at(table, f), lambda x, y: x + y))


def _softmax_fit(x: np.ndarray, y: np.ndarray, classes: int, l2: float = 1.0, steps: int = 400) -> np.ndarray:
    """Weights (features + 1, classes) of an L2 softmax regression, by accelerated gradient descent."""
    x = np.hstack([x, np.ones((len(x), 1))])
    wanted = np.eye(classes)[y]
    rate = 1.0 / (0.5 * np.linalg.norm(x, 2) ** 2 + l2)
    w = ahead = np.zeros((x.shape[1], classes))
    for k in range(steps):
        z = x @ ahead
        z = np.exp(z - z.max(axis=1, keepdims=True))
        slope = x.T @ (z / z.sum(axis=1, keepdims=True) - wanted)
        slope[:-1] += l2 * ahead[:-1]
        w, before = ahead - rate * slope, w
        ahead = w + k / (k + 3) * (w - before)
    return w


def fit_domains(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> DomainModel:
    """Fit on about ``sample`` labelled documents (chosen by id hash) and ``features`` features.

    At most 2 * ``sample`` distinct rows take part, however often an id is repeated.
    Features are chosen by how far the domains of the documents that have one
    differ from all; only the sample's chosen features reach the driver.
    """
    chosen = (bounded_share(labelled.select(F.col("doc_id").alias("__id"), "domain").distinct(), F.col("__id"), sample)
              .orderBy(F.xxhash64("__id"), "__id", "domain").limit(2 * sample))
    rows = keyed(docs)
    # the broadcast side holds at most 2 * ``sample`` rows of two short values
    known = bounded_rows(rows.join(F.broadcast(chosen.select("__id").distinct()), rows["doc_id"] == F.col("__id"), "left_semi"), 2 * sample)
    rows = cut_lineage(with_features(known).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
                       .select("domain", "features"))
    sizes = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy("domain").collect()}
    domains, total = tuple(sizes), sum(sizes.values())
    if not domains:
        return DomainModel((), (), {})
    held = rows.select("domain", F.explode("features").alias("f")).groupBy("f").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum((F.col("domain") == d).cast("long")).alias(f"n{i}") for i, d in enumerate(domains)])
    gain = sum(((F.col(f"n{i}") + sizes[d] / total) * F.log((F.col(f"n{i}") + sizes[d] / total) / ((F.col("n") + 1) * sizes[d] / total))
                for i, d in enumerate(domains)), F.lit(0.0))
    names = [r["f"] for r in held.orderBy(F.desc(gain), "f").limit(features).collect()]
    place = {f: i for i, f in enumerate(names)}
    found = rows.select("domain", F.array_intersect("features", F.array(*[F.lit(f) for f in names])).alias("f")).collect()
    x, y = np.zeros((len(found), len(names))), np.zeros(len(found), dtype=int)
    for at, r in enumerate(sorted(found, key=lambda r: (r["domain"], r["f"]))):
        x[at, [place[f] for f in r["f"]]] = 1
        y[at] = domains.index(r["domain"])
    w = _softmax_fit(x, y, len(domains))
    return DomainModel(domains, tuple(map(float, w[-1])), {f: tuple(map(float, w[i])) for f, i in place.items()})


def domain_posteriors(docs: DataFrame, model: DomainModel) -> DataFrame:
    """doc_id, text_key, n_tokens, p (array of posteriors in the order of ``model.domains``)."""
    scored = with_features(keyed(docs)).select("doc_id", "text_key", "n_tokens", model.scores(F.col("features")).alias("logs"))
    odds = F.transform("logs", lambda x: F.exp(x - F.array_max("logs")))
    scored = scored.select("doc_id", "text_key", "n_tokens", odds.alias("odds"))
    total = F.aggregate("odds", F.lit(0.0), lambda a, x: a + x)
    return scored.select("doc_id", "text_key", "n_tokens", F.transform("odds", lambda x: x / total).alias("p"))


def _best(p: Column, names: list) -> Column:
    """The entry of ``names`` at the first largest value of ``p``."""
    return F.get(F.array(*map(F.lit, names)), (F.array_position(p, F.array_max(p)) - 1).cast("int"))


def _dot(p: Column, g: np.ndarray) -> Column:
    return sum((p[d] * F.lit(float(v)) for d, v in enumerate(g)), F.lit(0.0))


def _rate(p: Column, g: np.ndarray, least: list[float]) -> Column:
    """One copy moved against ``g`` and projected; ``least`` has the bound of each domain, for documents likeliest in it."""
    return F.greatest(_best(p, least), F.lit(1.0) - _dot(p, g))


@dataclass(frozen=True)
class RateFit:
    """The accumulated gradient, the tokens wanted and got by domain, and how far from optimal (a share of all tokens)."""

    g: np.ndarray
    wanted: np.ndarray
    got: np.ndarray
    off: float
    steps: int

    @property
    def residual(self) -> float:
        """The largest difference of a domain's share from its target."""
        if not self.wanted.sum() or not self.got.sum():
            return 0.0
        return float(np.abs(self.got / self.got.sum() - self.wanted / self.wanted.sum()).max())


def fit_rates(members: DataFrame, targets: list[float], whole: list[int], headroom: float = HEADROOM,
              ridge: float = RIDGE, optimality: float = OPTIMALITY, most_steps: int = MOST_STEPS) -> RateFit:
    """Rates of (n_tokens, p) by projected gradient; ``targets`` are weights, ``whole`` domains that keep every document."""
    size = len(targets)
    least = [float(d in whole) for d in range(size)]
    n, p = F.col("n_tokens"), F.col("p")
    pairs = [(a, b) for a in range(size) for b in range(a, size)]
    square = lambda row, name: np.array([[row[f"{name}{min(a, b)}_{max(a, b)}"] or 0.0 for b in range(size)] for a in range(size)])
    sums = members.agg(*[F.sum(n * p[a] * p[b]).alias(f"m{a}_{b}") for a, b in pairs], *[F.sum(n * p[a]).alias(f"t{a}") for a in range(size)]).first()
    mass, held = square(sums, "m"), np.array([sums[f"t{a}"] or 0.0 for a in range(size)])
    weights = np.array(targets) / sum(targets)
    total = headroom * max([held.sum(), *(held[d] / weights[d] for d in whole if weights[d] > 0)])
    wanted = total * weights

    def at(g: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """What is minimised in g (convex), its slope, its curvature, and the tokens got."""
        move, low = _dot(p, g), _best(p, least)
        free = F.when(1 - move >= low, 1.0).otherwise(0.0)  # a document that is just at its bound may leave it
        # the integral of the rate along the move: 1 - s up to the bound, the bound beyond
        room = 1 - low
        area = F.when(move < room, move - move * move / 2).otherwise(room - room * room / 2 + low * (move - room))
        row = members.agg(F.sum(n * area).alias("v"), *[F.sum(n * p[a] * _rate(p, g, least)).alias(f"t{a}") for a in range(size)],
                          *[F.sum(n * p[a] * p[b] * free).alias(f"f{a}_{b}") for a, b in pairs]).first()
        got = np.array([row[f"t{a}"] or 0.0 for a in range(size)])
        value = 0.5 * ridge * g @ mass @ g - (row["v"] or 0.0) + wanted @ g
        return value, ridge * mass @ g - (got - wanted), ridge * mass + square(row, "f"), got

    scale = max(total, 1.0)
    g, steps, damping = np.zeros(size), 0, 0.0
    value, slope, curve, got = at(g)
    while steps < most_steps and np.abs(slope).max() > optimality * scale and damping < 1e9:
        steps += 1
        step = np.linalg.pinv(curve + damping * mass, rcond=1e-15, hermitian=True) @ slope
        tried = at(g - step)
        if tried[0] <= value - 1e-4 * float(slope @ step) or np.abs(tried[1]).max() < 0.5 * np.abs(slope).max():
            g, damping = g - step, damping / 10 if damping > ridge else 0.0
            value, slope, curve, got = tried
        else:  # the step left the region that the curvature describes
            damping = max(10 * damping, 1e-5)
    return RateFit(g, wanted, got, float(np.abs(slope).max()) / max(total, 1.0), steps)


def mix_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, whole: tuple[str, ...] = WHOLE,
              sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, text_key, n_tokens, domain (likeliest), p_<domain> for each target, rate, copies, and the
    fit's residual and distance from optimality (both the same in every row)."""
    model = fit_domains(docs, labelled.where(F.col("domain").isin(*targets)), sample)
    if not model.domains:  # nothing to learn from: no membership, one copy each
        rows = with_features(keyed(docs)).select("doc_id", "text_key", "n_tokens")
        return rows.select("*", F.lit(None).cast("string").alias("domain"), *[F.lit(0.0).alias(f"p_{d}") for d in targets],
                           F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies"),
                           F.lit(None).cast("double").alias("residual"), F.lit(None).cast("double").alias("off_optimal"))
    members = cut_lineage(domain_posteriors(docs, model))
    fit = fit_rates(members, [targets[d] for d in model.domains], [i for i, d in enumerate(model.domains) if d in whole])
    rate = _rate(F.col("p"), fit.g, [float(d in whole) for d in model.domains])
    p = {d: F.col("p")[i] for i, d in enumerate(model.domains)}
    out = members.select("doc_id", "text_key", "n_tokens", _best(F.col("p"), list(model.domains)).alias("domain"),
                         *[p.get(d, F.lit(0.0)).alias(f"p_{d}") for d in targets], rate.alias("rate"))
    draw = F.pmod(F.xxhash64(F.lit("copies"), "doc_id", "text_key"), F.lit(1 << 31)) / float(1 << 31)
    return out.select("*", F.floor(F.col("rate") + draw).cast("long").alias("copies"), F.lit(fit.residual).alias("residual"), F.lit(fit.off).alias("off_optimal"))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, whole: tuple[str, ...] = WHOLE,
        sample: int = SAMPLE) -> DataFrame:
    """``docs`` that are drawn at least once, with ``mix_rate`` and ``mix_copies``."""
    rates = mix_rates(docs, labelled, targets, whole, sample).select(
        F.col("doc_id").alias("__mix_id"), F.col("text_key").alias("__mix_key"), F.col("rate").alias("mix_rate"),
        F.col("copies").alias("mix_copies")).distinct()
    kept = docs.drop("mix_rate", "mix_copies")
    key = F.xxhash64(F.coalesce(kept["text"].cast("string"), F.lit("")))
    joined = kept.join(rates, kept["doc_id"].eqNullSafe(rates["__mix_id"]) & (key == rates["__mix_key"]))
    return joined.where("mix_copies > 0").drop("__mix_id", "__mix_key")
