"""Mixing to target weights with soft membership, in DataFrame operations only.

A naive Bayes classifier learned from the labelled table gives every document a
posterior over the domains: words count as far as chance does not explain them,
and how far sums of dependent evidence are to be trusted is fitted on labels held
out. Nonnegative rates r minimise the weighted squared gap between the expected
domain totals, sum of tokens * rate * posterior, and the targets. Of the rates
that do, those nearest to 1 are one gradient step from 1, cut at the bounds; the
step, of as many numbers as there are domains, is found by Newton's method on
the dual, each iteration one distributed aggregate over the compact table of
posteriors. Rates are never stored: they follow from posterior and step.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import discard, materialize, sent_if_small, unpacked, whole_row

DOMAINS = ("good", "poor", "toxic")
#: Domain totals to reach, as multiples of those that the documents have.
BOOSTS = {"good": 1.0, "poor": 0.5, "toxic": 0.25}
#: Labelled ids that the classifier is fitted on at most: the least by a hash.
TRAIN_ROWS = 20_000
WORD_BUCKETS, SHAPE_BUCKETS, VARIETY_BUCKETS = 1 << 24, 1 << 10, 21
SMOOTHING = 0.5
#: Standard errors z that a bucket's count in some domain is off its expectation: its log ratios are shrunk to
#: z^2 / (z^2 + SHRINKAGE^2) of themselves, and passed over below LEAST_TELLING, where a tenth at most would be left.
SHRINKAGE, LEAST_TELLING = 4.0, 1.25
#: Words with log ratios this far apart are markers: their evidence has a sharpness of its own.
MARKER_SPREAD = 4.0
#: Log ratio from which a marker speaks for a domain.
MARKER_RATIO = 0.7
#: Sharpness that evidence is taken to have, give or take as much, before labels held out tell.
SHARPNESS = 0.3
#: One labelled id in this many is held out to fit the sharpness of the evidence.
FOLDS = 5
#: Weight of the rates' distance from 1 against the gap, and the greatest number of Newton steps at each.
NEARNESS, NEWTON = (1e-2, 1e-3, 1e-4), 25
#: Plain steps: gap that counts as none (of every domain's target).
GAP = 1e-5
SPACE = r"[\x20\x09-\x0D]+"


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, 2).when(quality == 1, 0).when(quality == 0, 1)


def _words(docs: DataFrame, *carried: Column, text_col: str) -> DataFrame:
    """A row per word (one with an empty word if there is none): carried columns, row, word and shape bucket, variety bucket."""
    split = F.split(F.coalesce(F.col(text_col), F.lit("")), SPACE)
    # Share of different words, a sign of repetition.
    variety = F.floor(F.size(F.array_distinct("_w")) / F.size("_w") * (VARIETY_BUCKETS - 1)).cast("int")
    rows = docs.select(*carried, F.monotonically_increasing_id().alias("_row"), split.alias("_w"))
    # Taken before the words are dealt into rows, else it would be worked out for every word.
    rows = rows.withColumn("_variety", variety)
    words = rows.select(*[c for c in rows.columns if c != "_w"], F.explode("_w").alias("_word"))
    lower = F.lower("_word")
    shape = F.xxhash64(F.right("_word", F.lit(1)), (F.col("_word") == F.upper("_word")) & (F.col("_word") != lower))
    return words.select(
        *[c for c in words.columns if c != "_word"],
        (F.col("_word") != "").cast("int").alias("_is"),
        F.pmod(F.xxhash64(lower), F.lit(WORD_BUCKETS)).cast("int").alias("_bucket"),
        F.pmod(shape, F.lit(SHAPE_BUCKETS)).cast("int").alias("_shape"),
    )


def _tables(counts: DataFrame) -> list[DataFrame]:
    """For word, shape and variety buckets: the log ratio of the bucket's share of a domain to its share of all.

    Shares are of (row, bucket) pairs, so that neither repetition within a row
    nor a domain of longer rows counts. At most as many rows as there are
    buckets. Log ratios shrink as far as chance explains the counts.
    """
    out, domains = [], range(len(DOMAINS))
    sums = {r["_kind"]: [r[f"_n{k}"] for k in domains] for r in counts.groupBy("_kind").agg(*[F.sum(f"_n{k}").alias(f"_n{k}") for k in domains]).collect()}
    for kind, name in enumerate(("_bucket", "_shape", "_variety")):
        rows = sums.get(kind, [0] * len(DOMAINS))
        every = sum(rows)
        n, whole = [F.col(f"_n{k}") for k in domains], reduce(Column.__add__, [F.col(f"_n{k}") for k in domains])
        expected = [whole * (rows[k] / max(1, every)) for k in domains]
        raw = [F.log((n[k] + SMOOTHING) / (expected[k] + SMOOTHING)) for k in domains]
        off = F.greatest(*[F.abs(n[k] - expected[k]) / F.sqrt(expected[k] + 1) for k in domains])
        own = counts.where(F.col("_kind") == kind).withColumn("_off", off).where(F.col("_off") > LEAST_TELLING)
        trust = F.col("_off") * F.col("_off") / (F.col("_off") * F.col("_off") + SHRINKAGE * SHRINKAGE)
        marker = F.greatest(*raw) - F.least(*raw) > MARKER_SPREAD
        out.append(own.select(F.col("_at").alias(name), marker.alias(f"_{name}_marker"), *[(trust * r).alias(f"_{name}{k}") for k, r in enumerate(raw)]))
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[DataFrame], np.ndarray]:
    """Tables of log ratios by word, shape and variety bucket, and the calibration."""
    known = (
        labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
        .agg(F.min("quality").alias("_quality"), F.max("toxic").alias("_toxic"))
        .select("_id", domain_of(F.col("_quality"), F.col("_toxic")).alias("_domain")).where(F.col("_domain").isNotNull())
    )
    # Bounded by TRAIN_ROWS.
    picked = F.broadcast(known.orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_ROWS))
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(picked, "_id")
    # Copies of one text are one witness.
    source = source.withColumn("_text_key", F.xxhash64("_text")).dropDuplicates(["_text_key", "_domain"])
    source = source.withColumn("_held_out", F.pmod(F.xxhash64("_text_key", F.lit(3)), F.lit(FOLDS)) == 0).drop("_text_key")
    own = [F.col("_domain") == k for k in range(len(DOMAINS))]
    each = [F.count_if(c).alias(f"_n{k}") for k, c in enumerate(own)] + [F.count_if(c & ~F.col("_held_out")).alias(f"_m{k}") for k, c in enumerate(own)]
    three = F.array(*[F.struct(F.lit(i).alias("_kind"), F.col(c).alias("_at")) for i, c in enumerate(("_bucket", "_shape", "_variety"))])
    words = _words(source, F.col("_domain"), F.col("_held_out"), text_col="_text")
    held = words.where("_is = 1").select("_row", "_domain", "_held_out", F.explode(three).alias("_f")).select("_row", "_domain", "_held_out", "_f.*")
    counts = materialize(held.distinct().groupBy("_kind", "_at").agg(*each), "mix-counts")
    tables = [materialize(t, "mix-table") for t in _tables(counts)]
    part = counts.select("_kind", "_at", *[F.col(f"_m{k}").alias(f"_n{k}") for k in range(len(DOMAINS))])
    part = [materialize(t, "mix-part") for t in _tables(part)]
    # At most TRAIN_ROWS rows of a few numbers.
    seen = _evidence(_sums(words.where("_held_out"), part[:2], "_domain"), part[2]).toPandas()
    evidence = seen[EVIDENCE].to_numpy(dtype=float)
    discard(counts, *part)
    return tables, calibrate(evidence, seen["_domain"].to_numpy(dtype=int))


#: Sums of log ratios of markers, of other words and shapes, of variety; whether a marker speaks for a domain.
EVIDENCE = [f"_{name}{k}" for name in ("marker", "word", "variety", "held") for k in range(len(DOMAINS))]


def calibrate(evidence: np.ndarray, domain: np.ndarray) -> np.ndarray:
    """Coefficients: of the three kinds of sums (a sharpness each), of what is held by domain, and of the domains.

    The likeliest by Newton's method, with a normal prior (a sharpness has mean
    and deviation ``SHARPNESS``, the others 0 and 1), and half a row without
    evidence of each domain. No sharpness is negative: evidence for a domain
    never speaks against it.
    """
    k = len(DOMAINS)
    x = np.zeros((len(evidence) + k, k, 3 + k * k + k))
    weight, y = np.ones(len(x)), np.concatenate([domain, np.arange(k)]).astype(int)
    weight[len(evidence) :] = 0.5
    for d in range(k):
        for i in range(3):
            x[: len(evidence), d, i] = evidence[:, i * k + d]
        x[: len(evidence), d, 3 + d * k : 3 + d * k + k] = evidence[:, 3 * k :]
        x[:, d, 3 + k * k + d] = 1
    prior = np.concatenate([np.full(3, SHARPNESS**-2), np.ones(k * k), np.full(k, 1e-6)])
    mean = np.concatenate([np.full(3, SHARPNESS), np.zeros(k * k + k)])

    def loss(c):
        logs = x @ c
        logs -= logs.max(axis=1, keepdims=True)
        logs -= np.log(np.exp(logs).sum(axis=1, keepdims=True))
        return 0.5 * (c - mean) @ (prior * (c - mean)) - weight @ logs[np.arange(len(y)), y], np.exp(logs)

    free = np.ones(x.shape[2], dtype=bool)
    while True:
        c = np.where(free, mean, 0.0)
        value, p = loss(c)
        for _ in range(50):
            off = p - (np.arange(k) == y[:, None])
            gradient = prior * (c - mean) + np.einsum("n,nd,ndi->i", weight, off, x)
            middle = np.einsum("nd,ndi->ni", p, x)
            curve = np.diag(prior) + np.einsum("nd,ndi,ndj->ij", p * weight[:, None], x, x, optimize=True) - (middle * weight[:, None]).T @ middle
            step, size = np.zeros_like(c), 1.0
            step[free] = np.linalg.solve(curve[np.ix_(free, free)], gradient[free])
            while size > 1e-6 and loss(c - size * step)[0] > value:
                size /= 2
            if size <= 1e-6 or step @ gradient < 1e-8:
                break
            c = c - size * step
            value, p = loss(c)
        if (c[:3] >= 0).all():
            return c
        free[:3] &= c[:3] > 0


def _sums(words: DataFrame, tables: list[DataFrame], *carried: str) -> DataFrame:
    """A row per row: carried columns, words, sums of the log ratios of markers and of other words, and which domains some marker speaks for."""
    # At most SHAPE_BUCKETS shapes; words are as many as the sample has.
    scored = words.join(sent_if_small(tables[0]), "_bucket", "left").join(F.broadcast(tables[1]), "_shape", "left")
    ratio = lambda c, yes: F.when(F.col("_is") == 1, F.when(F.col(f"_{c[:-1]}_marker") == yes, F.col(f"_{c}")))
    total = lambda k, yes: F.coalesce(F.sum(ratio(f"_bucket{k}", yes)), F.lit(0.0)) + F.coalesce(F.sum(ratio(f"_shape{k}", yes)), F.lit(0.0))
    most = lambda k: F.coalesce(F.max(F.greatest(ratio(f"_bucket{k}", True), ratio(f"_shape{k}", True))), F.lit(0.0))
    return scored.groupBy("_row").agg(
        *[F.first(c).alias(c) for c in (*carried, "_variety")], F.sum("_is").alias("tokens"),
        *[total(k, True).alias(f"_marker{k}") for k in range(len(DOMAINS))], *[total(k, False).alias(f"_word{k}") for k in range(len(DOMAINS))],
        *[(most(k) > MARKER_RATIO).cast("double").alias(f"_held{k}") for k in range(len(DOMAINS))],
    )


def _evidence(sums: DataFrame, varieties: DataFrame) -> DataFrame:
    kept = [c for c in sums.columns if c not in ("_row", "_variety")]
    variety = [F.coalesce(F.col(f"__variety{k}"), F.lit(0.0)).alias(f"_variety{k}") for k in range(len(DOMAINS))]
    return sums.join(F.broadcast(varieties), "_variety", "left").select(*kept, *variety)


def posteriors(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, _key (a hash of the text), tokens (words) and p0, p1, ... of every row."""
    tables, c = model
    words = _words(docs, F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("_key"), text_col=text_col)
    rows, k = _evidence(_sums(words, tables[:2], "doc_id", "_key"), tables[2]), len(DOMAINS)
    logs = []
    for d in range(k):
        terms = [float(c[i]) * F.col(EVIDENCE[i * k + d]) for i in range(3)] + [float(c[3 + d * k + j]) * F.col(f"_held{j}") for j in range(k)]
        logs.append(reduce(Column.__add__, terms, F.lit(float(c[3 + k * k + d]))).alias(f"_l{d}"))
    rows = rows.select("doc_id", "_key", "tokens", *logs)
    top = F.greatest(*[F.col(f"_l{d}") for d in range(k)])
    odds = [F.exp(F.col(f"_l{d}") - top) for d in range(k)]
    return rows.select("doc_id", "_key", "tokens", *[(o / reduce(Column.__add__, odds)).alias(f"p{d}") for d, o in enumerate(odds)])


def rate(steps: list[np.ndarray], most: float | None = None) -> Column:
    """The rate after the steps, from 1 on, between 0 and ``most``."""
    if not steps:
        return F.lit(1.0)
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    move = lambda s: reduce(Column.__add__, [s[k] * F.col(f"p{k}") for k in range(len(DOMAINS))])
    cut = (lambda r: F.least(F.lit(float(most)), r)) if most is not None else (lambda r: r)
    return F.aggregate(rows, F.lit(1.0), lambda r, s: cut(F.greatest(F.lit(0.0), r - move(s))))


def fit_rates(table: DataFrame, boosts: dict[str, float] | None = None, steps: int | None = None, most: float | None = None) -> list[np.ndarray]:
    """The step (a list of one) to the best rates. ``table`` has tokens, p0, p1, ...

    Rates are measured in units of one over the root of the tokens, so that
    long and short documents of one posterior get one rate. The gaps are
    weighed by the inverse of the posteriors' second moments, which makes the
    greatest curvature 1. Domains without tokens have no target. ``steps`` asks
    for that many plain steps of projected gradient at most instead.
    """
    domains = range(len(DOMAINS))
    boosts = BOOSTS if boosts is None else boosts
    moments = table.agg(
        *[F.sum(F.col("tokens") * F.col(f"p{k}")) for k in domains],
        *[F.sum(F.col("tokens") * F.col(f"p{i}") * F.col(f"p{j}")) for i in domains for j in domains],
    ).first()
    values = np.array([float(x or 0) for x in moments])
    totals, second = values[: len(DOMAINS)], values[len(DOMAINS) :].reshape(len(DOMAINS), -1)
    targets = totals * np.array([boosts[d] for d in DOMAINS])
    if steps is None:
        return _newton(table, targets, second, most)
    weights = np.linalg.pinv(second, rcond=1e-9, hermitian=True)
    found: list[np.ndarray] = []
    for _ in range(steps):
        gap = totals - targets
        if (np.abs(gap) <= GAP * targets).all():
            break
        found.append(weights @ gap)
        row = table.select("*", rate(found, most).alias("_rate")).agg(*[F.sum(F.col("tokens") * F.col(f"p{k}") * F.col("_rate")) for k in domains]).first()
        totals = np.array([float(x or 0) for x in row])
    return found


def _newton(table: DataFrame, targets: np.ndarray, second: np.ndarray, most: float | None) -> list[np.ndarray]:
    """The step s to rates 1 - p @ s, cut at the bounds, that minimise the weighted squared gap plus nearness times their distance from 1.

    In whitened coordinates, where second moments are the unit matrix, s is the
    gap over the nearness: the root of a monotone function, which is the
    gradient of a convex one. Reachable targets are met to about the last
    nearness of each; of others the excess is as small.
    """
    spread, axes = np.linalg.eigh(second)
    axes = axes[:, spread > 1e-9 * max(spread.max(), 1e-300)]
    if not axes.shape[1]:
        return []
    white = axes / np.sqrt(np.einsum("ki,kl,li->i", axes, second, axes))
    domains, goal = range(len(DOMAINS)), white.T @ targets
    # The bounds reach the plan as a rate's do; without an upper one there is no cut above.
    free = lambda r: (r > 0) & (r < most) if most is not None else r > 0

    def at(s: np.ndarray, nearness: float):
        """Value, gradient and curvature of the convex function."""
        step = white @ s
        r = rate([step], most)
        raw = F.lit(1.0) - reduce(Column.__add__, [float(step[k]) * F.col(f"p{k}") for k in domains])
        t = F.col("tokens")
        row = table.select("*", r.alias("_rate"), raw.alias("_raw")).agg(
            # The integral of the cut rate: half its square, and what lies beyond the upper bound.
            F.sum(t * F.col("_rate") * (F.col("_raw") - F.col("_rate") / 2)),
            *[F.sum(t * F.col(f"p{k}") * F.col("_rate")) for k in domains],
            *[F.sum(F.when(free(F.col("_raw")), t * F.col(f"p{i}") * F.col(f"p{j}")).otherwise(0.0)) for i in domains for j in domains],
        ).first()
        v = np.array([float(x or 0) for x in row])
        totals, active = v[1 : 1 + len(DOMAINS)], v[1 + len(DOMAINS) :].reshape(len(DOMAINS), -1)
        value = v[0] + goal @ s + nearness * (s @ s) / 2
        return value, goal - white.T @ totals + nearness * s, white.T @ active @ white + nearness * np.eye(len(s)), totals

    s = np.zeros(axes.shape[1])
    for nearness in NEARNESS:
        value, gradient, curve, totals = at(s, nearness)
        for _ in range(NEWTON):
            if np.linalg.norm(gradient) <= 1e-7 * np.linalg.norm(goal):
                break
            move, size = np.linalg.solve(curve, gradient), 1.0
            while True:
                next_ = at(s - size * move, nearness)
                if next_[0] <= value - 1e-4 * size * (move @ gradient) or size < 1e-4:
                    break
                size /= 2
            if next_[0] >= value:
                break
            s, (value, gradient, curve, totals) = s - size * move, next_
        if (np.abs(totals - targets) <= 1e-4 * targets).all():
            break
    return [white @ s]


def _copies() -> Column:
    chance = F.pmod(F.xxhash64("doc_id", "_key", F.lit(9)), F.lit(1 << 30)) / (1 << 30)
    return F.floor(F.col("rate") + chance).cast("int")


def document_rates(docs: DataFrame, labels: DataFrame, boosts: dict[str, float] | None = None, most: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tokens, p_good, p_poor, p_toxic, rate and copies (the rate rounded by the chance of a hash) of every row.

    The expected totals, sums of tokens * rate * posterior, meet the targets:
    the documents' own totals times ``boosts``, as nearly as rates of at most
    ``most`` can. A text without words, or null,
    has no tokens, the posterior of an empty document and the rate that goes
    with it. An id labelled more than once is of poor quality, or toxic, if any
    label says so; labels without a document, or with other values than 0 and
    1, are passed over. With too few labels for any word to tell, all rows have
    one posterior, and one rate that meets the targets as nearly as one can;
    without labels that posterior is uniform. Null or
    repeated ids are rows of their own. An empty table gives no rows. Further
    columns are not read.
    """
    return _rates(docs, labels, boosts, most, id_col, text_col).drop("_key").withColumnsRenamed({f"p{k}": f"p_{d}" for k, d in enumerate(DOMAINS)})


def _rates(docs, labels, boosts, most, id_col, text_col) -> DataFrame:
    table = materialize(posteriors(docs, fit(docs, labels, id_col, text_col), id_col, text_col), "posteriors")
    return table.withColumn("rate", rate(fit_rates(table, boosts, most=most), most)).withColumn("copies", _copies())


def mix(docs: DataFrame, labels: DataFrame, boosts: dict[str, float] | None = None, most: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, each as often as its ``copies`` say."""
    rates = _rates(docs, labels, boosts, most, id_col, text_col)
    # A row per different document; equal documents have equal posteriors and chances.
    once = rates.groupBy(F.col("doc_id").alias("_id"), "_key").agg(F.first("copies").alias("_copies")).where("_copies > 0")
    rows = docs.select(whole_row(docs).alias("_row"), F.col(id_col).alias("_own_id"), F.xxhash64(text_col).alias("_hash"))
    dealt = rows.join(once, F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_key")))
    return dealt.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select(*unpacked("_row", docs.columns))
