"""Where on the genome is the locus behind a trait: sliding-window likelihood ratios.

A grid point collects all SNPs closer than the window.  The grid is arithmetic, so each
SNP knows its grid points and no range join is needed.  Likelihoods need the beta
function, which Spark lacks; they are computed with NumPy inside Arrow batches, where
they are also summed by grid point before anything is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segspark.functions.stats import BLOCK, beta_arrays, binomial_draw, ln_beta_binomial, log_binomial, odd_crossovers, uniform
from segspark.sources.text import spread

#: Noise of the background model, and of phenotypes in the tested one.
BACKGROUND_EPS, EPS = 1e-2, 1e-4
#: SNP and grid point pairs held at once in a task.
PAIRS = 1 << 20


def spans(snps: DataFrame) -> DataFrame:
    """``chrom, pmin, pmax``, without rows that have no chromosome.  All that depends on the
    span of positions starts from this one aggregate, so a plan that needs it several times
    scans the SNPs for it once."""
    return snps.filter("chrom IS NOT NULL").groupBy("chrom").agg(F.min("pos").alias("pmin"), F.max("pos").alias("pmax"))


def grid_bounds(snps: DataFrame, step: int) -> DataFrame:
    """``chrom, pmin, points``: the grid goes from the first position in steps, to before the last."""
    return spans(snps).select("chrom", "pmin", F.ceil((F.col("pmax") - F.col("pmin")) / step).alias("points"))


def recombination_rate(snps: DataFrame, crossovers: float = 2.0, per_chrom: bool = False) -> DataFrame:
    """``crossovers`` over the span of positions: of all (one row), or of each chromosome."""
    if per_chrom:
        return spans(snps).select("chrom", (F.lit(crossovers) / (F.col("pmax") - F.col("pmin"))).alias("rate"))
    return spans(snps).agg((F.lit(crossovers) / (F.max("pmax") - F.min("pmin"))).alias("rate"))


def grid_cells(chrom: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (chrom << 40 | i), sorted, and the number of each pair among them."""
    if len(i):
        first, span = int(i.min()), int(i.max() - i.min()) + 1
        size = (int(chrom.max()) + 1) * span
        if size <= 4 * len(i):  # neighbouring SNPs share their grid points, so this is the rule
            dense = chrom * span + (i - first)
            met = np.zeros(size, bool)
            met[dense] = True
            there = np.flatnonzero(met)
            return (there // span) << 40 | (there % span + first), (np.cumsum(met) - 1)[dense]
    return np.unique(chrom << 40 | i, return_inverse=True)


#: Grid steps whose SNPs are summed together, and the fewest steps of a window for that.
GROUP, WIDE = 256, 16
#: Chebyshev terms of a grid step, those that are tried where they do not converge, and the largest
#: last term that counts as converged.
TERMS, TOLERANCE = (10, 20), 1e-12
#: Counts that are summed as terms ln(x + j); SNPs with larger ones are computed pair by pair.
COUNTS = 255


def _terms(podd: np.ndarray, pool: str, size: int, eps: float, tops: list[int], turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chebyshev coefficients (cell, term, place) of ln(alpha + j), ln(beta + j) and -ln(alpha + beta + j)
    for j below each of ``tops``, from podd at the nodes of each cell; and which cells converge."""
    alpha, beta = beta_arrays(podd, pool, size, eps)
    parts = [sign * np.log(x[..., None] + np.arange(top)) for x, top, sign in zip((alpha, beta, alpha + beta), tops, (1, 1, -1))]
    found = turn @ np.concatenate(parts, axis=-1)
    return found, np.abs(found[:, -2:]).max(axis=(1, 2), initial=0.0) <= TOLERANCE


def _chebyshev(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes in 0 to 1, and the matrix that turns values there into coefficients."""
    angle = np.pi * (np.arange(n) + 0.5) / n
    return (np.cos(angle) + 1) / 2, np.cos(np.arange(n)[:, None] * angle) * np.where(np.arange(n) == 0, 1, 2)[:, None] / n


def _moments(cell: np.ndarray, cells: int, share: np.ndarray, counts: list[np.ndarray], tops: list[int]) -> np.ndarray:
    """(term, cell, place): sums of Chebyshev polynomials at ``share`` (0 to 1) of the SNPs of a cell
    whose count goes beyond each place."""
    angle, size = np.arccos(np.clip(2 * share - 1, -1, 1)), sum(tops)
    out = np.empty((TERMS[-1], cells, size))
    for k in range(TERMS[-1]):
        at, weight = 0, np.cos(k * angle)
        for v, top in zip(counts, tops):
            by = np.bincount(cell * (top + 1) + v, weights=weight, minlength=cells * (top + 1)).reshape(cells, top + 1)
            out[k, :, at : at + top] = by[:, ::-1].cumsum(1)[:, ::-1][:, 1:]
            at += top
    return out


def _wide_sums(snps: DataFrame, n_res: int, n_sus: int, step: int, window: int, thetas: list[tuple[float, float, float]]) -> DataFrame:
    """The sums of :func:`sums_by_grid` for windows of many steps.

    With x = alpha, beta or their sum, a log likelihood is a sum of ln(x + j) over j below a count.
    Between two grid points x is smooth in the distance unless the locus is there, so these are
    series of Chebyshev polynomials: SNPs are summed once for each step, and a product of
    matrices carries the sums of all steps to all grid points in reach.  Pairs within a step,
    cells where the series has not converged, the edges of the window and large counts are
    computed one by one."""
    m = window // step  # offsets 1 - m to m are within the window, the last one unless it is m steps away
    far = np.arange(1, m)
    series = [(terms, *_chebyshev(terms)) for terms in TERMS]
    pools = (("res", n_res), ("sus", n_sus))

    def work(rows: pa.Table) -> pa.Table:
        pos, k_res, all_res, k_sus, all_sus, pmin, points = (rows[c].to_numpy().astype(np.int64) for c in ("pos", "res_major", "n_res", "sus_major", "n_sus", "pmin", "points"))
        counts, rate, total = {"res": (k_res, all_res), "sus": (k_sus, all_sus)}, float(rows["rate"][0].as_py()), int(points[0])
        place = pos - pmin
        block, over = place // step, place % step
        first = int(block.min()) - m - 1
        size = int(block.max()) + m + 2 - first
        cells, cell = np.unique(block, return_inverse=True)
        ones = np.zeros(size)
        fit = np.ones(len(pos), bool)
        for k, n in counts.values():
            fit &= (k >= 0) & (k <= n) & (n <= COUNTS)
        small, large = np.flatnonzero(fit), np.flatnonzero(~fit)

        def reach(which: np.ndarray, offset: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """SNPs that have the grid point ``offset`` in their window, its place, the distance."""
            distance = np.abs(offset * step - over[which])
            near = distance < window
            return which[near], (block[which] + offset - first)[near], np.maximum(1, distance[near])

        def sums(pairs: tuple[np.ndarray, np.ndarray, np.ndarray], pool: str, eps: float, scale: float) -> np.ndarray:
            which, at, distance = pairs
            (k, n), number, ll = counts[pool], dict(pools)[pool], np.empty(len(which))
            for part in (slice(x, x + BLOCK) for x in range(0, len(which), BLOCK)):
                podd = -0.5 * np.expm1(-2.0 * distance[part] * scale * rate)
                ll[part] = ln_beta_binomial(k[which[part]], n[which[part]], *beta_arrays(podd, pool, number, eps))
            return np.bincount(at, weights=ll, minlength=size)

        joined = lambda pairs: tuple(map(np.concatenate, zip(*pairs)))
        # One by one: pairs within a step and at the edges; what the last step of the window has too much.
        single = joined([reach(small, o) for o in (0, 1, -m, m + 1)])
        last = small[over[small] == 0] if m * step == window else small[:0]
        surplus = (last, block[last] + m - first, np.full(len(last), m * step))
        beyond = np.arange(-m - 1, m + 2)
        tops = {p: [int(v[small].max(initial=0)) for v in (k, n - k, n)] for p, (k, n) in counts.items()}
        moments = {p: _moments(cell[small], len(cells), over[small] / step, [k[small], (n - k)[small], n[small]], tops[p]) for p, (k, n) in counts.items()}
        ll0 = {}
        for b in {b for _, b, _ in thetas}:
            half = np.full(len(pos), 0.5)
            base = sum(ln_beta_binomial(*counts[p], *beta_arrays(half, p, number, b)) for p, number in pools)
            whole, ll0[b] = np.bincount(cell[small], weights=base[small], minlength=len(cells)), np.zeros(size)
            for o in range(1 - m, m + 1):
                if o not in (0, 1):
                    ll0[b][cells + o - first] += whole
            for pairs, sign in ((single, 1), (surplus, -1), *((reach(large[x : x + 4096].repeat(len(beyond)), np.tile(beyond, len(large[x : x + 4096]))), 1) for x in range(0, len(large), 4096))):
                ll0[b] += sign * np.bincount(pairs[1], weights=base[pairs[0]], minlength=size)
        out = []
        for eps, _, scale in thetas:
            ll = np.zeros(size)
            for p, number in pools:
                ll += sums(single, p, eps, scale) - sums(surplus, p, eps, scale)
                for x in range(0, len(large), 4096):
                    ll += sums(reach(large[x : x + 4096].repeat(len(beyond)), np.tile(beyond, len(large[x : x + 4096]))), p, eps, scale)
                steps = far if len(small) else far[:0]
                for terms, nodes, turn in series:
                    if len(steps):
                        found, fine = _terms(-0.5 * np.expm1(-2.0 * (steps[:, None] + nodes) * step * scale * rate), p, number, eps, tops[p], turn)
                        both = [(moments[p][side:terms:2] @ found[fine, side::2].transpose(1, 2, 0)).sum(0) for side in (0, 1)]  # the same to the left and to the right, the opposite
                        left, right = both[0] + both[1], both[0] - both[1]
                        for c, s in enumerate(steps[fine].tolist()):
                            ll[cells - s - first] += left[:, c]
                            ll[cells + s + 1 - first] += right[:, c]
                        steps = steps[~fine]
                for s in steps.tolist():
                    ll += sums((small, block[small] - s - first, s * step + over[small]), p, eps, scale)
                    ll += sums((small, block[small] + s + 1 - first, (s + 1) * step - over[small]), p, eps, scale)
            out.append(ll)
        for o in range(-m - 1, m + 2):
            ones[cells + o - first] = 1
        there = np.flatnonzero(ones)
        there = there[(there + first >= 0) & (there + first < total)]
        names = pa.array([rows["chrom"][0].as_py()] * (len(there) * len(thetas)), pa.string())
        columns = [np.tile(there + first, len(thetas)), np.repeat(np.arange(len(thetas), dtype=np.int32), len(there)), np.concatenate([x[there] for x in out]), np.concatenate([ll0[b][there] for _, b, _ in thetas])]
        return pa.table([names, *map(pa.array, columns)], names=["chrom", "i", "theta", "ll", "ll0"])

    dealt = snps.filter("pos IS NOT NULL").withColumn("_group", F.floor((F.col("pos") - F.col("pmin")) / (step * GROUP)))
    # Groups cost far more than their rows, so they are dealt to many tasks, however few bytes they are.
    spark = snps.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    return dealt.repartition(tasks, "chrom", "_group").groupBy("chrom", "_group").applyInArrow(work, "chrom string, i long, theta int, ll double, ll0 double")


def sums_by_grid(snps: DataFrame, rates: DataFrame, n_res: int, n_sus: int, step: int, window: int, eps: list[float], scales: list[float], background: list[float]) -> DataFrame:
    """``chrom, i, theta, ll, ll0``: log likelihoods at grid point i, summed over its window,
    for each pair theta of ``eps`` and ``scales``; ``background`` has an epsilon for each."""
    thetas = [(e, b, s) for e, b in zip(eps, background, strict=True) for s in scales]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chroms = batch.column(0).dictionary_encode()
            code = chroms.indices.to_numpy().astype(np.int64)
            pos, kr, nr, ks, ns, pmin, points = (batch.column(c).to_numpy().astype(np.int64) for c in range(1, 8))
            rate = batch.column(8).to_numpy()
            lo = np.maximum(0, (pos - window - pmin) // step + 1)
            hi = np.minimum(points - 1, -((pmin - pos - window) // step) - 1)
            width = np.maximum(hi - lo + 1, 0)
            half = np.full(len(pos), 0.5)
            base = {b: ln_beta_binomial(kr, nr, *beta_arrays(half, "res", n_res, b)) + ln_beta_binomial(ks, ns, *beta_arrays(half, "sus", n_sus, b)) for b in set(background)}
            ends = np.cumsum(width)
            at = 0
            while at < len(pos):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
                which = np.repeat(np.arange(at, to), width[at:to])
                first = np.cumsum(width[at:to]) - width[at:to]
                i = np.arange(len(which)) - np.repeat(first, width[at:to]) + lo[which]
                distance = np.maximum(1, np.abs(pmin[which] + i * step - pos[which]))
                cells, cell = grid_cells(code[which], i)
                total = lambda x: np.bincount(cell, weights=x, minlength=len(cells))  # noqa: B023, E731
                for t, (e, b, s) in enumerate(thetas):
                    ll = np.empty(len(which))
                    for part in (slice(x, x + BLOCK) for x in range(0, len(which), BLOCK)):
                        w = which[part]
                        podd = -0.5 * np.expm1(-2.0 * distance[part] * s * rate[w])
                        ll[part] = ln_beta_binomial(kr[w], nr[w], *beta_arrays(podd, "res", n_res, e)) + ln_beta_binomial(ks[w], ns[w], *beta_arrays(podd, "sus", n_sus, e))
                    names = chroms.dictionary.take(pa.array(cells >> 40))
                    yield pa.RecordBatch.from_arrays([names, pa.array(cells & ((1 << 40) - 1)), pa.array(np.full(len(cells), t, np.int32)), pa.array(total(ll)), pa.array(total(base[b][which]))], names=["chrom", "i", "theta", "ll", "ll0"])
                at = to

    # SNPs come from a scan here; joins with a row for each chromosome keep their partitions.
    ready = spread(snps).select("chrom", "pos", "res_major", (F.col("res_major") + F.col("res_minor")).alias("n_res"), "sus_major", (F.col("sus_major") + F.col("sus_minor")).alias("n_sus"))
    ready = ready.join(grid_bounds(snps, step), "chrom")
    ready = ready.join(rates, "chrom") if "chrom" in rates.columns else ready.crossJoin(F.broadcast(rates))  # one row
    ready = ready.select("chrom", "pos", "res_major", "n_res", "sus_major", "n_sus", "pmin", "points", "rate")
    if window >= WIDE * step:
        parts = _wide_sums(ready, n_res, n_sus, step, window, thetas)
    else:
        parts = ready.mapInArrow(work, "chrom string, i long, theta int, ll double, ll0 double")
    return parts.groupBy("chrom", "i", "theta").agg(F.sum("ll").alias("ll"), F.sum("ll0").alias("ll0"))


def _on_grid(snps: DataFrame, step: int, found: DataFrame) -> DataFrame:
    """Every grid point with its ``score``, which is 0 where no SNP is near or the ratio is negative."""
    grid = grid_bounds(snps, step).filter("points > 0").select("chrom", "pmin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("points") - 1)).alias("i"))
    return grid.join(found, ["chrom", "i"], "left").select("chrom", (F.col("pmin") + F.col("i") * step).alias("pos"), F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)).alias("score"))


def map_score(snps: DataFrame, n_res: int, n_sus: int, step: int = 100_000, window: int = 5_000_000, eps: float = EPS, rates: DataFrame | None = None) -> DataFrame:
    """``chrom, pos, score`` at every grid point: log likelihood ratio of the locus being
    there against free segregation, 0 at least.  A SNP at the grid point itself counts as
    one base pair away."""
    rates = recombination_rate(snps) if rates is None else rates
    sums = sums_by_grid(snps, rates, n_res, n_sus, step, window, [eps], [1.0], [BACKGROUND_EPS])
    return _on_grid(snps, step, sums.select("chrom", "i", (F.col("ll") - F.col("ll0")).alias("score")))


def map_score_opt(snps: DataFrame, n_res: int, n_sus: int, step: int = 100_000, window: int = 5_000_000, opt_eps: bool = True, opt_recombination: bool = True, points: int = 10, rates: DataFrame | None = None) -> DataFrame:
    """The same with noise and recombination scale optimised at each grid point; the two
    likelihoods are maximised each on its own."""
    rates = recombination_rate(snps) if rates is None else rates
    eps = [float(x) for x in 10 ** np.linspace(-10, -1, points)] if opt_eps else [1e-2]
    scales = [float(x) for x in np.linspace(0.1, 10, points)] if opt_recombination else [1.0]
    sums = sums_by_grid(snps, rates, n_res, n_sus, step, window, eps, scales, eps)
    return _on_grid(snps, step, sums.groupBy("chrom", "i").agg((F.max("ll") - F.max("ll0")).alias("score")))


def peaks(scores: DataFrame) -> DataFrame:
    """The best grid point of each chromosome; the first one of equals."""
    best = F.max_by(F.struct("pos", "score"), F.struct("score", -F.col("pos"))).alias("b")
    return scores.groupBy("chrom").agg(best).select("chrom", F.col("b.pos").alias("pos"), F.col("b.score").alias("score"))


def nearest_snp(snps: DataFrame, step: int, reach: int) -> DataFrame:
    """``chrom, i, pos, distance``: the SNP nearest to each grid point, the first one of equals;
    grid points without a SNP closer than ``reach`` are absent."""
    near = snps.select("chrom", "pos").join(grid_bounds(snps, step), "chrom")
    lo = F.greatest(F.lit(0), F.floor((F.col("pos") - reach - F.col("pmin")) / step) + 1)
    hi = F.least(F.col("points") - 1, F.ceil((F.col("pos") + reach - F.col("pmin")) / step) - 1)
    near = near.withColumn("_lo", lo).withColumn("_hi", hi).filter("_lo <= _hi").withColumn("i", F.explode(F.sequence("_lo", "_hi")))
    best = F.min(F.struct(F.abs(F.col("pmin") + F.col("i") * step - F.col("pos")).alias("distance"), "pos")).alias("b")
    return near.groupBy("chrom", "i").agg(best).select("chrom", "i", "b.pos", "b.distance")


def balanced_sample(snps: DataFrame, center: int, size: int, seed: int = 1, key: str = "vid") -> DataFrame:
    """At most ``size`` SNPs to the left and to the right of ``center``, drawn by a seeded hash."""
    side = F.col("pos") >= center
    draw = F.struct(F.xxhash64(F.col(key), F.lit(seed)), F.col(key))
    return snps.filter(side).orderBy(draw).limit(size).unionByName(snps.filter(~side).orderBy(draw).limit(size))


def corrected_frequency(expected: float = 0.66) -> Column:
    """Joint frequency of the major allele over its expectation."""
    return F.try_divide(F.col("both_major"), F.col("both_major") + F.col("both_minor")) / expected


def binomial_lod(p_res: float = 0.99, p_sus: float = 0.33) -> list[Column]:
    """``score, score_res, score_sus`` of each SNP against one half."""
    parts = []
    for pool, p in (("res", p_res), ("sus", p_sus)):
        k, n = F.col(f"{pool}_major"), F.col(f"{pool}_major") + F.col(f"{pool}_minor")
        parts.append(log_binomial(k, n, p) - log_binomial(k, n, 0.5))
    return [(parts[0] + parts[1]).alias("score"), parts[0].alias("score_res"), parts[1].alias("score_sus")]


def eval_binomial(index: int, rates: dict[str, float]) -> Column:
    """Sum over pools of the log likelihood of the allele at ``index`` (0: major)."""
    out = F.lit(0.0)
    for pool, p in rates.items():
        out = out + log_binomial(F.col(f"{pool}_{'minor' if index else 'major'}"), F.col(f"{pool}_major") + F.col(f"{pool}_minor"), p)
    return out


def binomial_opt(p_res: float = 0.99, p_sus: float = 0.33) -> list[Column]:
    """The better of both phases, the background, and both phases."""
    one, two = (eval_binomial(i, {"res": p_res, "sus": p_sus}) for i in (0, 1))
    return [F.greatest(one, two).alias("l"), eval_binomial(0, {"res": 0.5, "sus": 0.5}).alias("lb"), one.alias("l1"), two.alias("l2")]


def phased_counts(phase: bool) -> list[Column]:
    """``k_res, k_sus`` of the allele that is commoner in res (ties: the first); the first
    allele if not phased."""
    swap = (F.col("res_minor") > F.col("res_major")) & F.lit(phase)
    return [F.when(swap, F.col(f"{p}_minor")).otherwise(F.col(f"{p}_major")).alias(f"k_{p}") for p in ("res", "sus")]


def stepwise_binomial(snps: DataFrame, d_max: int, step: int = 100_000, p_res: float = 0.99, p_sus: float = 0.33, grid: DataFrame | None = None) -> DataFrame:
    """``chrom, pos, ratio, posterior`` at first + step, first + 2 step, ... for rates that fade to
    one half over ``d_max``; ``grid`` (from :func:`grid_bounds`) if it is not that of the SNPs.

    Beyond ``d_max`` both models have rate one half (``p_sus`` at one half stays there), so
    only SNPs within it add to the ratio."""
    pool = lambda x: (F.col(f"{x}_major"), F.col(f"{x}_major") + F.col(f"{x}_minor"))
    bounds = grid_bounds(snps, step) if grid is None else grid
    near = snps.join(bounds, "chrom")
    lo = F.greatest(F.lit(1), F.floor((F.col("pos") - d_max - F.col("pmin")) / step) + 1)
    hi = F.least(F.col("points"), F.ceil((F.col("pos") + d_max - F.col("pmin")) / step) - 1)
    near = near.withColumn("_lo", lo).withColumn("_hi", hi).filter("_lo <= _hi").withColumn("i", F.explode(F.sequence("_lo", "_hi")))
    share = F.abs(F.col("pmin") + F.col("i") * step - F.col("pos")) / d_max
    rate_res = F.least(F.greatest(1 - share * 0.5, F.lit(0.5)), F.lit(1 - 1e-12))
    rate_sus = F.least(p_sus + share * (0.5 - p_sus), F.lit(0.5))
    ratio = sum(log_binomial(*pool(x), rate) - log_binomial(*pool(x), 0.5) for x, rate in (("res", rate_res), ("sus", rate_sus)))
    sums = near.groupBy("chrom", "i").agg(F.sum(ratio).alias("ratio"))
    points = bounds.filter("points > 0").select("chrom", "pmin", F.explode(F.sequence(F.lit(1).cast("long"), F.col("points"))).alias("i"))
    out = points.join(sums, ["chrom", "i"], "left").withColumn("ratio", F.coalesce("ratio", F.lit(0.0)))
    return out.select("chrom", (F.col("pmin") + F.col("i") * step).alias("pos"), "ratio", (1 / (1 + F.exp(-F.col("ratio")))).alias("posterior"))


def binned_ratios(snps: DataFrame, window: int, step: int, p_res: float = 0.9, p_sus: float = 0.3) -> DataFrame:
    """Sums over bins of the log likelihood ratios of both pools and of the two together."""
    from segspark.operators.bins import position_bins

    scored = snps.select("chrom", "pos", *binomial_lod(p_res, p_sus))
    return position_bins(scored, ["score_res", "score_sus", "score"], window, step)


def pooled_rate_peaks(snps: DataFrame, window: int, step: int, least: float = -6000) -> DataFrame:
    """Bins of the phased likelihood of res less that of sus at the pooled global rates;
    bins whose background sums to ``least`` or less are left out."""
    from segspark.operators.bins import position_bins

    rate = lambda x: (F.sum(f"{x}_major") / F.sum(F.col(f"{x}_major") + F.col(f"{x}_minor"))).alias(f"rate_{x}")
    row = F.broadcast(snps.agg(rate("res"), rate("sus")))  # one row
    best = lambda x: F.greatest(*(log_binomial(F.col(f"{x}_{a}"), F.col(f"{x}_major") + F.col(f"{x}_minor"), F.col(f"rate_{x}")) for a in ("major", "minor")))
    scored = snps.crossJoin(row).select("chrom", "pos", (best("res") - best("sus")).alias("peak"), eval_binomial(0, {"res": 0.5, "sus": 0.5}).alias("background"))
    return position_bins(scored, ["peak", "background"], window, step).filter(F.col("background") > least)


def simulate_pools(places: DataFrame, locus: int, rate: float = 2 / 17_645_844, pool: int = 178, reads: int = 20, draws: int = 10, seed: int = 1) -> DataFrame:
    """``chrom, pos, draw, distance, pool_count, read_count`` for each of ``places`` (chrom, pos): how many
    of a pool keep the allele of a locus that far away, and how many of the reads from the
    pool show it.  Both are drawn by the inverse of their cumulated probability from hashes
    of place and draw, so every run and engine draws alike."""
    rows = places.select("chrom", "pos", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    rows = rows.withColumn("distance", F.abs(F.col("pos") - locus))
    drawn = lambda what: uniform(F.lit(seed), F.col("chrom"), F.col("pos"), F.col("draw"), F.lit(what))
    lost = rows.withColumn("_lost", binomial_draw(pool, odd_crossovers(F.col("distance"), rate), drawn("pool")))
    without = binomial_draw(reads, F.col("_lost") / pool, drawn("reads"))
    return lost.select("chrom", "pos", "draw", "distance", (pool - F.col("_lost")).alias("pool_count"), (reads - without).alias("read_count"))
