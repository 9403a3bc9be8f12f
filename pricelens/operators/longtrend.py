"""Robust LOWESS of series of any length: the values of ``trend.lowess`` by many tasks.

A series is cut by rank into blocks of ``block_points`` points.  For the targets of one
block the ends of their windows sweep a few blocks at either side; these and the block
itself are *near* and weighed point by point.  All blocks between lie inside every window
of the block, and there the tricube weight ``(1 - u^3)^3`` is a polynomial in the distance: their part
follows from sums of powers, kept for runs of 1, 2, 4, ... blocks so that a block needs a logarithmic number of runs.

Per round a point meets a few blocks and some runs, whatever its neighbour count; nothing
holds a whole series but the plan of the windows, which reads two numbers a block.  The
median of the residuals between rounds is exact and distributed (``exact_quantiles``).
Window ends move forward with the targets, so near blocks add up to a few per block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from math import comb
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens import schema as S
from pricelens.operators.ranking import exact_quantiles, global_rank
from pricelens.session import landed

BLOCK_POINTS = 1024
#: Coefficients of (1 - u^3)^3 by power of u.
_TRICUBE = {0: 1.0, 3: -3.0, 6: 3.0, 9: -1.0}
#: Powers whose sums are kept: the tricube's nine and two of the line's.
_POWERS = 12
_SUMS = ["s0", "s1", "s2", "y0", "y1", "cnt"]
_PLAN = ("_sid bigint, _b bigint, ends array<struct<l: bigint, r: bigint, s0: bigint, s1: bigint>>, near array<bigint>, "
         "far array<struct<level: int, run: bigint, side: int>>, runs array<struct<level: int, run: bigint, c: double, s: double>>")


def _runs_between(lo: int, hi: int) -> list[tuple[int, int]]:
    """Blocks ``lo <= b < hi`` as few aligned runs: (level, run) covers ``run << level`` and the ``1 << level`` blocks from there."""
    out = []
    while lo < hi:
        level = (lo & -lo).bit_length() - 1 if lo else hi.bit_length()
        while lo + (1 << level) > hi:
            level -= 1
        out.append((level, lo >> level))
        lo += 1 << level
    return out


def plan_windows(first: np.ndarray, last: np.ndarray, n: int, k: int, size: int) -> list[dict]:
    """Per block: where the windows of its targets can begin and end, and what lies between.

    The window of ``x`` begins at the first rank ``s`` with ``x[s] + x[s + k - 1] >= 2 x`` or one
    before; with only each block's first and last value known this leaves a range of ranks.
    """
    m = len(first)
    steps = np.arange(m) * size
    starts = np.unique(np.clip(np.concatenate([steps, steps - (k - 1)]), 0, n - k))
    ends = starts + k - 1
    least, most = first[starts // size] + first[ends // size], last[starts // size] + last[ends // size]
    used: set[tuple[int, int]] = set()
    out = []
    for b in range(m):
        a, z = np.searchsorted(most, 2 * first[b]), np.searchsorted(least, 2 * last[b])
        lo = max(0, int(starts[a]) - 1 if a < len(starts) else n - k - 1)
        hi = int(starts[z]) if z < len(starts) else n - k
        pieces, s = [], lo
        while s <= hi:  # ranks whose window begins in one block and ends in one block
            left, right = s // size, (s + k - 1) // size
            stop = min(hi, (left + 1) * size - 1, (right + 1) * size - k)
            pieces.append({"l": left, "r": right, "s0": s, "s1": stop})
            s = stop + 1
        l0, l1, r0, r1 = lo // size, hi // size, (lo + k - 1) // size, (hi + k - 1) // size
        before, after = _runs_between(l1 + 1, min(b, r0)), _runs_between(max(b, l1) + 1, r0)
        used.update(before, after)
        out.append({"_b": b, "ends": pieces, "near": sorted({*range(l0, l1 + 1), b, *range(r0, r1 + 1)}),
                    "far": [{"level": v, "run": r, "side": -1} for v, r in before] + [{"level": v, "run": r, "side": 1} for v, r in after],
                    "runs": []})
    for level, run in used:
        lo, hi = run << level, (run + 1) << level
        c, s = (first[lo] + last[hi - 1]) / 2, (last[hi - 1] - first[lo]) / 2
        for b in range(lo, hi):
            out[b]["runs"].append({"level": level, "run": run, "c": float(c), "s": float(s) or 1.0})
    return out


def _plan(size: int):
    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_b")
        rows = plan_windows(pdf["first"].to_numpy(), pdf["last"].to_numpy(), int(pdf["_n"].iloc[0]), int(pdf["_k"].iloc[0]), size)
        told = pd.DataFrame(rows)
        told.insert(0, "_sid", pdf["_sid"].iloc[0])
        return told
    return make


def _reach(size: int):
    """Least half width, over the window starts of one piece, of every target of a block."""
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for x, left, right, l, r, s0, s1, k in zip(frame["x"], frame["lx"], frame["rx"], frame["l"], frame["r"], frame["s0"], frame["s1"], frame["_k"]):
                begin, end = left[s0 - l * size:s1 + 1 - l * size], right[s0 + k - 1 - r * size:s1 + k - r * size]
                at = np.searchsorted(begin + end, 2 * x)
                width = np.full(len(x), np.inf)
                for j in (at - 1, at):
                    j = np.clip(j, 0, len(begin) - 1)
                    width = np.minimum(width, np.maximum(x - begin[j], end[j] - x))
                out.append(width)
            yield pd.DataFrame({"_sid": frame["_sid"], "_b": frame["_b"], "h": out})
    return measure


def _power_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of powers of a block's points for every run that the block is part of."""
    for frame in batches:
        rows = []
        for sid, x, y, w, runs in zip(frame["_sid"], frame["x"], frame["y"], frame["w"], frame["runs"]):
            for run in runs:
                t = ((x - run["c"]) / run["s"])[None, :] ** np.arange(_POWERS)[:, None] * w
                rows.append((sid, run["level"], run["run"], run["c"], run["s"], int((w > 0).sum()), *t.sum(axis=1), *(t @ y)))
        yield pd.DataFrame(rows, columns=["_sid", "level", "run", "c", "s", "n", *[f"m{p}" for p in range(_POWERS)], *[f"v{p}" for p in range(_POWERS)]])


def _near_sums(x: np.ndarray, h: np.ndarray, ux: np.ndarray, uy: np.ndarray, uw: np.ndarray) -> list[np.ndarray]:
    with np.errstate(divide="ignore", invalid="ignore"):
        z = (ux[None, :] - x[:, None]) / h[:, None]
    u = np.abs(z)
    inside = u < 1.0  # false where the window has no width
    z = np.where(inside, z, 0.0)
    t = 1.0 - np.where(inside, u, 0.0) ** 3
    w = np.where(inside, t * t * t, 0.0) * uw[None, :]
    wz = w * z
    return [w.sum(axis=1), wz.sum(axis=1), (wz * z).sum(axis=1), w @ uy, wz @ uy, (w > 0).sum(axis=1).astype(float)]


def _far_sums(x: np.ndarray, h: np.ndarray, side: int, c: float, s: float, n: float, m: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    """The near sums of a run whose points lie inside all windows, from its power sums."""
    a, b = (c - x) / h, s / h  # a point's place in the window is a + b t
    out = {}
    for extra in range(3):
        # the polynomial of the place, rewritten by powers of t
        weights = np.zeros((len(x), _POWERS))
        for power, coefficient in _TRICUBE.items():
            degree = power + extra
            for j in range(degree + 1):
                weights[:, j] += coefficient * (float(side) ** power) * comb(degree, j) * a ** (degree - j) * b ** j
        out[f"s{extra}"] = weights @ m
        out[f"y{extra}"] = weights @ v
    return [out["s0"], out["s1"], out["s2"], out["y0"], out["y1"], np.full(len(x), float(n))]


def _add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        cells = []
        for row in frame.to_dict("records"):
            x, h = row["x"], row["h"]
            if row["ux"] is not None:
                cells.append(_near_sums(x, h, row["ux"], row["uy"], row["uw"]))
            else:
                cells.append(_far_sums(x, h, int(row["side"]), row["c"], row["s"], row["n"], np.asarray(row["m"]), np.asarray(row["v"])))
        yield pd.DataFrame({"_sid": frame["_sid"], "_b": frame["_b"], **{name: [c[i] for c in cells] for i, name in enumerate(_SUMS)}})


def long_lowess(df: DataFrame, series: Sequence[str], x: str, y: str, target: str = "trend",
                frac: tuple[int, int] = S.ORIGINAL_LOWESS_FRAC, iterations: int = S.ORIGINAL_LOWESS_ITERATIONS,
                block_points: int = BLOCK_POINTS) -> DataFrame:
    """``series..., x, y, trend`` with the rules of ``trend.lowess``; no series is ever in one task."""
    keys, size = list(series), block_points
    ids = ["_sid", "_b"]
    points = (df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x).agg(F.avg(y).alias(y)))
    ranked = global_rank(points, [*keys, x], "_rank")
    sizes = (ranked.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)])
                   .agg(F.min("_rank").alias("_sid"), F.count(F.lit(1)).alias("_n"), F.avg(y).alias("_mean")))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)], F.lit(True))
    at = F.col("_rank") - F.col("_sid")
    placed = landed(ranked.join(sizes, same).select(
        *keys, x, y, "_sid", "_n", F.greatest(F.lit(1), F.floor(F.col("_n") * frac[0] / frac[1])).cast("bigint").alias("_k"), "_mean",
        F.floor(at / size).cast("bigint").alias("_b"), (at % size).cast("int").alias("_at")), "series-points")

    point = F.sort_array(F.collect_list(F.struct("_at", F.col(x).cast("double").alias("x"), (F.col(y) - F.col("_mean")).alias("y"))))
    cut = landed(placed.groupBy("_sid", "_n", "_k", "_b").agg(point.alias("_p")).select("_sid", "_n", "_k", "_b", "_p.x", "_p.y"), "series-blocks")
    plan = landed(cut.select("_sid", "_n", "_k", "_b", F.col("x")[0].alias("first"), F.element_at("x", -1).alias("last"))
                     .groupBy("_sid").applyInPandas(_plan(size), _PLAN), "series-plan")

    # half widths, the same in every round
    values = cut.select("_sid", "_b", "x")
    pieces = (plan.select(*ids, F.inline("ends")).join(cut.select(*ids, "_k", "x"), ids)
                  .join(values.select("_sid", F.col("_b").alias("l"), F.col("x").alias("lx")), ["_sid", "l"])
                  .join(values.select("_sid", F.col("_b").alias("r"), F.col("x").alias("rx")), ["_sid", "r"]))
    widths = (pieces.mapInPandas(_reach(size), "_sid bigint, _b bigint, h array<double>")
                    .select(*ids, F.posexplode("h").alias("_at", "_h")).groupBy(*ids, "_at").agg(F.min("_h").alias("_h"))
                    .groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct("_at", "_h"))).alias("_p")).select(*ids, F.col("_p._h").alias("h")))
    targets = landed(cut.join(widths, ids).select(*ids, "x", "h"), "series-targets")
    near = plan.select(*ids, F.explode("near").alias("_u"))
    far = plan.select(*ids, F.inline("far"))
    blocks = cut.join(plan.select(*ids, "runs"), ids).select(*ids, "x", "y", F.transform("x", lambda _: F.lit(1.0)).alias("w"), "runs")
    spelled = "_sid bigint, level int, run bigint, c double, s double, n bigint, " + ", ".join(f"{a}{p} double" for a in "mv" for p in range(_POWERS))

    for step in range(iterations + 1):
        sums = (blocks.mapInPandas(_power_sums, spelled).groupBy("_sid", "level", "run", "c", "s")
                      .agg(F.sum("n").alias("n"), *[F.sum(f"{a}{p}").alias(f"{a}{p}") for a in "mv" for p in range(_POWERS)])
                      .select("_sid", "level", "run", "c", "s", "n", *[F.array(*[f"{a}{p}" for p in range(_POWERS)]).alias(a) for a in "mv"]))
        by_point = near.join(blocks.select("_sid", F.col("_b").alias("_u"), F.col("x").alias("ux"), F.col("y").alias("uy"), F.col("w").alias("uw")), ["_sid", "_u"]).drop("_u")
        by_run = far.join(sums, ["_sid", "level", "run"]).drop("level", "run")
        parts = by_point.unionByName(by_run, allowMissingColumns=True).join(targets, ids)
        added = parts.mapInPandas(_add_up, "_sid bigint, _b bigint, " + ", ".join(f"{c} array<double>" for c in _SUMS))
        total = (added.select(*ids, F.posexplode(F.arrays_zip(*_SUMS)).alias("_at", "_c"))
                      .groupBy(*ids, "_at").agg(*[F.sum(f"_c.{c}").alias(c) for c in _SUMS]))
        det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
        line = (F.col("s2") * F.col("y0") - F.col("s1") * F.col("y1")) / det
        fit = F.when(F.col("s0") <= 0, F.col("_own")).when((F.col("cnt") >= 2) & (det > 0), line).otherwise(F.col("y0") / F.col("s0"))
        own = cut.select(*ids, F.posexplode("y").alias("_at", "_own"))
        fitted = landed(total.join(own, [*ids, "_at"]).select(*ids, "_at", fit.alias("_fit"), F.abs(F.col("_own") - fit).alias("_off")), "series-fit")
        if step == iterations:
            break
        middle = exact_quantiles(fitted, ["_sid"], "_off", [0.5], ["_median"]).select("_sid", "_median")
        u = F.col("_off") / (F.lit(6.0) * F.col("_median"))
        weight = F.when(F.col("_median") == 0, F.lit(1.0)).when(u < 1, (1 - u * u) * (1 - u * u)).otherwise(F.lit(0.0))
        again = (fitted.join(middle, "_sid").groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct("_at", weight.alias("w")))).alias("_p"))
                       .select(*ids, "_p.w"))
        blocks = landed(blocks.drop("w").join(again, ids), "series-weights")
    return placed.join(fitted, [*ids, "_at"]).select(*keys, x, y, (F.col("_fit") + F.col("_mean")).alias(target))
