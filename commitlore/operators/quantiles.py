"""Exact quantiles of very long columns.

The built-in percentile keeps every distinct value of a column in one buffer. That
is used while a column fits one; a longer column is narrowed down by histograms
until each wanted rank lies among few rows. Results are the same either way.
"""

import math

from pyspark.sql import DataFrame, functions as F

from commitlore.functions.numbers import known
from commitlore.session import reused

_BINS = 1024


def exact_quantiles(df: DataFrame, columns, probs, buffer_values: int = 2_000_000) -> dict:
    """Linear-interpolated quantiles: {column: [value per prob]}, None for an empty column."""
    columns, probs = list(columns), [float(p) for p in probs]
    narrow = df.select(*[known(c).alias(f"c{i}") for i, c in enumerate(columns)])
    with reused(narrow) as values:
        bounds = values.agg(
            *[
                F.struct(F.count(f"c{i}").alias("n"), F.min(f"c{i}").alias("lo"), F.max(f"c{i}").alias("hi"))
                .alias(f"c{i}")
                for i in range(len(columns))
            ]
        ).first()
        if max(b["n"] for b in bounds) <= buffer_values:
            row = values.agg(
                *[F.percentile(f"c{i}", F.array(*map(F.lit, probs))).alias(f"c{i}") for i in range(len(columns))]
            ).first()
            found = [row[f"c{i}"] for i in range(len(columns))]
        else:
            found = _by_rank(values, bounds, probs, buffer_values)
    return {c: (list(v) if v is not None else [None] * len(probs)) for c, v in zip(columns, found)}


def _by_rank(values, bounds, probs, few):
    """Look up the ranks each quantile interpolates between."""
    ranks = {}
    for i, b in enumerate(bounds):
        for p in probs if b["n"] else []:
            at = p * (b["n"] - 1)
            for r in (math.floor(at), math.ceil(at)):
                ranks[(i, r)] = (i, b["lo"], b["hi"], 0, b["n"])
    found = {}
    while True:
        for key, (i, lo, hi, below, n) in list(ranks.items()):
            if lo == hi:
                found[key] = lo
                del ranks[key]
        wide = sorted({v for v in ranks.values() if v[4] > few})
        if not wide:
            break
        finer = _histograms(values, wide)
        for key, bracket in ranks.items():
            if bracket in finer:
                below = bracket[3]
                for lo, hi, n in finer[bracket]:
                    if key[1] < below + n:
                        ranks[key] = (bracket[0], lo, hi, below, n)
                        break
                    below += n
    if ranks:
        found.update(_among_few(values, ranks))
    out = []
    for i, b in enumerate(bounds):
        if not b["n"]:
            out.append(None)
            continue
        row = []
        for p in probs:
            at = p * (b["n"] - 1)
            low, high = found[(i, math.floor(at))], found[(i, math.ceil(at))]
            row.append(low + (high - low) * (at - math.floor(at)))
        out.append(row)
    return out


def _inside(bracket):
    c = F.col(f"c{bracket[0]}")
    return (c >= F.lit(bracket[1])) & (c <= F.lit(bracket[2]))


def _per_bracket(values, brackets, payload):
    """One row per value and bracket that holds it."""
    cases = [F.when(_inside(b), payload(k, b)) for k, b in enumerate(brackets)]
    return values.select(F.explode(F.array(*cases)).alias("x")).filter("x is not null").select("x.*")


def _histograms(values, brackets):
    def payload(k, b):
        v, lo, hi = F.col(f"c{b[0]}"), F.lit(b[1]), F.lit(b[2])
        # halves, so that the width of a range over most of the doubles stays finite
        bin_no = F.least(F.floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * _BINS), F.lit(_BINS - 1))
        return F.struct(F.lit(k).alias("k"), bin_no.alias("bin"), v.alias("v"))

    # at most _BINS rows per bracket come back
    rows = (
        _per_bracket(values, brackets, payload)
        .groupBy("k", "bin").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
        .orderBy("k", "bin").collect()
    )
    out = {b: [] for b in brackets}
    for r in rows:
        out[brackets[r["k"]]].append((r["lo"], r["hi"], r["n"]))
    return out


def _among_few(values, ranks):
    brackets = sorted(set(ranks.values()))
    wanted = {b: sorted({r - b[3] for (_, r), bb in ranks.items() if bb == b}) for b in brackets}

    def payload(k, b):
        return F.struct(F.lit(k).alias("k"), F.col(f"c{b[0]}").alias("v"))

    # a bracket holds no more rows than the buffer bound that ended the narrowing
    ordered = _per_bracket(values, brackets, payload).groupBy("k").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    picks = F.create_map(
        *[x for k, b in enumerate(brackets) for x in (F.lit(k), F.array(*map(F.lit, wanted[b])))]
    )
    rows = ordered.select(
        "k", F.transform(F.element_at(picks, F.col("k")), lambda at: F.get("vs", at.cast("int"))).alias("vs")
    ).collect()
    value = {(brackets[r["k"]], at): v for r in rows for at, v in zip(wanted[brackets[r["k"]]], r["vs"])}
    return {key: value[(b, key[1] - b[3])] for key, b in ranks.items()}
