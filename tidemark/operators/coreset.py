"""Replay buffers, coresets and spectra.

Greedy selections (herding, k-centre) take several picks from each pass over all rows, for all classes at once, as
long as carried bounds show that they are the exact ones.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .quantiles import cumulative, hex_levels, least, order_levels


def stratified_sample(df: DataFrame, ident: str, target: str, size: int, seed: int = 42) -> DataFrame:
    """All rows when there are no more than ``size``; else of each class its share, by largest remainders, in hash order."""
    n = df.groupBy(F.col(target).alias("__t")).agg(F.count("*").alias("__n")).withColumn("__all", F.sum("__n").over(Window.partitionBy()))
    exact = F.col("__n") * F.lit(size) / F.col("__all")
    n = n.withColumn("__q", F.floor(exact)).withColumn("__f", exact - F.floor(exact))
    n = n.withColumn("__left", F.lit(size) - F.sum("__q").over(Window.partitionBy()))
    n = n.withColumn("__rank", F.row_number().over(Window.orderBy(F.desc("__f"), "__t")))
    quota = F.when(F.col("__all") <= size, F.col("__n")).otherwise(F.col("__q") + (F.col("__rank") <= F.col("__left")).cast("int"))
    order = [*hex_levels(hash_order(ident, seed)), *order_levels(df, ident)]
    return least(df, order, n.select("__t", quota.alias("__quota")), target)


def hash_order(ident: str, seed: int):
    return F.sha2(F.concat_ws(":", F.col(ident).cast("string"), F.lit(str(seed))).cast("binary"), 256)


def update_buffer(old: DataFrame | None, new: DataFrame, ident: str, target: str, size: int = 1000, seed: int = 42) -> DataFrame:
    """The buffer after new rows came."""
    both = new if old is None else old.unionByName(new, allowMissingColumns=True)
    return stratified_sample(both, ident, target, size, seed)


def replay_mix(train: DataFrame, buffer: DataFrame, ident: str, target: str, ratio: float = 0.2, least: int = 10, seed: int = 42) -> DataFrame:
    """Train rows and as many replayed ones as make up ``ratio`` of the mix, at least ``least``, at most the buffer."""
    r = train.agg(F.count("*").alias("n")).crossJoin(buffer.agg(F.count("*").alias("m"))).first()
    n = min(int(r["m"]), max(least, int(r["n"] * ratio / (1 - ratio))))
    return train.unionByName(stratified_sample(buffer, ident, target, n, seed), allowMissingColumns=True)


def _quotas(rows: DataFrame, size: int, by: str | None) -> dict[str, int]:
    """How many each class gives: its share of ``size``, one at least. One row a class."""
    n = {r["c"]: r["n"] for r in rows.groupBy("c").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    return {c: k if total <= size else min(k, max(1, round(k * size / total)) if by else size) for c, k in n.items()}


#: Numbers that the driver holds of a pass's candidates, and the groups that merge what tasks send.
HELD, SLOTS = 4_000_000, 16


def _squares(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distance of each row from the nearest point."""
    out = np.full(len(x), np.inf)
    for p in points:
        np.minimum(out, ((x - p) ** 2).sum(1), out=out)
    return out


def _least(part: pd.DataFrame, held: int) -> tuple[pd.DataFrame, float]:
    """The ``held`` rows of least value (then id), and the least value among the others."""
    if len(part) <= held:
        return part, np.inf
    part = part.sort_values(["value", "id"], ignore_index=True)
    return part.iloc[:held], float(part["value"].iloc[held])


def _candidates(rows: DataFrame, wanted: dict, sign: int, held: int) -> tuple[dict[str, tuple], dict[str, float]]:
    """One pass (ids, vectors and values in order): of each class the free rows of least ``sign`` x squared distance from the class's points, and a bound
    that no other free row of the class lies below. Tasks send ``held`` rows a class, which ``SLOTS`` groups merge."""
    kind = dict(rows.dtypes)["id"]
    sent = rows.sparkSession.sparkContext.broadcast(wanted)
    schema = f"c string, slot int, id {kind}, x array<double>, value double"

    def told(c, slot: int, kept: pd.DataFrame, bound: float) -> pd.DataFrame:
        """The kept rows and one without a vector that holds the bound."""
        n = len(kept) + 1
        ids = pd.Series([*kept["id"], None], dtype=object)
        return pd.DataFrame({"c": [c] * n, "slot": [slot] * n, "id": ids, "x": [*kept["x"], None], "value": [*kept["value"], bound]})

    def task(batches):
        slot = TaskContext.get().partitionId() % SLOTS
        kept: dict = {}
        for b in batches:
            for c, part in b.groupby("c", dropna=False):
                c = None if pd.isna(c) else c
                if c not in sent.value:
                    continue
                points, taken = sent.value[c]
                part = part[~part["id"].isin(taken)]
                if not len(part):
                    continue
                part = part.assign(value=sign * _squares(np.stack(part["x"]), points))
                before, bound = kept.get(c, (part.iloc[:0], np.inf))
                best, left = _least(pd.concat([before, part]) if len(before) else part, held)
                kept[c] = best, min(bound, left)
        for c, (best, bound) in kept.items():
            yield told(c, slot, best, bound)

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        c, slot, rest = part["c"].iloc[0], part["slot"].iloc[0], part["x"].isna()
        best, left = _least(part[~rest], held)
        return told(c, slot, best, min(left, float(part.loc[rest, "value"].min())))

    found = rows.mapInPandas(task, schema).groupBy("c", "slot").applyInPandas(merge, schema).toArrow()  # at most held x SLOTS rows a class
    values, ids, classes = found.column("value").to_numpy(), found.column("id").to_pylist(), found.column("c").to_pylist()
    x = found.column("x").combine_chunks()
    bound = x.is_null().to_numpy(zero_copy_only=False)
    place = np.cumsum(~bound) - 1
    x = x.drop_null().flatten().to_numpy().reshape(int((~bound).sum()), -1) if not bound.all() else np.empty((0, 0))
    best: dict[str, list] = {c: [] for c in wanted}
    bounds = dict.fromkeys(wanted, np.inf)
    for i, c in enumerate(classes):
        if bound[i]:
            bounds[c] = min(bounds[c], values[i])
        else:
            best[c].append((values[i], ids[i], place[i]))
    out = {}
    for c, v in best.items():
        v.sort(key=lambda r: r[:2])
        out[c] = [i for _, i, _ in v], x[[p for *_, p in v]], np.array([d for d, *_ in v])
    return out, bounds


def _result(df: DataFrame, ident: str, chosen: dict[str, list]) -> DataFrame:
    kind = dict(df.dtypes)[ident]
    ids = df.sparkSession.createDataFrame([(i,) for v in chosen.values() for i, _ in v], f"__id {kind}")
    return df.join(ids, df[ident] == ids["__id"], "left_semi")


def _greedy(df: DataFrame, ident: str, features: str, size: int, by: str | None, start, points, sign: int, still, held: int | None, passes: list | None) -> DataFrame:
    """Greedy picks with carried candidates: each pass brings every class's best rows and a bound on all others, and
    the driver picks from them as long as that bound shows that no other row can be better.

    ``start`` gives a class's beginning; ``points`` of a beginning and the chosen rows are what distances are taken
    from. ``still(value, bound, points then, points now)``: a candidate of this value is ahead of all rows beyond the bound.
    """
    ship(df.sparkSession)
    rows = df.select((F.col(by).cast("string") if by else F.lit("")).alias("c"), F.col(ident).alias("id"), F.col(features).cast("array<double>").alias("x")).where("x is not null and id is not null").persist()
    quota = _quotas(rows, size, by)
    began = start(rows)
    chosen: dict[str, list[tuple]] = {c: [] for c in quota}
    while wanted := {c: (points(began[c], [x for _, x in chosen[c]]), [i for i, _ in chosen[c]]) for c in quota if len(chosen[c]) < quota[c]}:
        # The first pick is from a point of its own, from which the others' distances are not taken.
        first = {c for c in wanted if not chosen[c]}
        signs = {1 if sign > 0 or c in first else sign for c in wanted}
        for s in signs:
            part = {c: v for c, v in wanted.items() if (1 if sign > 0 or c in first else sign) == s}
            left = max(quota[c] - len(chosen[c]) for c in part)
            width = max(p.shape[1] for p, _ in part.values())
            most = held or max(16, min(64 * left, HELD // (SLOTS * width * len(part))))
            best, bounds = _candidates(rows, part, s, most)
            if passes is not None:
                passes.append(len(part))
            for c, (ids, x, value) in best.items():
                then, free = part[c][0], np.ones(len(ids), bool)
                while len(chosen[c]) < quota[c] and free.any():
                    now = points(began[c], [v for _, v in chosen[c]])
                    if free.all():
                        at = 0
                    elif s != sign:
                        break  # the rule changes after the first pick
                    else:
                        value = sign * _squares(x, now) if sign > 0 else np.maximum(value, -((x - now[-1]) ** 2).sum(1))
                        open_ = np.flatnonzero(free)
                        low = open_[value[open_] == value[open_].min()]
                        at = min(low, key=ids.__getitem__)
                        if not still(value[at], bounds[c], then, now):
                            break
                    free[at] = False
                    chosen[c].append((ids[at], x[at]))
    rows.unpersist()
    return _result(df, ident, chosen)


def herding(df: DataFrame, ident: str, features: str, size: int, by: str | None = None, held: int | None = None, passes: list | None = None) -> DataFrame:
    """Rows whose mean follows the mean of all (of each class): each pick is the row x that brings the mean
    of the selection nearest to the class's mean m, over all rows. With k chosen rows that sum to t this is the row
    nearest to (k + 1) m - t, so a bound on the distance of the other rows holds on, less by how far that point moves,
    and one pass gives several picks. Null ids and vectors are left out; every class gives one row at least; ties go
    to the lower id. ``passes`` gets the classes of each pass."""

    def means(rows: DataFrame) -> dict:
        at = rows.select("c", F.posexplode("x").alias("pos", "v")).groupBy("c", "pos").agg(F.avg("v").alias("m"))
        got = at.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("m")).collect()  # one row a class
        return {r["c"]: np.array([m["m"] for m in r["m"]]) for r in got}

    def toward(mean, taken):
        return ((len(taken) + 1) * mean - np.sum(taken, axis=0, initial=0.0) if taken else mean)[None, :]

    def still(value, bound, then, now):
        return np.sqrt(value) * (1 + 1e-9) < np.sqrt(bound) - np.sqrt(((now - then) ** 2).sum())

    return _greedy(df, ident, features, size, by, means, toward, 1, still, held, passes)


def k_center(df: DataFrame, ident: str, features: str, size: int, seed: int = 42, by: str | None = None, held: int | None = None, passes: list | None = None) -> DataFrame:
    """C4: rows that cover the others: from a row drawn by a hash of id and seed, each pick is the row farthest
    from the chosen ones, over all rows. Distances only fall while rows are chosen, so a bound on those of the other
    rows holds on, and one pass gives several picks. Null ids and vectors are left out; ties go to the lower id."""

    def drawn(rows: DataFrame) -> dict:
        got = rows.groupBy("c").agg(F.min_by("id", F.struct(hash_order("id", seed), "id")).alias("i")).collect()  # one row a class
        start = {r["c"]: r["i"] for r in got}
        at = rows.where(F.col("id").isin(list(start.values()))).select("c", "id", "x").collect()
        return {r["c"]: np.array(r["x"]) for r in at if r["id"] == start[r["c"]]}

    def centres(start, taken):
        return np.stack(taken) if taken else start[None, :]

    return _greedy(df, ident, features, size, by, drawn, centres, -1, lambda value, bound, then, now: value < bound, held, passes)


def mean_shift(sample: DataFrame, population: DataFrame, features: str) -> DataFrame:
    """Distance of the sample's mean from the population's."""
    mean = lambda d, n: d.select(F.posexplode(features).alias("pos", "v")).groupBy("pos").agg(F.avg(F.col("v").cast("double")).alias(n))
    j = mean(sample, "a").join(mean(population, "b"), "pos")
    return j.agg(F.sqrt(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")))).alias("mean_shift"))


def spectrum(df: DataFrame, features: str) -> tuple[np.ndarray, int]:
    """Singular values of the centred matrix, from its d x d Gram matrix: partial sums a task, added up in a tree."""
    ship(df.sparkSession)

    def part(batches):
        g, s, n = None, None, 0
        for b in batches:
            x = np.stack([np.asarray(v, float) for v in b["x"]]) if len(b) else None
            if x is not None:
                g, s, n = (x.T @ x if g is None else g + x.T @ x), (x.sum(0) if s is None else s + x.sum(0)), n + len(x)
        if n:
            yield pd.DataFrame({"k": np.arange(g.size + len(s) + 1), "v": np.concatenate([g.ravel(), s, [n]])})

    rows = df.select(F.col(features).cast("array<double>").alias("x")).where("x is not null").mapInPandas(part, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").toPandas()
    if not len(rows):
        return np.empty(0), 0
    v = rows["v"].to_numpy()
    n = v[-1]
    d = int((-1 + np.sqrt(1 + 4 * (len(v) - 1))) / 2)
    g, s = v[: d * d].reshape(d, d), v[d * d : -1]
    eig = np.linalg.eigvalsh(g - np.outer(s, s) / n)[::-1]
    return np.sqrt(np.maximum(eig, 0)), int(n)


def effective_rank(df: DataFrame, features: str) -> float:
    """Exponential of the entropy of the singular values' shares, between 1 and min(n, d)."""
    s, n = spectrum(df, features)
    total = s.sum()
    if not total:
        return 1.0
    p = s[s > 0] / total
    return float(np.clip(np.exp(-(p * np.log(p)).sum()), 1, min(n, len(s))))


def singular_value_distribution(df: DataFrame, features: str) -> DataFrame:
    """Place and share of each singular value."""
    s, _ = spectrum(df, features)
    total = s.sum() or 1.0
    return df.sparkSession.createDataFrame([(i, float(x / total)) for i, x in enumerate(s)], "idx int, share double")


def concentration(df: DataFrame, value: str, eps: float = 1e-12, top: float = 0.1) -> DataFrame:
    """Sum, maximum, smallest value above eps, their ratio, entropy rank and the share of the largest tenth."""
    d = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    a = d.agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.max("v").alias("max"), F.min(F.when(F.col("v") > eps, F.col("v"))).alias("min"), F.sum(F.when(F.col("v") > 0, F.col("v") * F.log("v"))).alias("vlnv"))
    k = F.greatest(F.lit(1), F.ceil(F.col("n") * top)).cast("long")
    c = d.groupBy(F.lit(0).alias("g"), (-F.col("v")).alias("neg")).agg(F.count("*").alias("c"))
    r = cumulative(c, "g", "neg", ["c"]).crossJoin(F.broadcast(a))  # one row
    taken = F.greatest(F.lit(0), F.least(F.col("c"), k - (F.col("cum_c") - F.col("c"))))
    mass = r.agg(F.sum(taken * -F.col("neg")).alias("top"))
    return a.crossJoin(mass).select("total", "max", "min", F.try_divide("max", "min").alias("ratio"), F.exp(F.log("total") - F.try_divide("vlnv", "total")).alias("entropy_rank"), F.try_divide("top", "total").alias("top_share"))


def fisher(df: DataFrame, features: str, probability: str, label: str, ident: str, most: int | None = None) -> DataFrame:
    """Mean squared gradient of a logistic loss by weight; ``most`` keeps a hash-ordered sample."""
    d = df if most is None else df.orderBy(hash_order(ident, 0), ident).limit(most)
    g = (F.col(probability) - F.col(label)) * F.col("x").cast("double")
    return d.select(probability, label, F.posexplode(features).alias("pos", "x")).groupBy("pos").agg(F.avg(g * g).alias("fisher"))


def feature_vectors(df: DataFrame, columns: Sequence[str], model=None) -> DataFrame:
    """Numbers with 0 for null as one vector, or what a fitted preprocessor makes of them."""
    if model is not None:
        return model.transform(df)
    filled = df.withColumns({f"__{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    return VectorAssembler(inputCols=[f"__{c}" for c in columns], outputCol="features").transform(filled).drop(*[f"__{c}" for c in columns])
