"""Feature transforms (F1-F15). A fitted transform is a small set of numbers; applying it is an expression."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cleaning import numbered
from .quantiles import medians, quantile_lists

# Common English words left out of TF-IDF, service columns, and the edges of hour, weekday and month cycles.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "has", "have", "he", "her", "his", "i", "if", "in", "into", "is", "it", "its", "no", "not", "of", "on", "or", "our", "she", "so", "that", "the", "their", "them", "then", "there", "these", "they", "this", "to", "was", "we", "were", "which", "will", "with", "you", "your")
SERVICES = ("PhoneService", "MultipleLines", "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies")
CYCLES = (("month", 12), ("weekday", 7), ("hour", 24))


def impute(df: DataFrame, columns: Sequence[str], strategy: str) -> DataFrame:
    """median (exact), most_frequent (smallest on a tie), constant (empty text or 0), passthrough, drop."""
    if strategy == "passthrough":
        return df
    if strategy == "drop":
        return df.drop(*columns)
    if strategy == "constant":
        types = dict(df.dtypes)
        return df.fillna({c: "" if types[c] == "string" else 0 for c in columns})
    if strategy == "median":
        return df.fillna(medians(df, columns))
    if strategy != "most_frequent":
        raise ValueError(f"unknown strategy {strategy}")
    return df.fillna(modes(df, columns))


def modes(df: DataFrame, columns: Sequence[str]) -> dict:
    """Each column's commonest value, the least on a tie; counted by value, so no task holds a column's values. Columns of nulls are left out."""
    out = {}
    for c in columns:
        x = F.col(f"`{c}`")
        counts = df.where(x.isNotNull()).groupBy(x.alias("v")).agg(F.count("*").alias("n"))
        r = counts.agg(F.min(F.struct((-F.col("n")).alias("minus"), "v")).alias("x")).first()["x"]
        if r is not None:
            out[c] = r["v"]
    return out


def winsorize(df: DataFrame, name: str, out: str | None = None, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """clip at exact quantiles."""
    c, q = F.col(name), quantile_lists(df, [name], (lower, upper)).get(name)
    return df.withColumn(out or name, F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(q[0])), F.lit(q[1]))) if q else c)


def standard_scale(df: DataFrame, name: str, out: str | None = None) -> DataFrame:
    """(x - mean) / population deviation, 0 where that is 0."""
    s = F.broadcast(df.agg(F.avg(name).alias("__m"), F.stddev_pop(name).alias("__s")))  # one row
    c = F.col(name)
    return df.crossJoin(s).withColumn(out or name, F.when(F.col("__s") == 0, c - F.col("__m")).otherwise(F.try_divide(c - F.col("__m"), F.col("__s")))).drop("__m", "__s")


def yeo_johnson(c: str | Column, lam: float) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    up = F.log1p(x) if abs(lam) < 1e-9 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).when(x < 0, down)


def fit_power(df: DataFrame, name: str, low: float = -3.0, high: float = 5.0, points: int = 33, rounds: int = 3) -> float:
    """the most likely lambda, on a grid that is refined; one aggregate a round evaluates all its points."""
    x = F.col(name).cast("double")
    jac = F.sum(F.signum(x) * F.log1p(F.abs(x)))
    best = 1.0
    for _ in range(rounds):
        grid = [low + (high - low) * k / (points - 1) for k in range(points)]
        row = df.agg(F.count(x).alias("n"), jac.alias("j"), *[F.var_pop(yeo_johnson(x, g)).alias(f"v{k}") for k, g in enumerate(grid)]).first()
        if not row["n"] or any(row[f"v{k}"] is None for k in range(points)):
            return 1.0
        like = [-row["n"] / 2 * math.log(row[f"v{k}"]) + (g - 1) * row["j"] if row[f"v{k}"] > 0 else -math.inf for k, g in enumerate(grid)]
        best = grid[max(range(points), key=like.__getitem__)]
        step = (high - low) / (points - 1)
        low, high = best - step, best + step
    return best


def power_transform(df: DataFrame, name: str, out: str | None = None) -> DataFrame:
    """Yeo-Johnson at the fitted lambda, standardised."""
    return standard_scale(df.withColumn(out or name, yeo_johnson(name, fit_power(df, name))), out or name)


def onehot_categories(df: DataFrame, name: str, most: int = 10, least_share: float = 0.01) -> tuple[list[str], bool]:
    """the kept categories, sorted, and whether others are pooled."""
    counts = df.where(F.col(name).isNotNull()).groupBy(F.col(name).cast("string").alias("v")).agg(F.count("*").alias("n"))
    all_ = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("k")).first()
    rows = counts.where(F.col("n") >= all_["total"] * least_share).orderBy(F.desc("n"), "v").limit(most).collect()  # at most ``most`` rows
    if not rows:
        return [], False
    pooled = all_["k"] > len(rows)
    return sorted(r["v"] for r in (rows[: most - 1] if pooled else rows)), pooled


def onehot(df: DataFrame, name: str, most: int = 10, least_share: float = 0.01) -> DataFrame:
    """a 0/1 column for each kept category, one for the pooled rare ones; values never seen give zeros."""
    kept, pooled = onehot_categories(df, name, most, least_share)
    c = F.col(name).cast("string")
    cols = {f"{name}_{v}": F.coalesce(c == v, F.lit(False)).cast("int") for v in kept}
    if pooled:
        cols[f"{name}_infrequent"] = F.coalesce(~c.isin(*kept) if kept else c.isNotNull(), F.lit(False)).cast("int")
    return df.withColumns(cols).drop(name)


def ordinal(train: DataFrame, df: DataFrame, name: str, out: str) -> DataFrame:
    """rank of the category among the sorted ones of ``train``; -1 for others."""
    ranks = numbered(train.where(F.col(name).isNotNull()).select(F.col(name).alias("__v")).distinct(), ["__v"], "__r")
    return df.join(ranks, F.col(name) == F.col("__v"), "left").withColumn(out, F.coalesce("__r", F.lit(-1)).cast("int")).drop("__v", "__r")


def tokens(c: str | Column) -> Column:
    """Lower-case runs of two or more word characters (ASCII letters, digits, _) that are no stop words."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9_]{2,})"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS))


def tfidf(df: DataFrame, ident: str, text: str, terms: int = 100) -> DataFrame:
    """F8: ident, term, weight: the commonest terms, idf ln((1 + n) / (1 + df)) + 1, rows of unit length."""
    words = df.select(F.col(ident).alias("ident"), F.explode(tokens(text)).alias("term")).groupBy("ident", "term").agg(F.count("*").alias("tf"))
    vocab = words.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).orderBy(F.desc("total"), "term").limit(terms)
    n = df.agg(F.count("*").alias("n"))
    vocab = F.broadcast(vocab.crossJoin(n).select("term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf")))  # at most ``terms`` rows
    w = words.join(vocab, "term").withColumn("w", F.col("tf") * F.col("idf"))
    return w.select("ident", "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("ident")))).alias("weight"))


def cyclical(c: str) -> dict[str, Column]:
    """sine and cosine of month, weekday (Monday 0) and hour; null is 1, 0 and 0."""
    t = F.col(c)
    parts = {"month": F.coalesce(F.month(t), F.lit(1)), "weekday": F.coalesce(F.weekday(t), F.lit(0)), "hour": F.coalesce(F.hour(t), F.lit(0))}
    return {f"{c}_{n}_{f}": getattr(F, f)(parts[n] * (2 * math.pi / k)) for n, k in CYCLES for f in ("sin", "cos")}


def passthrough_or_drop(df: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """F10."""
    return df.drop(*columns) if how == "drop" else df


def feature_pipeline(df: DataFrame, profiles: Sequence[dict], target: str | None = None, aux: Sequence[str] = ()) -> Pipeline:
    """a Spark ML pipeline by roles: columns of one recipe share stages, auxiliary ones pass, nothing left is an error.

    Statistics are exact aggregates of ``df``, written into SQL stages, so the fitted pipeline scores without them.
    """
    use = [p for p in profiles if p["role"] not in ("ID", "IGNORE", "TARGET") and p["column_name"] != target and p["column_name"] in df.columns and not p.get("leakage")]
    num = [p["column_name"] for p in use if p["role"] == "NUMERIC" and p["column_name"] not in aux]
    cat = [p["column_name"] for p in use if p["role"] == "CATEGORICAL" and p["column_name"] not in aux]
    when = [p["column_name"] for p in use if p["role"] == "DATETIME"]
    extra = [a for a in aux if a in df.columns]
    if not (num or cat or when or extra):
        raise ValueError("no feature columns")
    stages, inputs = [], []
    if num:
        q = quantile_lists(df, num, (0.5, 0.01, 0.99))
        fills = [(c, *q.get(c, (0.0, 0.0, 0.0))) for c in num]
        clip = [f"least(greatest(coalesce(cast(`{c}` as double), {m!r}D), {lo!r}D), {hi!r}D)" for c, m, lo, hi in fills]
        s = df.agg(*[x for i, e in enumerate(clip) for x in (F.avg(F.expr(e)).alias(f"m{i}"), F.stddev_pop(F.expr(e)).alias(f"s{i}"))]).first()
        cols = [f"({e} - {s[f'm{i}'] or 0.0!r}D) / {(s[f's{i}'] or 1.0)!r}D as `{c}__n`" for i, (c, e) in enumerate(zip(num, clip))]
        stages.append(SQLTransformer(statement=f"select *, {', '.join(cols)} from __THIS__"))
        inputs += [f"{c}__n" for c in num]
    if cat:
        stages.append(SQLTransformer(statement="select *, " + ", ".join(f"coalesce(cast(`{c}` as string), '') as `{c}__s`" for c in cat) + " from __THIS__"))
        stages.append(StringIndexer(inputCols=[f"{c}__s" for c in cat], outputCols=[f"{c}__i" for c in cat], handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"{c}__i" for c in cat], outputCols=[f"{c}__o" for c in cat], handleInvalid="keep"))
        inputs += [f"{c}__o" for c in cat]
    for c in when:
        parts = {"month": f"coalesce(month(`{c}`), 1)", "weekday": f"coalesce(weekday(`{c}`), 0)", "hour": f"coalesce(hour(`{c}`), 0)"}
        cols = [f"{f}({parts[n]} * {2 * math.pi / k!r}D) as `{c}__{n}_{f}`" for n, k in CYCLES for f in ("sin", "cos")]
        stages.append(SQLTransformer(statement=f"select *, {', '.join(cols)} from __THIS__"))
        inputs += [f"{c}__{n}_{f}" for n, _ in CYCLES for f in ("sin", "cos")]
    if extra:
        stages.append(SQLTransformer(statement="select *, " + ", ".join(f"coalesce(cast(`{c}` as double), 0D) as `{c}__a`" for c in extra) + " from __THIS__"))
        inputs += [f"{c}__a" for c in extra]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=stages)


def telco_features(df: DataFrame, monthly="MonthlyCharges", total="TotalCharges", tenure="tenure", services: Sequence[str] = SERVICES) -> DataFrame:
    """charge a month of tenure, total against expected total, number of services (when three columns are there)."""
    m, t, n = F.col(monthly), F.col(total), F.col(tenure)
    df = df.withColumns({"charge_per_tenure": m / (n + 1), "total_to_expected": t / (m * n + 1)})
    there = [s for s in services if s in df.columns]
    if len(there) >= 3:
        df = df.withColumn("service_count", sum(F.coalesce((F.lower(F.col(s)) == "yes").cast("int"), F.lit(0)) for s in there))
    return df


def bank_features(df: DataFrame, balance="Balance", salary="EstimatedSalary", products="NumOfProducts", tenure="Tenure", score="CreditScore", age="Age", active="IsActiveMember") -> DataFrame:
    """F13."""
    c = F.col
    return df.withColumns({"balance_to_salary": c(balance) / (c(salary) + 1), "products_per_tenure": c(products) / (c(tenure) + 1), "score_to_age": c(score) / (c(age) + 1), "active_by_age": c(active) * c(age)})


def generic_features(df: DataFrame, numeric: Sequence[str], target: str, top: int = 5, max_pairs: int = 5) -> DataFrame:
    """ratios of pairs among the numbers that correlate most with the target, and log1p(abs) of each."""
    row = df.agg(*[F.abs(F.corr(F.col(c).cast("double"), F.col(target).cast("double"))).alias(c) for c in numeric]).first()
    best = sorted(numeric, key=lambda c: (-(row[c] if row[c] is not None and row[c] == row[c] else 0.0), c))[:top]
    pairs = [(a, b) for i, a in enumerate(best) for b in best[i + 1 :]][:max_pairs]
    cols = {f"{a}_div_{b}": F.col(a) / (F.abs(F.col(b)) + 1e-6) for a, b in pairs}
    return df.withColumns(cols | {f"{c}_log": F.log1p(F.abs(F.col(c))) for c in best})


def table_hash(df: DataFrame) -> DataFrame:
    """a digest that does not depend on the order of the rows."""
    s = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(F.struct("*")).cast("decimal(38,0)")), F.lit(0)).alias("s"))
    return s.select(F.md5(F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string"))).alias("table_hash"), F.col("n").alias("rows"))
