"""Column naming, projections, filters, cleaning expressions and binning.

Nothing here runs a job except where a statistic of the data is needed (bin edges, medians, caps); those
are one exact aggregate each, cross-joined as a single row or folded in as literals.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stable
from . import quantiles
from .quantiles import quantile_lists

# Aliases of the customer columns, canonical category names and flag words.
ALIASES = {
    "CustomerID": ("Customer ID", "customer_id", "customerid"),
    "SeniorCitizen": ("Senior Citizen",),
    "PhoneService": ("Phone Service",),
    "InternetService": ("Internet Service",),
    "MonthlyCharges": ("Monthly Charges",),
    "TotalCharges": ("Total Charges",),
    "Churn": ("Churn Value", "Churn Label"),
}
RENAMES = {
    "Customer ID": "CustomerID",
    "Senior Citizen": "SeniorCitizen",
    "Phone Service": "PhoneService",
    "Internet Service": "InternetService",
    "Monthly Charges": "MonthlyCharges",
    "Total Charges": "TotalCharges",
    "Churn Value": "Churn",
}
CATEGORIES = {"no": "No", "dsl": "DSL", "fiber optic": "Fiber Optic", "cable": "Cable"}
FLAGS = {"Yes": 1, "No": 0, "Male": 1, "Female": 0}
TRUE_WORDS = ("yes", "y", "true", "1", "churned")
ID_NAMES = ("customerid", "customer_id", "id", "record_id", "uuid")
TENURE_EDGES = (-1, 6, 12, 24, 48, 96)


def resolve_column(df: DataFrame, name: str, aliases: dict[str, Sequence[str]] = ALIASES) -> str | None:
    """The column itself, else an alias of it in either direction, else None."""
    if name in df.columns:
        return name
    for canonical, others in aliases.items():
        family = (canonical, *others)
        if name in family:
            return next((x for x in family if x in df.columns), None)
    return None


def canonical_names(df: DataFrame, renames: dict[str, str] = RENAMES) -> DataFrame:
    """Fixed renames; names that are absent, or whose target exists already, are left."""
    return df.withColumnsRenamed({a: b for a, b in renames.items() if a in df.columns and b not in df.columns})


def normalised_names(df: DataFrame) -> DataFrame:
    """Strip, lower-case, no blanks; two columns of one name are an error."""
    names = [re.sub(r"\s+", "", c.strip().lower()) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"columns collide: {sorted({n for n in names if names.count(n) > 1})}")
    return df.toDF(*names)


def is_string(df: DataFrame, name: str) -> bool:
    return dict(df.dtypes)[name] == "string"


def yes_no(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """P4: 'Yes' is 1, anything else 0, in string columns only."""
    return df.withColumns({c: (F.coalesce(F.col(f"`{c}`") == "Yes", F.lit(False))).cast("int") for c in columns if is_string(df, c)})


def canonical_category(c: str | Column, names: dict[str, str] = CATEGORIES) -> Column:
    """P5: look up the trimmed lower-case text, else title case."""
    col = F.col(f"`{c}`") if isinstance(c, str) else c
    key = F.lower(F.trim(col))
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.initcap(F.trim(col)))


def to_number(c: str | Column) -> Column:
    """Number in a text, null where there is none; NaN is null."""
    col = F.col(f"`{c}`") if isinstance(c, str) else c
    d = F.trim(col.cast("string")).try_cast("double")
    return F.when(~F.isnan(d), d)


def convert_types(df: DataFrame, numeric: Sequence[str] = ("TotalCharges", "MonthlyCharges", "tenure")) -> DataFrame:
    """Coerce to double, bad values to null; unresolved names are ignored."""
    found = [x for x in (resolve_column(df, c) for c in numeric) if x]
    return df.withColumns({c: to_number(c) for c in found})


def drop_invalid_rows(df: DataFrame, subset: Sequence[str] = ("TotalCharges",)) -> DataFrame:
    """Rows that are null in a resolved column go; unresolved names are ignored."""
    found = [x for x in (resolve_column(df, c) for c in subset) if x]
    return df.dropna(subset=found) if found else df


def map_booleans(df: DataFrame, columns: Sequence[str] = ("Partner", "Senior Citizen", "Dependents", "Gender"), flags: dict[str, int] = FLAGS) -> DataFrame:
    """Flag words to 1 and 0, other words to null; numeric columns stay."""
    table = F.create_map(*[F.lit(x) for kv in flags.items() for x in kv])
    found = [x for x in (resolve_column(df, c) for c in columns) if x and is_string(df, x)]
    return df.withColumns({c: F.try_element_at(table, F.col(f"`{c}`")) for c in found})


def coalesce_target(df: DataFrame, out: str = "churn") -> DataFrame:
    """The first of churn value, churn label, churn that exists, as 0 or 1; null is 0. Names are normalised ones."""
    name = next((c for c in ("churnvalue", "churnlabel", "churn") if c in df.columns), None)
    if name is None:
        return df
    if is_string(df, name):
        v = F.when(F.lower(F.trim(name)).isin(*TRUE_WORDS), 1).otherwise(0)
    else:
        v = F.coalesce(F.col(name).cast("int"), F.lit(0))
    return df.withColumn(out, v.cast("int"))


def required_columns(df: DataFrame, doubles=("totalcharges", "monthlycharges"), ints=("tenure",), ident="customerid", keep=("customer_id", "tenure", "monthlycharges", "totalcharges", "churn")) -> DataFrame:
    """P10: numbers with 0 for missing, id renamed, and the existing ones of the kept columns."""
    cols = {c: F.coalesce(to_number(c), F.lit(0.0)) for c in doubles if c in df.columns}
    cols |= {c: F.coalesce(to_number(c), F.lit(0.0)).cast("int") for c in ints if c in df.columns}
    df = df.withColumns(cols)
    if ident in df.columns and "customer_id" not in df.columns:
        df = df.withColumnRenamed(ident, "customer_id")
    return df.select(*[c for c in keep if c in df.columns])


def column_subset(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """P11."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def rows_where_equal(df: DataFrame, name: str, *values) -> DataFrame:
    """One value, or any of several."""
    c = F.col(f"`{name}`")
    return df.where(c == values[0] if len(values) == 1 else c.isin(*values))


def trim_strings(df: DataFrame) -> DataFrame:
    """Every string column trimmed, every column name stripped."""
    df = df.withColumns({c: F.trim(F.col(f"`{c}`")) for c, t in df.dtypes if t == "string"})
    return df.toDF(*[c.strip() for c in df.columns])


def cap_outliers(df: DataFrame, name: str, k: float = 1.5) -> DataFrame:
    """Clip to the quartiles -/+ k times their distance; exact quartiles."""
    found = quantile_lists(df, [name], (0.25, 0.75))
    if not found:
        return df
    lo, hi = found[name]
    c = F.col(name)
    return df.withColumn(name, F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo - k * (hi - lo))), F.lit(hi + k * (hi - lo)))))


def log_transform(c: str) -> Column:
    """P15."""
    return F.log1p(F.col(c))


def guarded_ratio(a: str, b: str) -> Column:
    """A / b with 0 in b taken as 1."""
    return F.col(a) / F.when(F.col(b) == 0, 1).otherwise(F.col(b))


def fill_nulls(df: DataFrame, medians: Sequence[str] = (), constants: dict[str, object] | None = None, blanks: dict[str, object] | None = None) -> DataFrame:
    """The exact median, or a constant. ``blanks`` names, by column, a value that is filled like a null; the median counts it."""
    found = quantiles.medians(df, medians) if medians else {}
    if blanks:
        df = df.withColumns({c: F.nullif(F.col(f"`{c}`"), F.lit(v)) for c, v in blanks.items()})
    if found:
        df = df.fillna(found)
    return df.fillna(constants) if constants else df


def duplicate_rows(df: DataFrame, subset: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(frame without duplicates, one row with the number of rows beyond the first of each)."""
    keys = [F.col(f"`{c}`") for c in (subset or df.columns)]
    n = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))
    return df.dropDuplicates(list(subset) if subset else None), n


def drop_target_like(df: DataFrame, target: str | None = None) -> DataFrame:
    """The target and every column whose name has 'churn' in it."""
    return df.drop(*[c for c in df.columns if c == target or "churn" in c.lower()])


def id_column(df: DataFrame, order_by: Sequence[str] | None = None, names: Sequence[str] = ID_NAMES) -> tuple[DataFrame, str]:
    """P20: the first column with an id's name; else a numbering of the rows in a declared order.

    The fall-back numbers range-partitioned rows by a prefix sum of the partitions' sizes, so it never
    gathers the table in one task.
    """
    for c in df.columns:
        if c.lower() in names:
            return df, c
    if not order_by:
        raise ValueError("no id column: name the columns that order the rows")
    return numbered(df, order_by, "row_index"), "row_index"


def numbered(df: DataFrame, order_by: Sequence[str], name: str) -> DataFrame:
    """Rows numbered from 0 in the given order, by two levels of counts."""
    from pyspark.sql import Window

    parts = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    # The upper 31 bits of the id are the partition, the lower 33 the place in it.
    at = stable(parts.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = at.groupBy(part.alias("__p")).agg(F.count("*").alias("n"))
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("__p", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("__before"))
    return at.withColumn("__p", part).join(before, "__p").withColumn(name, F.col("__before") + F.col("__id").bitwiseAND(F.lit(2**33 - 1))).drop("__p", "__before", "__id")


def feature_columns(profiles: DataFrame, ids: Sequence[str] = (), target: str | None = None) -> list[str]:
    """Names whose role is a feature's; one row a column, so it is small."""
    rows = profiles.where(~F.col("role").isin("ID", "TARGET", "IGNORE")).select("column_name").collect()
    return [r[0] for r in rows if r[0] not in ids and r[0] != target]


def dummies(df: DataFrame, name: str, drop_first: bool = True, most: int = 1000) -> DataFrame:
    """A 0/1 column for each sorted value but the first; more than ``most`` values are an error."""
    values = [r[0] for r in df.select(name).where(F.col(name).isNotNull()).distinct().orderBy(name).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{name} has more than {most} values")
    return df.withColumns({f"{name}_{v}": (F.coalesce(F.col(name) == F.lit(v), F.lit(False))).cast("int") for v in values[1 if drop_first else 0 :]}).drop(name)


def safe_filename(c: str | Column) -> Column:
    """Base name with ``_`` for what is no word character, ``-``, ``_`` or ``.``, the stem cut at 100 characters."""
    base = F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"[^A-Za-z0-9_.\-]", "_")
    ext = F.regexp_extract(base, r"(\.[^.]*)$", 1)
    stem = F.substring(base, F.lit(1), F.length(base) - F.length(ext))
    return F.concat(F.substring(stem, 1, 100), ext)


def min_max(df: DataFrame, name: str, out: str) -> DataFrame:
    """(x - min) / (max - min), null when all are equal."""
    r = F.broadcast(df.agg(F.min(name).alias("__lo"), F.max(name).alias("__hi")))  # one row
    return df.crossJoin(r).withColumn(out, F.try_divide(F.col(name) - F.col("__lo"), F.col("__hi") - F.col("__lo"))).drop("__lo", "__hi")


# Binning. Labels: ``bin_lo``, ``bin_hi`` true edges, ``bin_idx`` from 0, and a text.


def fixed_bins(c: str | Column, edges: Sequence[float] = TENURE_EDGES) -> Column:
    """B1: index of the right-closed bin, the first one closed on the left too; null outside."""
    x = F.col(c) if isinstance(c, str) else c
    out = F.when(x == edges[0], 0)
    for i, hi in enumerate(edges[1:]):
        out = out.when((x > edges[i]) & (x <= hi), i)
    return out


def quantile_edges(df: DataFrame, name: str, q: int = 4) -> list[float]:
    """Distinct exact quantiles (linear interpolation); empty when there are fewer distinct values than bins."""
    r = quantiles.quantiles(df, [name], [k / q for k in range(q + 1)]).first()
    return sorted(set(r["q"])) if r is not None and r["distinct"] >= q else []


def quantile_bins(df: DataFrame, name: str, out: str, q: int = 4, fill: str | float | None = None) -> DataFrame:
    """Equal-frequency bins; ``fill`` is 'median' or a number put for nulls first."""
    x = F.col(name)
    if fill == "median":
        m = quantiles.medians(df, [name]).get(name)
        x = F.coalesce(x, F.lit(m)) if m is not None else x
    elif fill is not None:
        x = F.coalesce(x, F.lit(fill).cast("double"))
    df = df.withColumn("__x", x.cast("double"))
    edges = quantile_edges(df, "__x", q)
    idx = fixed_bins("__x", edges) if len(edges) > 1 else F.lit(None).cast("int")
    return df.withColumn(out, idx).drop("__x")


def bin_label(idx: str | Column, edges: Sequence[float]) -> Column:
    """Text of a bin with its true edges."""
    i = F.col(idx) if isinstance(idx, str) else idx
    out = F.lit(None).cast("string")
    for k in range(len(edges) - 2, -1, -1):
        out = F.when(i == k, F.lit(f"{'[' if k == 0 else '('}{edges[k]:g}, {edges[k + 1]:g}]")).otherwise(out)
    return out


def create_features(df: DataFrame) -> DataFrame:
    """B1-B3 as the cleaning pipeline applies them: tenure, monthly charge and lifetime value bins where those columns are."""
    t, m, v = (resolve_column(df, c) for c in ("tenure", "MonthlyCharges", "CLTV"))
    if t:
        df = df.withColumn("tenure_bin", bin_label(fixed_bins(t), TENURE_EDGES))
    for name, out, fill in ((m, "monthly_bin", None), (v, "cltv_bin", "median")):
        if name:
            df = quantile_bins(df, name, out, 4, fill).withColumn(out, F.col(out).cast("string"))
    return df
