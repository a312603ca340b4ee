"""Column expressions shared by all operators."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerovigil.constants import LABEL_CODES, RAW_LABELS

EPS = 1e-9


def finite(c: Column) -> Column:
    """Null for NaN and infinities, the value otherwise. NaN sorts above infinity, so one test does."""
    return F.when(F.abs(c) < float("inf"), c)


def to_number(c: Column, fill: float | None = 0.0) -> Column:
    """Parse anything into a finite double; unusable input becomes ``fill``."""
    value = finite(c.try_cast("double"))
    return value if fill is None else F.coalesce(value, F.lit(float(fill)))


def with_default(df: DataFrame, name: str, default) -> Column:
    """The column when the frame has it, a literal when it does not."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(default)


def require_columns(df: DataFrame, names: list[str]) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"missing required columns: {absent}")


def guarded_ratio(a: Column, b: Column, fill: float = 0.0, upper: float | None = None) -> Column:
    """a / (b + 1e-9); null and non-finite results become ``fill``; optional upper clip."""
    ratio = F.coalesce(finite(a / (b + F.lit(EPS))), F.lit(float(fill)))
    return ratio if upper is None else F.least(ratio, F.lit(float(upper)))


def bounded(c: Column, lo: float | None, hi: float | None) -> Column:
    """Clip to [lo, hi] for input that is never null; the input is evaluated once."""
    out = c if lo is None else F.greatest(c, F.lit(float(lo)))
    return out if hi is None else F.least(out, F.lit(float(hi)))


def clip(c: Column, lo: float | None, hi: float | None) -> Column:
    """Clip to [lo, hi]; null stays null."""
    return F.when(c.isNotNull(), bounded(c, lo, hi))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.when(condition, 1).otherwise(0)


def as_double(condition: Column) -> Column:
    return flag(condition).cast("double")


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def any_of(conditions: list[Column]) -> Column:
    """True when a condition holds; unknown counts as not holding."""
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions], F.lit(False))


def weighted(terms: list[tuple[float, Column]]) -> Column:
    return total([F.lit(w) * c for w, c in terms])


def names_where(pairs: list[tuple[str, Column]]) -> Column:
    """Array of the names whose condition holds, in the order given."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs]))


def decision(rules: list[tuple[Column, object]], default) -> Column:
    """First matching rule wins."""
    out = F
    for condition, value in rules:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(default))


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def normalise_label(raw: Column) -> Column:
    """Free-text label to one of normal, jamming, dos, ddos, suspicious."""
    key = F.translate(F.lower(F.trim(raw)), " -", "__")
    out = F
    for label, spellings in RAW_LABELS.items():
        out = out.when(key.isin(spellings), F.lit(label))
    return out.otherwise(F.lit("suspicious"))


def collection_point(label: Column) -> Column:
    return (F.when(label == "jamming", F.lit("edge"))
            .when(label.isin("dos", "ddos"), F.lit("gcc"))
            .otherwise(F.lit("edge_gcc")))


def label_code(label: Column, unknown: int) -> Column:
    return F.coalesce(F.element_at(literal_map(LABEL_CODES), label), F.lit(unknown))


def epoch_to_timestamp(seconds: Column) -> Column:
    return F.timestamp_micros((seconds * F.lit(1e6)).cast("bigint"))


def bucket_start(ts: Column, seconds: float) -> Column:
    """Start of the bucket, as epoch microseconds."""
    width = int(round(seconds * 1_000_000))
    micros = F.unix_micros(ts.cast("timestamp"))
    return micros - F.pmod(micros, F.lit(width))


def bucket_middle(start_micros: Column, seconds: float) -> Column:
    return F.timestamp_micros(start_micros + F.lit(int(round(seconds * 500_000))))
