"""Fact types and ingestion: Arrow, dicts of lists, rows, DataFrames; strict about nulls, widths and decimals."""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESERVED = "handle"
_PLAIN = {"long": T.LongType(), "i64": T.LongType(), "int": T.LongType(), "double": T.DoubleType(), "f64": T.DoubleType(), "String": T.StringType(), "string": T.StringType(), "boolean": T.BooleanType(), "bool": T.BooleanType()}
_HINTS = {int: "long", float: "double", str: "string", bool: "boolean", "int": "long", "float": "double", "str": "string", "bool": "boolean"}


class IngestError(ValueError):
    """Input that does not fit its fact type."""


def spark_type(name: str) -> T.DataType:
    if name in _PLAIN:
        return _PLAIN[name]
    if m := re.fullmatch(r"decimal\((\d+),\s*(\d+)\)", name):
        p, s = int(m[1]), int(m[2])
        if not (1 <= p <= 38 and 0 <= s <= p):
            raise IngestError(f"{name}: precision 1 to 38, scale 0 to precision")
        return T.DecimalType(p, s)
    raise IngestError(f"no field type {name}")


@dataclass(frozen=True)
class FactType:
    """An ordered set of flat, typed fields; events name their timestamp and maybe a duration (milliseconds)."""

    name: str
    fields: tuple[tuple[str, str, bool], ...]  # name, type, nullable
    timestamp: str | None = None
    duration: str | None = None
    expires_ms: int | None = None

    def __post_init__(self):
        names = [f[0] for f in self.fields]
        if RESERVED in names:
            raise IngestError(f"{RESERVED} is reserved")
        if len(set(names)) != len(names) or len(names) > 64:
            raise IngestError(f"{self.name}: repeated fields or more than 64")

    @property
    def names(self) -> list[str]:
        return [f[0] for f in self.fields]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, spark_type(t), True) for n, t, _ in self.fields])

    def nullable(self, name: str) -> bool:
        return next(f[2] for f in self.fields if f[0] == name)

    def kind(self, name: str) -> T.DataType:
        return next((spark_type(f[1]) for f in self.fields if f[0] == name))


def fact_type(name: str, timestamp: str | None = None, duration: str | None = None, expires_ms: int | None = None, **fields: str) -> FactType:
    """``fact_type("T", a="long", b="string?")``: a question mark allows nulls."""
    return FactType(name, tuple((k, v.rstrip("?"), v.endswith("?")) for k, v in fields.items()), timestamp, duration, expires_ms)


def fact(cls=None, **event_options):
    """Class decorator: annotated fields become a fact type (``__fact__``) of a dataclass.

    Hints: int, float, str, bool, ``X | None``, or a type name as a string ("decimal(10,2)").
    """

    def make(c):
        fields = []
        for name, hint in c.__annotations__.items():
            text = hint if isinstance(hint, str) else None
            optional = False
            if text and text.endswith("| None"):
                text, optional = text[: -len("| None")].strip(), True
            if not text and hasattr(hint, "__args__") and type(None) in hint.__args__:
                hint, optional = next(a for a in hint.__args__ if a is not type(None)), True
            fields.append((name, _HINTS.get(text or hint) or text or hint.__name__, optional))
        c = dataclasses.dataclass(c)
        c.__fact__ = FactType(c.__name__, tuple(fields), **event_options)
        return c

    return make(cls) if cls else make


def event(timestamp: str, duration: str | None = None, expires_ms: int | None = None):
    """Class decorator of an event type."""
    return fact(timestamp=timestamp, duration=duration, expires_ms=expires_ms)


def infer(name: str, df: DataFrame) -> FactType:
    """The type of a first table: fields of supported types, not nullable."""
    fields = []
    for f in df.schema:
        if f.name in (RESERVED,):
            raise IngestError(f"{RESERVED} is reserved")
        t = f.dataType
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            fields.append((f.name, "long", False))
        elif isinstance(t, (T.FloatType, T.DoubleType)):
            fields.append((f.name, "double", False))
        elif isinstance(t, T.StringType):
            fields.append((f.name, "string", False))
        elif isinstance(t, T.BooleanType):
            fields.append((f.name, "boolean", False))
        elif isinstance(t, T.DecimalType):
            fields.append((f.name, t.simpleString(), False))
        else:
            raise IngestError(f"column {f.name}: no fact field of type {t.simpleString()}")
    return FactType(name, tuple(fields))


def to_frame(spark: SparkSession, data: Any, kind: FactType | None = None) -> DataFrame:
    """A DataFrame of Arrow data, pandas, a dict of lists, or rows (dicts, fact objects, tuples)."""
    if isinstance(data, DataFrame):
        return data
    if hasattr(data, "__arrow_c_stream__"):
        import pyarrow as pa

        return spark.createDataFrame(pa.table(data))
    if hasattr(data, "columns") and hasattr(data, "iloc"):
        return spark.createDataFrame(data)
    if isinstance(data, dict):
        sizes = {len(v) for v in data.values()}
        if len(sizes) > 1:
            raise IngestError("columns of different lengths")
        data = [dict(zip(data, row)) for row in zip(*data.values())]
    rows = [_row(x) for x in data]
    if kind is None:
        if not rows:
            raise IngestError("an empty table needs a declared type")
        return spark.createDataFrame(rows)
    for r in rows:
        unknown = set(r) - set(kind.names)
        missing = [n for n in kind.names if n not in r and not kind.nullable(n)]
        if unknown or missing:
            raise IngestError(f"{kind.name}: unknown fields {sorted(unknown)}, missing fields {missing}")
    return spark.createDataFrame([tuple(_value(r.get(n), kind.kind(n)) for n in kind.names) for r in rows], kind.schema)


def _row(x: Any) -> dict:
    if isinstance(x, dict):
        return x
    if hasattr(x, "asDict"):
        return x.asDict()
    if dataclasses.is_dataclass(x):
        return {f.name: getattr(x, f.name) for f in dataclasses.fields(x)}
    return dict(vars(x))


def _value(v: Any, kind: T.DataType) -> Any:
    if v is None:
        return None
    if isinstance(kind, T.DoubleType) and isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    if isinstance(kind, T.DecimalType):
        if isinstance(v, float):
            raise IngestError("a float is no exact decimal; pass a string or Decimal")
        return Decimal(v)
    return v


def conform(df: DataFrame, kind: FactType, check: bool = True) -> DataFrame:
    """Columns in order and widened; nulls in fields that allow none are an error that names them."""
    missing = [n for n in kind.names if n not in df.columns and not kind.nullable(n)]
    unknown = [c for c in df.columns if c not in kind.names]
    if missing or unknown:
        raise IngestError(f"{kind.name}: missing columns {missing}, unknown columns {unknown}")
    have = {f.name: f.dataType for f in df.schema}
    out = []
    for name, _, nullable in kind.fields:
        want = kind.kind(name)
        if name not in have:
            out.append(F.lit(None).cast(want).alias(name))
            continue
        c, got = F.col(f"`{name}`"), have[name]
        if isinstance(want, T.DecimalType) and isinstance(got, (T.FloatType, T.DoubleType)):
            raise IngestError(f"{kind.name}.{name}: a float column is no exact decimal")
        whole = isinstance(got, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        number = whole or isinstance(got, (T.FloatType, T.DoubleType))
        fits = (
            isinstance(want, T.LongType) and whole
            or isinstance(want, T.DoubleType) and number
            or isinstance(want, T.DecimalType) and (whole or isinstance(got, T.DecimalType))
            or type(want) is type(got)
        )
        if not fits:
            raise IngestError(f"{kind.name}.{name}: {got.simpleString()} does not fit {want.simpleString()}")
        if isinstance(want, T.DoubleType) and nullable:
            c = F.when(~F.isnan(c), c)  # NaN in a nullable field is a missing value
        out.append(c.cast(want).alias(name))
    df = df.select(*out)
    strict = [n for n, _, nullable in kind.fields if not nullable]
    if check and strict:
        counts = df.agg(*(F.sum(F.when(F.col(f"`{n}`").isNull(), 1)).alias(n) for n in strict)).first().asDict()
        bad = {n: c for n, c in counts.items() if c}
        if bad:
            raise IngestError(f"{kind.name}: nulls in {', '.join(f'{n} ({c})' for n, c in bad.items())}")
    return df


@dataclass
class Table:
    """A result: a DataFrame with other forms on demand."""

    frame: DataFrame
    order: list[str] = field(default_factory=list)

    def _sorted(self) -> DataFrame:
        return self.frame.orderBy(*self.order) if self.order else self.frame

    def to_arrow(self): return self._sorted().toArrow()  # noqa: E704
    def to_pandas(self): return self._sorted().toPandas()  # noqa: E704
    def to_pylist(self) -> list[dict]: return [r.asDict() for r in self._sorted().collect()]  # noqa: E704
    def __len__(self) -> int: return self.frame.count()  # noqa: E704
    def __arrow_c_stream__(self, requested=None): return self.to_arrow().__arrow_c_stream__(requested)  # noqa: E704

    def to_parquet(self, path: str, mode: str = "errorifexists") -> None:
        """Written by the executors; nothing comes to the driver."""
        self.frame.write.mode(mode).parquet(path)

    def to_polars(self):
        import polars

        return polars.from_arrow(self.to_arrow())


def epoch_ms(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Timestamps as epoch milliseconds, the form that events take."""
    return df.withColumns({c: F.unix_millis(F.col(c).cast("timestamp")) for c in columns})
