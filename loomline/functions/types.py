"""The fifteen column types: their Spark types, what values they take and how those are stored.

A literal belongs to a family, and a comparison needs both sides in one family: whole numbers,
floating numbers, text, and each of boolean, date, time and timestamp.  DECIMAL columns take whole
and floating literals.
"""

from __future__ import annotations

import datetime as dt
import math
import struct
from dataclasses import dataclass
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.errors import CodecError

# Type names, by family, and the ranges of whole numbers.
FAMILY = {
    "SMALLINT": "int", "INT": "int", "INTEGER": "int", "BIGINT": "int",
    "FLOAT": "float", "REAL": "float", "DOUBLE": "float",
    "DECIMAL": "decimal",
    "TEXT": "text", "VARCHAR": "text", "CHAR": "text",
    "BOOL": "bool", "BOOLEAN": "bool",
    "DATE": "date", "TIME": "time", "TIMESTAMP": "timestamp",
}
BITS = {"SMALLINT": 16, "INT": 32, "INTEGER": 32, "BIGINT": 64}

_SPARK = {
    "SMALLINT": T.ShortType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "BIGINT": T.LongType(),
    "FLOAT": T.FloatType(), "REAL": T.FloatType(), "DOUBLE": T.DoubleType(),
    "BOOL": T.BooleanType(), "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(), "TIME": T.IntegerType(), "TIMESTAMP": T.TimestampNTZType(),
}

_OF_SPARK = {
    T.ByteType: "SMALLINT", T.ShortType: "SMALLINT", T.IntegerType: "INT", T.LongType: "BIGINT", T.FloatType: "FLOAT", T.DoubleType: "DOUBLE",
    T.StringType: "TEXT", T.BooleanType: "BOOL", T.DateType: "DATE", T.TimestampNTZType: "TIMESTAMP", T.TimestampType: "TIMESTAMP",
}


def literal_type(value: object) -> str:
    """The type name of a literal's Python value."""
    for kind, name in ((bool, "BOOL"), (int, "INT"), (float, "DOUBLE"), (str, "TEXT"), (dt.datetime, "TIMESTAMP"), (dt.date, "DATE"), (dt.time, "TIME")):
        if isinstance(value, kind):
            return name
    raise TypeError(f"unknown literal type: {type(value).__name__}")


@dataclass(frozen=True)
class SqlType:
    name: str
    params: tuple[int, ...] = ()

    def __str__(self) -> str:
        return f"{self.name}({', '.join(map(str, self.params))})" if self.params else self.name

    @property
    def family(self) -> str:
        return FAMILY.get(self.name, "other")

    @staticmethod
    def checked(name: str, params: tuple[int, ...]) -> SqlType:
        """The type, or ``ValueError`` with what is wrong with its parameters."""
        if name == "DECIMAL":
            if len(params) != 2:
                raise ValueError("DECIMAL requires (p, s)")
            p, s = params
            if not 1 <= p <= 18:
                raise ValueError(f"DECIMAL precision must be 1..18, got {p}")
            if not 0 <= s < p:
                raise ValueError(f"DECIMAL scale must be 0..{p - 1}, got {s}")
        elif name in ("VARCHAR", "CHAR"):
            if len(params) != 1 or params[0] < 1:
                raise ValueError(f"{name} requires (N)")
        elif params:
            raise ValueError(f"type {name} takes no parameters")
        return SqlType(name, params)

    @staticmethod
    def of_spark(kind: T.DataType) -> SqlType:
        """The type of a Parquet column; what the dialect has no type for is named as in Spark, in small letters."""
        if isinstance(kind, T.DecimalType) and kind.precision <= 18 and kind.scale < kind.precision:
            return SqlType("DECIMAL", (kind.precision, kind.scale))
        return SqlType(_OF_SPARK.get(type(kind)) or kind.simpleString())

    def spark(self) -> T.DataType:
        if self.family == "other":
            return T.DataType.fromDDL(self.name)
        return T.DecimalType(*self.params) if self.name == "DECIMAL" else _SPARK.get(self.name, T.StringType())

    def stored(self, value: object) -> object:
        """The value as it is kept, or ``CodecError``: rounded, padded and truncated as the type says."""
        if value is None:
            return None
        return getattr(self, f"_stored_{self.family}")(value)

    def _expect(self, ok: bool, what: str, value: object) -> None:
        if not ok:
            raise CodecError(f"expected {what} for {self.name}, got {type(value).__name__}")

    def _stored_int(self, value):
        self._expect(isinstance(value, int) and not isinstance(value, bool), "int", value)
        limit = 1 << BITS[self.name] - 1
        if not -limit <= value < limit:
            raise CodecError(f"{self.name} out of range: {value}")
        return value

    def _stored_float(self, value):
        self._expect(isinstance(value, float), "float", value)
        if not math.isfinite(value):
            raise CodecError(f"{self.name} inf/NaN not allowed: {value!r}")
        if self.name == "DOUBLE":
            return value
        try:
            return struct.unpack("<f", struct.pack("<f", value))[0]
        except OverflowError as error:
            raise CodecError(f"{self.name} out of range: {value}") from error

    def _stored_decimal(self, value):
        self._expect(isinstance(value, (int, float)) and not isinstance(value, bool), "number", value)
        p, s = self.params
        # The range is checked before rounding; rounding is half-even on the product, as floats are.
        if not math.isfinite(value) or abs(value) >= 10 ** (p - s):
            raise CodecError(f"DECIMAL({p},{s}) value {value} out of range")
        scaled = Decimal(round(value * 10**s)).scaleb(-s)
        return scaled.quantize(Decimal(1).scaleb(-s), rounding=ROUND_HALF_EVEN)

    def _stored_text(self, value):
        self._expect(isinstance(value, str), "str", value)
        if self.name == "TEXT":
            return value
        size, most = len(value.encode("utf-8")), self.params[0]
        if size > most:
            raise CodecError(f"{self.name}({most}) length {size} exceeds max")
        return value + " " * (most - size) if self.name == "CHAR" else value

    def _stored_bool(self, value):
        self._expect(isinstance(value, bool), "bool", value)
        return value

    def _stored_date(self, value):
        self._expect(isinstance(value, dt.date) and not isinstance(value, dt.datetime), "date", value)
        return value

    def _stored_time(self, value):
        """Seconds of the day."""
        self._expect(isinstance(value, dt.time), "time", value)
        return value.hour * 3600 + value.minute * 60 + value.second

    def _stored_timestamp(self, value):
        self._expect(isinstance(value, dt.datetime), "datetime", value)
        return value.replace(microsecond=0, tzinfo=None)

    def shown(self, value: object) -> object:
        """The Python value that a result row has for a stored one."""
        if value is None:
            return None
        if self.name == "DECIMAL":
            return float(value)
        if self.name == "TIME":
            return dt.time(value // 3600, value // 60 % 60, value % 60)
        return value

    def literal(self, value: object, strict: bool = False) -> Column:
        """A literal to compare a column of this type with, in stored form, or ``TypeError``."""
        given = literal_type(value)
        if strict and given != self.name:
            raise TypeError(f"type mismatch: {self} vs {given}")
        family = FAMILY[given]
        if family != self.family and not (self.family == "decimal" and family in ("int", "float")):
            raise TypeError(f"type mismatch: {self} vs {given}")
        if self.family == "int":  # values beyond the column's range compare, they just never match
            return F.lit(SqlType("BIGINT").stored(value)).cast("long")
        if self.family == "decimal":
            try:
                return F.lit(self.stored(value)).cast(self.spark())
            except CodecError:
                return F.lit(float(value))
        if self.family == "text":
            return F.lit(value + " " * (self.params[0] - len(value.encode("utf-8"))) if self.name == "CHAR" else value)
        stored = self.stored(value)
        return F.lit(stored.isoformat(sep=" ")).cast("timestamp_ntz") if self.family == "timestamp" else F.lit(stored).cast(self.spark())


def result_type(kind: T.DataType) -> SqlType:
    """The type by which a computed column's values are shown."""
    if isinstance(kind, T.DecimalType):
        return SqlType("DECIMAL", (kind.precision, kind.scale))
    return SqlType.of_spark(kind)
