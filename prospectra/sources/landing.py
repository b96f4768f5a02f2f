"""Reading landed CSV files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospectra.functions.values import column
from prospectra.sources import multiline


def read_csv(spark: SparkSession, path: str | list[str], sep: str = ";", types: T.StructType | None = None,
             multi_line: bool = False) -> DataFrame:
    """Read quoted CSV with a header and normalised column names.

    With ``types`` only the header line is looked at before the read and the
    named columns are cast afterwards (a value that does not fit is NULL);
    without it types are inferred in one extra pass over the files.

    Files are split over tasks, so a line break ends a row.  ``multi_line``
    allows line breaks inside quotes; files are still split over tasks, and
    records are found by the parity of quotes (see ``multiline``), which asks
    for well-formed files.
    """
    if multi_line:
        df = normalize_columns(_read_records(spark, path, sep))
        return infer_columns(df) if types is None else cast_columns(df, {f.name: f.dataType for f in types.fields})
    options = {**_OPTIONS, "header": True, "sep": sep, "inferSchema": types is None}
    df = normalize_columns(spark.read.options(**options).csv(path))
    return df if types is None else cast_columns(df, {f.name: f.dataType for f in types.fields})


_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def _read_records(spark: SparkSession, path: str | list[str], sep: str) -> DataFrame:
    """All columns as text.  Records are cut by ``multiline``, their fields by Spark's own parser."""
    header = spark.read.options(**_OPTIONS, header=True, sep=sep, multiLine=True).csv(path)
    rows = multiline.records(spark, path).where(~F.col("first"))
    options = {**_OPTIONS, "sep": sep, "multiLine": "true", "lineSep": "\n"}
    fields = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header.columns))])
    parsed = rows.select(F.from_csv("record", fields.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "),
                                    options).alias("r"))
    return parsed.select("r.*").toDF(*header.columns)


# From the narrowest type to the widest; what fits none stays text.
_INFERRED = (T.IntegerType(), T.LongType(), T.DoubleType(), T.DateType(), T.TimestampType(), T.BooleanType())


def infer_columns(df: DataFrame) -> DataFrame:
    """Text columns cast to the first type that all their present values fit, in one pass over the table.

    A column without any value stays text.
    """
    def fits(name: str) -> list[Column]:
        value = column(name)
        # A cast to date would drop a time of day.
        longer = F.length(F.trim(value)) > len("yyyy-mm-dd")
        return [F.count_if(value.isNotNull() & (value.try_cast(kind).isNull() | (longer if kind == T.DateType() else F.lit(False))))
                for kind in _INFERRED]

    found = df.agg(F.array(*[F.struct(F.count(column(c)).alias("n"), F.array(*fits(c)).alias("misfits")) for c in df.columns])
                   .alias("found")).first().found
    types = {c: next((kind for kind, misfits in zip(_INFERRED, f.misfits) if f.n and not misfits), T.StringType())
             for c, f in zip(df.columns, found)}
    return cast_columns(df, types)


def normal_name(name: str) -> str:
    return "_".join(name.strip().lower().split(" "))


def normalize_columns(df: DataFrame) -> DataFrame:
    """Names trimmed, lower-cased, blanks to underscores; raises where two would be equal."""
    names = [normal_name(c) for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"columns have the same name once normalised: {', '.join(clashes)}")
    return df.toDF(*names)


def misfits(raw: DataFrame, types: T.StructType) -> DataFrame:
    """(column_name, misfits): how many present values of each typed column do not fit, in one pass.

    ``raw`` is the landed table as text, before ``cast_columns``.
    """
    named = [f for f in types.fields if f.name in raw.columns]
    counts = raw.agg(F.array(*[F.count_if(column(f.name).isNotNull() & column(f.name).try_cast(f.dataType).isNull())
                               for f in named]).alias("n"))
    names = F.array(*[F.lit(f.name) for f in named])
    return counts.select(F.posexplode("n").alias("pos", "misfits")).select(F.get(names, F.col("pos")).alias("column_name"), "misfits")


def cast_columns(df: DataFrame, types: Mapping[str, T.DataType]) -> DataFrame:
    """Cast the named columns; values that do not fit become NULL."""
    return df.select(*[column(c).try_cast(types[c]).alias(c) if c in types else column(c) for c in df.columns])
