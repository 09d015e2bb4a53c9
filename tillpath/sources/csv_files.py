"""CSV tables with a header line.

Quotes inside a field are doubled, spaces are kept, dates are ``yyyy-MM-dd`` and a null is an
empty field. Every column is read as text by its header name, missing-value texts become null,
and the declared type is cast on. What does not fit fails the job: a text of another type, a row with
more or fewer fields than the header, or a file whose header differs from the other files'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpath import schema as S


def whole_number(text: Column, data_type: T.DataType) -> Column:
    """``text`` ready to be cast: a whole number beside nulls is often written as a float ("12.0"); other fractions stay."""
    return F.regexp_replace(text, r"\.0+$", "") if isinstance(data_type, T.IntegralType) else text


def _typed(name: str, data_type: T.DataType) -> Column:
    column = F.col(f"`{name}`")
    text = F.when(~column.isin(*S.NULL_TOKENS), column)
    return whole_number(text, data_type).cast(data_type).alias(name)


def csv_reader(spark: SparkSession, multiline: bool = False) -> DataFrameReader:
    """A reader of files with a header line and doubled quotes."""
    return (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
    )


def read_csv_table(
    spark: SparkSession,
    path: str,
    table: T.StructType,
    multiline: bool = False,
    keep_others: bool = False,
) -> DataFrame:
    """Columns of ``table`` from CSV files, in the table's order whatever the files' order.

    Files without event ids give a table without them; any other missing column is an error.
    ``keep_others`` appends the files' further columns as text. ``multiline`` accepts line breaks
    inside quotes; such files cannot be split between tasks.
    """
    reader = csv_reader(spark, multiline)
    header = reader.csv(path).columns
    names = T.StructType([T.StructField(c, T.StringType()) for c in header])
    text = (
        reader.schema(names)
        .option("enforceSchema", False)  # compares every file's header with the names
        .option("mode", "FAILFAST")
        .option("columnPruning", False)  # else fields of unused columns are not counted
        .csv(path)
    )
    present = [f for f in table.fields if f.name in header or f.name != "event_id"]
    known = {f.name for f in table.fields}
    others = [c for c in header if c not in known] if keep_others else []
    return text.select(
        [_typed(f.name, f.dataType) for f in present]
        + [_typed(c, T.StringType()) for c in others]
    )


def write_csv_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``df`` as CSV files with a header line each."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "")
        .option("emptyValue", "")
        .option("dateFormat", "yyyy-MM-dd")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
