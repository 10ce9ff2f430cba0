"""Writers."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from hitlens.functions.fields import numeric


def _without_nan(value: Column, kind: T.DataType) -> Column | None:
    """The value with null for every NaN in it; None if its type can't hold one."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value), value)
    if isinstance(kind, T.ArrayType):
        if _without_nan(F.lit(None), kind.elementType) is None:
            return None
        return F.transform(value, lambda x: _without_nan(x, kind.elementType))
    if isinstance(kind, T.MapType):
        # JSON has names for keys, so a NaN may stay there
        if _without_nan(F.lit(None), kind.valueType) is None:
            return None
        return F.transform_values(value, lambda _, x: _without_nan(x, kind.valueType))
    if isinstance(kind, T.StructType):
        inner = {f.name: _without_nan(value.getField(f.name), f.dataType) for f in kind.fields}
        if all(c is None for c in inner.values()):
            return None
        fields = [(value.getField(n) if c is None else c).alias(n) for n, c in inner.items()]
        return F.when(value.isNotNull(), F.struct(*fields))
    return None


def nan_to_null(df: DataFrame) -> DataFrame:
    """JSON has no NaN: replace it by null, in arrays, map values and structs of any depth too."""
    out = {f.name: _without_nan(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}
    return df.select(*[F.col(f"`{n}`") if c is None else c.alias(n) for n, c in out.items()])


def write_report(report: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """One JSON folder per section of a report, NaN as null."""
    for section, frame in report.items():
        (nan_to_null(frame).write.mode(mode).option("ignoreNullFields", False)
         .json(f"{path.rstrip('/')}/{section}"))


def write_logs(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Standardised logs as Parquet by day, so that later scans prune days and columns.

    Status, bytes and response time become numbers, null where unreadable. The rebalance
    gathers a day into few files and splits a busy day over several tasks.
    """
    numbers = {n: numeric(df, n) for n in ("status", "bytes", "response_time") if n in df.columns}
    (df.withColumns({**numbers, "date": F.to_date("datetime")})
     .hint("rebalance", "date")
     .write.mode(mode).partitionBy("date").parquet(path))
