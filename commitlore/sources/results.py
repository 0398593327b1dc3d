"""Writing the result tables of an analysis."""

from pyspark.sql import DataFrame, functions as F, types as T


def _plain(df: DataFrame, flat: bool) -> DataFrame:
    """Vectors as arrays; for CSV nested columns as JSON text."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import VectorUDT

    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, VectorUDT):
            c = vector_to_array(c)
            nested = True
        else:
            nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        out.append((F.to_json(c) if flat and nested else c).alias(f.name))
    return df.select(*out)


def write_results(results: dict, path: str, file_format: str = "json") -> list[str]:
    """One directory per table, in `json`, `csv` or `parquet`; nested dicts become sub-directories.

    Entries that are no tables (a skipped step, a number) are gathered in `_values`.
    """
    written, values, session = [], [], None
    for name, item in results.items():
        if isinstance(item, dict):
            written += write_results(item, f"{path}/{name}", file_format)
        elif isinstance(item, DataFrame):
            session = item.sparkSession
            table = _plain(item, file_format == "csv")
            writer = table.write.mode("overwrite")
            if file_format == "csv":
                writer = writer.option("header", True)
            writer.format(file_format).save(f"{path}/{name}")
            written.append(f"{path}/{name}")
        elif item is not None:
            values.append((name, str(item)))
    if values and session is not None:
        session.createDataFrame(values, "name string, value string").write.mode("overwrite").json(f"{path}/_values")
        written.append(f"{path}/_values")
    return written
