"""Sources: tables and streams, envelopes, wire formats, evolved and mixed schemas, and incremental reads.

A record envelope has the columns key, value, partition, offset and timestamp. Kafka gives them where its package is
installed; a landed copy in files has them as plain columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tables(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream_files(spark: SparkSession, folder: str, schema, files_per_batch: int | None = None, fmt: str = "parquet") -> DataFrame:
    """A stream over the files of a folder from the first on; run it with ``availableNow`` for a bounded read."""
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(folder)


def kafka(spark: SparkSession, servers: str, topic: str, stream: bool = True, starting: str = "earliest", min_partitions: int | None = None, **options: str) -> DataFrame:
    """A topic as envelopes; needs Spark's Kafka package. ``min_partitions`` reads a partition with several tasks."""
    reader = (spark.readStream if stream else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting)
    if min_partitions:
        reader = reader.option("minPartitions", min_partitions)
    return reader.options(**options).load()


def from_offset(envelopes: DataFrame, partition: int, offset: int) -> DataFrame:
    """One partition from one offset on; both conditions reach the scan."""
    return envelopes.filter((F.col("partition") == partition) & (F.col("offset") >= offset))


def with_file_metadata(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("file_time"))


def upserted(envelopes: DataFrame, key: Sequence[str], order: Sequence[str], deleted: Column) -> DataFrame:
    """An upsert source: the last row of each key, without keys whose last row is a delete."""
    from ..operators.relational import latest

    return latest(envelopes, list(key), order, deleted)


def decode_json(df: DataFrame, value: str, schema, keep: Sequence[str] = (), errors: str = "_corrupt") -> DataFrame:
    """JSON values as columns; what cannot be read is kept in ``errors``."""
    full = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField(errors, T.StringType())]) if isinstance(schema, str) else T.StructType([*schema.fields, T.StructField(errors, T.StringType())])
    parsed = F.from_json(F.col(value).cast("string"), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": errors})
    return df.select(*keep, parsed.alias("_v")).select(*keep, "_v.*")


def with_key_fields(df: DataFrame, key: str, value: str, key_names: Sequence[str], include_in_value: bool) -> DataFrame:
    """Fields of a key struct and a value struct; if the value has the key's fields too, those win."""
    types = df.schema[value].dataType.names
    rest = [F.col(f"{value}.{n}") for n in types if include_in_value or n not in key_names]
    own = [] if include_in_value else [F.col(f"{key}.{n}") for n in key_names]
    return df.select(*own, *rest)


def integer_from_bytes(data: Column, size: int) -> Column:
    """A big-endian signed number of 4 or 8 bytes; null for any other length."""
    raw = F.conv(F.hex(data), 16, 10).cast("decimal(20,0)")
    half = F.lit(str(2 ** (8 * size - 1))).cast("decimal(20,0)")
    signed = F.when(raw >= half, raw - half - half).otherwise(raw)
    return F.when(F.octet_length(data) == size, signed.cast("int" if size == 4 else "long"))


def wire_format(df: DataFrame, value: str) -> DataFrame:
    """Split framed values: one zero byte, a 4-byte schema id, the body. Another first byte, or under 5 bytes: both null."""
    framed = (F.hex(F.substring(value, 1, 1)) == "00") & (F.octet_length(value) >= 5)
    return df.withColumn("schema_id", F.when(framed, F.conv(F.hex(F.substring(value, 2, 4)), 16, 10).cast("int"))).withColumn("body", F.when(framed, F.expr(f"substring({value}, 6)")))


def frame(schema_id: Column, body: Column) -> Column:
    """The inverse of ``wire_format``."""
    return F.concat(F.unhex(F.lit("00")), F.unhex(F.lpad(F.hex(schema_id.cast("long")), 8, "0")), body)


def evolved_union(versions: Sequence[DataFrame], casts: Mapping[str, str], defaults: Mapping[str, object]) -> DataFrame:
    """Rows of several schema versions together: missing columns appear, types widen, nulls get their default."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [v.withColumns({c: F.col(c).cast(t) for c, t in casts.items() if c in v.columns}) for v in versions])
    return both.withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in defaults.items()})


def variants(df: DataFrame, kind: str, schemas: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """One frame for each event type of a mixed topic: struct columns of nullable variants, chosen by a discriminator."""
    return {name: df.filter(F.col(kind) == name).select(*columns) for name, columns in schemas.items()}


def incrementing_jdbc(spark: SparkSession, url: str, table: str, column: str, last: int, upper: int | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """Rows of a table whose ``column`` is above ``last``, read by ranges of it."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"(SELECT * FROM {table} WHERE {column} > {int(last)}) t").options(**options)
    if upper is not None:
        reader = reader.option("partitionColumn", column).option("lowerBound", int(last) + 1).option("upperBound", int(upper)).option("numPartitions", partitions)
    return reader.load()


def after(df: DataFrame, column: str, last) -> DataFrame:
    """The incremental read on a DataFrame: rows beyond the last value seen."""
    return df.filter(F.col(column) > F.lit(last))


def key_from_column(df: DataFrame, column: str, remove: bool = True) -> DataFrame:
    """Copy a field to the key, take it out of the struct, and by choice out of the value: (key, value struct)."""
    rest = [c for c in df.columns if not (remove and c == column)]
    return df.select(F.col(column).alias("key"), F.struct(*rest).alias("value"))


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)
