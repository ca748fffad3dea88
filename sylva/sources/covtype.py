"""One-hot table ingest (S2, S3): headerless CSV of integers -> typed table
with the one-hot soil flags decoded to a description.

The file is read by Spark's CSV reader with a fixed schema (no driver-side
parsing, no inference). A gzip file is one split, so the rows are spread over
the cluster before any further work. Exactly one soil flag must be set in each
row; a row with none or several is rejected (an error by default, or split off
into a reject table). :func:`ingest_with_rejects` keeps malformed lines as well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cells import spread

# The public column names of the table.
MEASUREMENTS = ["Elevation", "Aspect", "Slope", "Horizontal_Distance_To_Hydrology", "Vertical_Distance_To_Hydrology",
                "Horizontal_Distance_To_Roadways", "Hillshade_9am", "Hillshade_Noon", "Hillshade_3pm",
                "Horizontal_Distance_To_Fire_Points"]
WILDERNESS = [f"Wilderness_Area_{i}" for i in range(1, 5)]
SOIL = [f"Soil_Type_{i}" for i in range(1, 41)]
CLASS = "Cover_Type"
COLUMNS = MEASUREMENTS + WILDERNESS + SOIL + [CLASS]
DESCRIPTION = "Soil_Description"

# The 40 soil type descriptions, in soil type order 1..40.
SOIL_TYPES = [
    "Cathedral family - Rock outcrop complex, extremely stony.",
    "Vanet - Ratake families complex, very stony.",
    "Haploborolis - Rock outcrop complex, rubbly.",
    "Ratake family - Rock outcrop complex, rubbly.",
    "Vanet family - Rock outcrop complex complex, rubbly.",
    "Vanet - Wetmore families - Rock outcrop complex, stony.",
    "Gothic family.",
    "Supervisor - Limber families complex.",
    "Troutville family, very stony.",
    "Bullwark - Catamount families - Rock outcrop complex, rubbly.",
    "Bullwark - Catamount families - Rock land complex, rubbly.",
    "Legault family - Rock land complex, stony.",
    "Catamount family - Rock land - Bullwark family complex, rubbly.",
    "Pachic Argiborolis - Aquolis complex.",
    "unspecified in the USFS Soil and ELU Survey.",
    "Cryaquolis - Cryoborolis complex.",
    "Gateview family - Cryaquolis complex.",
    "Rogert family, very stony.",
    "Typic Cryaquolis - Borohemists complex.",
    "Typic Cryaquepts - Typic Cryaquolls complex.",
    "Typic Cryaquolls - Leighcan family, till substratum complex.",
    "Leighcan family, till substratum, extremely bouldery.",
    "Leighcan family, till substratum - Typic Cryaquolls complex.",
    "Leighcan family, extremely stony.",
    "Leighcan family, warm, extremely stony.",
    "Granile - Catamount families complex, very stony.",
    "Leighcan family, warm - Rock outcrop complex, extremely stony.",
    "Leighcan family - Rock outcrop complex, extremely stony.",
    "Como - Legault families complex, extremely stony.",
    "Como family - Rock land - Legault family complex, extremely stony.",
    "Leighcan - Catamount families complex, extremely stony.",
    "Catamount family - Rock outcrop - Leighcan family complex, extremely stony.",
    "Leighcan - Catamount families - Rock outcrop complex, extremely stony.",
    "Cryorthents - Rock land complex, extremely stony.",
    "Cryumbrepts - Rock outcrop - Cryaquepts complex.",
    "Bross family - Rock land - Cryumbrepts complex, extremely stony.",
    "Rock outcrop - Cryumbrepts - Cryorthents complex, extremely stony.",
    "Leighcan - Moran families - Cryaquolls complex, extremely stony.",
    "Moran family - Cryorthents - Leighcan family complex, extremely stony.",
    "Moran family - Cryorthents - Rock land complex, extremely stony.",
]

RAW_SCHEMA = T.StructType([T.StructField(c, T.IntegerType(), True) for c in COLUMNS])


def read_onehot_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """Headerless comma-separated integers with a fixed schema; malformed
    lines fail the read (FAILFAST) instead of turning into NULLs."""
    df = spark.read.schema(schema).option("header", False).option("mode", "FAILFAST").csv(path)
    return spread(df)


def _hot_count(flags: list[str]):
    """How many flags equal 1; other values and NULL are not hot."""
    return F.size(F.filter(F.array(*[F.col(c) for c in flags]), lambda x: x == 1))


def decode_onehot(df: DataFrame, flags: list[str] = SOIL, names: list[str] = SOIL_TYPES,
                  out: str = DESCRIPTION, on_bad: str = "error") -> DataFrame | tuple[DataFrame, DataFrame]:
    """S3: the description of the one flag that equals 1. A row is bad if it hasn't
    exactly one, or if any of its fields is NULL (empty). ``on_bad``: ``error`` raises
    on a bad row, whichever columns are read later; ``split`` returns ``(good, rejected)``."""
    hot = _hot_count(flags)
    pos = F.array_position(F.array(*[F.col(c) for c in flags]), 1).cast("int")
    desc = F.get(F.array(*[F.lit(n) for n in names]), pos - 1)
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in df.columns])
    if on_bad == "error":
        # In a filter: a column could be pruned, and the check with it.
        checked = F.when((hot == 1) & whole, F.lit(True)).otherwise(F.raise_error(F.concat(
            F.lit("row must have no empty field and exactly one hot flag, has "), hot.cast("string"))).cast("boolean"))
        return df.filter(checked).withColumn(out, desc)
    if on_bad == "split":
        right = (hot == 1) & whole
        return df.filter(right).withColumn(out, desc), df.filter(~right).withColumn("hot_flags", hot)
    raise ValueError(f"unknown on_bad {on_bad}")


#: Why a line is rejected; accepted rows have no reason.
MALFORMED, EMPTY_FIELD, HOT_FLAGS = "malformed", "empty field", "hot flags"


def ingest_with_rejects(spark: SparkSession, csv_path: str, parquet_path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """S2 + S3 + S4 + S5 in one job: (accepted rows, rejected ones, their numbers).

    A line that isn't a row of integers is kept as its text (``line``), a row with an empty field or without exactly one
    hot flag as its columns; both with a ``reason``. Both sides are written together, apart by a
    partition of the table, and counted by the same write (observed metrics); no row accepted is an error."""
    raw = (spark.read.schema(T.StructType([*RAW_SCHEMA.fields, T.StructField("line", T.StringType())]))
           .option("header", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "line").csv(csv_path))
    empty = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in COLUMNS])
    reason = (F.when(F.col("line").isNotNull(), MALFORMED).when(empty, EMPTY_FIELD).when(_hot_count(SOIL) != 1, HOT_FLAGS))
    pos = F.array_position(F.array(*[F.col(c) for c in SOIL]), 1).cast("int")
    rows = raw.withColumn("reason", reason).withColumn(
        DESCRIPTION, F.when(F.col("reason").isNull(), F.get(F.array(*[F.lit(n) for n in SOIL_TYPES]), pos - 1)))
    seen = Observation()
    rows.withColumn("accepted", F.col("reason").isNull()).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count("reason").alias("rejected")).write.mode("overwrite").partitionBy("accepted").parquet(parquet_path)
    counts = {"rows": seen.get["rows"], "rejected": seen.get["rejected"], "accepted": seen.get["rows"] - seen.get["rejected"]}
    if not counts["accepted"]:
        raise ValueError(f"the ingested table has no rows ({counts['rejected']} rejected)")
    table = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("accepted", T.BooleanType())])).parquet(parquet_path)
    good = table.filter("accepted").select(*[F.coalesce(f.name, F.lit("" if isinstance(f.dataType, T.StringType) else 0)).alias(f.name)
                                             for f in final_schema()])
    return good, table.filter(~F.col("accepted")).drop("accepted", DESCRIPTION), counts


def final_schema() -> T.StructType:
    """all 56 columns non-NULL."""
    return T.StructType([T.StructField(c, T.IntegerType(), False) for c in COLUMNS]
                        + [T.StructField(DESCRIPTION, T.StringType(), False)])


def ingest(spark: SparkSession, csv_path: str, parquet_path: str | None = None) -> DataFrame:
    """S2 + S3 (+ S4 when ``parquet_path`` is given): the decoded table."""
    from .parquet import require_rows, write_read_parquet
    table = decode_onehot(read_onehot_csv(spark, csv_path))
    # No field is NULL any more: coalesce only declares that.
    table = table.select(*[F.coalesce(f.name, F.lit("" if isinstance(f.dataType, T.StringType) else 0)).alias(f.name)
                           for f in final_schema()])
    if parquet_path is not None:
        table = write_read_parquet(table, parquet_path)
    return require_rows(table, "ingested table")
