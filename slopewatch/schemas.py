"""Row types of the main tables and the row-level checks that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEASURE = T.StructType(
    [T.StructField("scale", T.DoubleType()), T.StructField("offset", T.DoubleType())]
)

OBSERVATION = T.StructType(
    [
        T.StructField("contract_version", T.StringType()),
        T.StructField("thing_id", T.StringType()),
        T.StructField("observed_property", T.StringType()),
        T.StructField("phenomenon_time", T.StringType()),
        T.StructField("result_value", T.DoubleType()),
        T.StructField("result_unit", T.StringType()),
        T.StructField("raw_value", T.DoubleType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("_bad", T.StringType()),
    ]
)

HOURLY_WEATHER = T.StructType(
    [
        T.StructField(
            "hourly",
            T.StructType(
                [
                    T.StructField("time", T.ArrayType(T.StringType())),
                    T.StructField("precipitation", T.ArrayType(T.DoubleType())),
                    T.StructField("soil_moisture_0_to_7cm", T.ArrayType(T.DoubleType())),
                    T.StructField("soil_moisture_7_to_28cm", T.ArrayType(T.DoubleType())),
                    T.StructField("snowfall", T.ArrayType(T.DoubleType())),
                    T.StructField("snow_depth", T.ArrayType(T.DoubleType())),
                    T.StructField("wave_height", T.ArrayType(T.DoubleType())),
                ]
            ),
        ),
        T.StructField(
            "daily",
            T.StructType(
                [
                    T.StructField("precipitation_sum", T.ArrayType(T.DoubleType())),
                    T.StructField("river_discharge", T.ArrayType(T.DoubleType())),
                ]
            ),
        ),
    ]
)

CELLS = T.StructType(
    [
        T.StructField("cell_id", T.StringType(), False),
        T.StructField("aoi_id", T.StringType(), False),
        T.StructField("row_idx", T.IntegerType()),
        T.StructField("col_idx", T.IntegerType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("area_km2", T.DoubleType()),
    ]
)


def validate(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split into good rows and rejects; a reject lists the rules it breaks."""
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    )
    marked = df.withColumn("_broken", broken)
    good = marked.filter(F.size("_broken") == 0).drop("_broken")
    rejects = marked.filter(F.size("_broken") > 0)
    return good, rejects
