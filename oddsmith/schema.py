"""Explicit schemas of the input tables, so that no reader has to infer them."""

from pyspark.sql import types as T

RACE = T.StructType(
    [
        T.StructField("race_id", T.StringType()),
        T.StructField("date_text", T.StringType()),
        T.StructField("venue_code", T.StringType()),
        T.StructField("distance", T.IntegerType()),
        T.StructField("surface", T.StringType()),
        T.StructField("track_condition", T.StringType()),
        T.StructField("race_name", T.StringType()),
        T.StructField("race_class", T.StringType()),
        T.StructField("horse_id", T.LongType()),
        T.StructField("jockey_id", T.LongType()),
        T.StructField("horse_number", T.IntegerType()),
        T.StructField("handicap", T.DoubleType()),
        T.StructField("sex", T.StringType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("odds", T.DoubleType()),
        T.StructField("popularity", T.IntegerType()),
        T.StructField("finish_position", T.IntegerType()),
        T.StructField("running_time", T.StringType()),
        T.StructField("final_600m_time", T.DoubleType()),
        T.StructField("weight", T.IntegerType()),
        T.StructField("weight_change", T.IntegerType()),
    ]
)

NAMED = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])

WEIGHTS = T.StructType(
    [
        T.StructField("horse_name", T.StringType()),
        T.StructField("weight", T.IntegerType()),
        T.StructField("weight_change", T.IntegerType()),
    ]
)

ACTUAL_ODDS = T.StructType(
    [T.StructField("horse_number", T.IntegerType()), T.StructField("actual_odds", T.DoubleType())]
)
