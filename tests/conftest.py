import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("oddsmith-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="module", autouse=True)
def own_cache(spark):
    """Tables that one module caches must not show in the plans of the next."""
    yield
    spark.catalog.clearCache()


HISTORY_SCHEMA = """race_id string, date_text string, venue_code string, distance int,
 surface string, track_condition string, race_name string, race_class string, horse_number int,
 horse_name string, jockey_name string, odds double, popularity int, finish_position int,
 running_time string, final_600m_time double, handicap double, sex string, age int,
 weight int, weight_change int"""

_DEFAULT = {
    "race_id": "1", "date_text": "2024/01/01", "venue_code": "06", "distance": 1200,
    "surface": "芝", "track_condition": "良", "race_name": "X", "race_class": "3勝クラス",
    "horse_number": 1, "horse_name": "A", "jockey_name": "J", "odds": 4.0, "popularity": 1,
    "finish_position": 1, "running_time": "1:10.0", "final_600m_time": 35.0, "handicap": 55.0,
    "sex": "牡", "age": 4, "weight": 480, "weight_change": 0,
}


@pytest.fixture(scope="session")
def make_history(spark):
    """Result rows from dictionaries; columns not given get a default."""

    def make(*rows):
        columns = list(_DEFAULT)
        order = [part.strip().split(" ")[0] for part in HISTORY_SCHEMA.split(",")]
        assert sorted(order) == sorted(columns)
        return spark.createDataFrame(
            [tuple({**_DEFAULT, **row}[c] for c in order) for row in rows], HISTORY_SCHEMA
        )

    return make
