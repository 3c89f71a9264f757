"""Reading the tables of a dataset folder, and the condition-monitoring view of its event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNELS = ("click", "error", "purchase", "signup", "view")
TRAIN_END = "2024-01-21"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scada(spark: SparkSession, sf_dir: str, slot: str = "hour") -> DataFrame:
    """One row per farm and time slot: case_key, ts, row_id, status_type_id, train_test and one column per channel.

    A channel is the mean value of an event type; it is missing where the slot has no such event. The status is 3
    from two errors on, 2 for one, else 0. Aggregation combines before its one shuffle.
    """
    events = table(spark, sf_dir, "events").select("ts", "user_id", "event_type", "value")
    farm = F.concat(F.lit("Wind Farm "), F.element_at(F.array(*map(F.lit, "ABC")), (F.col("user_id") % 3 + 1).cast("int")))
    means = [F.round(F.avg(F.when(F.col("event_type") == c, F.col("value"))), 6).alias(c) for c in CHANNELS]
    errors = F.count_if(F.col("event_type") == "error")
    status = F.when(errors >= 2, 3).when(errors == 1, 2).otherwise(0)
    return (
        events.groupBy(farm.alias("case_key"), F.date_trunc(slot, "ts").cast("timestamp_ntz").alias("ts"))
        .agg(status.alias("status_type_id"), *means)
        .withColumn("train_test", F.when(F.col("ts") < F.to_timestamp_ntz(F.lit(TRAIN_END)), "train").otherwise("prediction"))
    )


#: The same view in SQL, for the oracles: a common table expression named scada.
SCADA_SQL = f"""scada AS (
  SELECT 'Wind Farm ' || ['A','B','C'][user_id % 3 + 1] AS case_key, slot AS ts,
         CASE WHEN count(*) FILTER (event_type = 'error') >= 2 THEN 3 WHEN count(*) FILTER (event_type = 'error') = 1 THEN 2 ELSE 0 END AS status_type_id,
         {", ".join(f"round(avg(value) FILTER (event_type = '{c}'), 6) AS {c}" for c in CHANNELS)},
         CASE WHEN slot < TIMESTAMP '{TRAIN_END}' THEN 'train' ELSE 'prediction' END AS train_test
  FROM (SELECT *, date_trunc('hour', ts)::TIMESTAMP AS slot FROM events) GROUP BY 1, 2)"""
