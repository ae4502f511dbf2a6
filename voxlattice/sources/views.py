"""Node, measurement and voxel views over the test tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid nodes, 10 by 10 by N/100, step 8 voxels, with a validity flag and a dense field f."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("node_id"),
        (k % 10).alias("ix"),
        (F.expr("o_orderkey div 10") % 10).alias("iy"),
        F.expr("o_orderkey div 100").alias("iz"),
        (F.lit(20.0) + 8 * (k % 10)).alias("x"),
        (F.lit(24.0) + 8 * (F.expr("o_orderkey div 10") % 10)).alias("y"),
        (F.lit(28.0) + 8 * F.expr("o_orderkey div 100")).alias("z"),
        (F.col("o_orderstatus") != "P").alias("node_valid"),
        (F.col("o_totalprice") / 1e5).alias("f"),
    )


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displacement, correlation and status of nodes by frame; some cells are missing."""
    flag = F.max("l_returnflag")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("node_id"), (F.col("l_linenumber") - 1).cast("long").alias("frame"))
        .agg(
            (F.avg("l_quantity") / 10).alias("u"),
            (F.avg("l_discount") * 10).alias("v"),
            (F.avg("l_tax") * 10).alias("w"),
            (1 - F.avg("l_discount")).alias("zncc"),
            F.when(flag == "A", 0).when(flag == "N", 0).otherwise(1).cast("long").alias("status"),
            (F.min("l_linestatus") == "O").alias("outlier"),
        )
    )


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey values of a volume of 4x4x4 bricks, 8 by 8 bricks a layer, with a mask."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"), (F.col("label") > 0).alias("m"))
    return e.select(
        "vec_id",
        (F.expr("vec_id div 64") * 4 + F.expr("i div 16")).alias("z"),
        ((F.expr("vec_id div 8") % 8) * 4 + F.expr("i div 4") % 4).alias("y"),
        ((F.col("vec_id") % 8) * 4 + F.col("i") % 4).alias("x"),
        F.col("v").cast("double").alias("v"),
        "m",
    )


SQL = {
    "lat": """SELECT o_orderkey AS node_id, o_orderkey % 10 AS ix, (o_orderkey // 10) % 10 AS iy, o_orderkey // 100 AS iz,
        CAST(20 + 8 * (o_orderkey % 10) AS DOUBLE) AS x, CAST(24 + 8 * ((o_orderkey // 10) % 10) AS DOUBLE) AS y,
        CAST(28 + 8 * (o_orderkey // 100) AS DOUBLE) AS z, o_orderstatus <> 'P' AS node_valid, o_totalprice / 1e5 AS f FROM orders""",
    "meas": """SELECT l_orderkey AS node_id, CAST(l_linenumber - 1 AS BIGINT) AS frame, avg(l_quantity) / 10 AS u, avg(l_discount) * 10 AS v,
        avg(l_tax) * 10 AS w, 1 - avg(l_discount) AS zncc, CAST(CASE max(l_returnflag) WHEN 'A' THEN 0 WHEN 'N' THEN 0 ELSE 1 END AS BIGINT) AS status,
        min(l_linestatus) = 'O' AS outlier FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "vox": """SELECT vec_id, (vec_id // 64) * 4 + i // 16 AS z, ((vec_id // 8) % 8) * 4 + (i // 4) % 4 AS y, (vec_id % 8) * 4 + i % 4 AS x,
        CAST(embedding[i + 1] AS DOUBLE) AS v, label > 0 AS m FROM embeddings, range(64) t(i)""",
}
