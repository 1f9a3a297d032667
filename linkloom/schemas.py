"""Explicit schemas of the data model."""

from pyspark.sql import types as T

# D1: raw item object (only the keys that are read; every key but id/time optional).
ITEM_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("by", T.StringType()),
    T.StructField("time", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("descendants", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("text", T.StringType()),
])

# D2: post row, 10 columns in this order.
POST_COLUMNS = ["id", "type", "by", "time_unix", "time_iso", "title", "score", "descendants", "url", "text"]
POST_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("by", T.StringType()),
    T.StructField("time_unix", T.LongType()),
    T.StructField("time_iso", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("descendants", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("text", T.StringType()),
])

# All-string view of the same file for the tolerant reader (SRC7).
POST_TEXT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in POST_COLUMNS])

# D14: chart point.
POINT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("cluster", T.IntegerType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
])

BOUNDS_TYPE = T.StructType([
    T.StructField("x_min", T.DoubleType()),
    T.StructField("x_max", T.DoubleType()),
    T.StructField("y_min", T.DoubleType()),
    T.StructField("y_max", T.DoubleType()),
])

# D16: manifest.
MANIFEST_SCHEMA = T.StructType([
    T.StructField("bounds", BOUNDS_TYPE),
    T.StructField("grid_size", T.IntegerType()),
    T.StructField("total_points", T.LongType()),
    T.StructField("num_clusters", T.IntegerType()),
    T.StructField("clusters", T.ArrayType(T.StructType([
        T.StructField("id", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("count", T.LongType()),
    ]))),
    T.StructField("chunks", T.ArrayType(T.StructType([
        T.StructField("file", T.StringType()),
        T.StructField("bounds", BOUNDS_TYPE),
        T.StructField("count", T.LongType()),
    ]))),
])
