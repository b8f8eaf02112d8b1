"""Small input frames for the tests."""


def rows_of(spark, values, ddl="wkt string"):
    return spark.createDataFrame([(v,) for v in values], ddl)
