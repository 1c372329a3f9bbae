import math

from pyspark.sql import functions as F

from gridproof.operators.aggregators import leading_bits


def test_values_just_under_a_power_of_two_keep_their_digits(spark):
    values = [7.999999999999998, 8.0, 15.99999999999999, 1023.999999999999, 2.0**29, 0.49999999999999978, -7.999999999999998, 1.7e308, math.inf]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(leading_bits(F.col("v"), 7)).collect()]
    assert got[:8] == [7.96875, 8.0, 15.9375, 1020.0, 2.0**29, 0.498046875, -7.96875, 242 * 2.0**1016]
    assert math.isnan(got[8])
