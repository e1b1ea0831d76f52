"""Session settings the operators are planned for."""

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # One problem may own a large share of all samples: let the completion join
    # split its partition, even at the price of a later exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Completions compress well, so a heavy partition is small on disk.
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64MB",
    "spark.sql.session.timeZone": "UTC",
}


def configured(builder):
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return builder
