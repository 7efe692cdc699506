"""billrate: price bills of quantities against a rate catalogue on Spark."""
