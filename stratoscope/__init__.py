"""A Spark-native engine for collections of time-series recordings."""
