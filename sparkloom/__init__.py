"""A PySpark-native engine for governed datasets, response scoring and paired evaluation."""
