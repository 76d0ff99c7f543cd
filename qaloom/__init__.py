"""qaloom: a PySpark-native engine for question/answer/context datasets."""
