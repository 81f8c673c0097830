"""sieveline: a Spark-native engine for curating and evaluating labelled array and text corpora."""
