"""gridloom: Spark-native analytics over gridded observations, features and text corpora."""
