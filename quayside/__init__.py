"""quayside: a Spark-native engine for import-consignment data."""
