"""grainworks: a Spark-native engine that turns messy files into clean typed tables."""
