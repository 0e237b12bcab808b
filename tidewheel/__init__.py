"""Spark-native operators for episodic, time-ordered records."""
