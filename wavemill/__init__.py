"""wavemill: a PySpark-native engine for dense signals, event trains and labelled feature vectors."""
