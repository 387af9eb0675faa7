"""factlake: a PySpark-native engine for facts about source code and text corpora."""
