"""A PySpark-native engine that turns conversations and documents into a knowledge graph."""
