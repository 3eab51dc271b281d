"""Spark-native engine for labelled media pools and detector evaluation."""
