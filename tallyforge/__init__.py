"""Spark-native operators over manifests, scores, boxes, embeddings and runs."""
