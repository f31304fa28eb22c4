"""Readers and writers: labels, images, metadata, predictions, manifests; publication."""
