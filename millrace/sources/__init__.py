"""Readers and writers: file trees, logs, manifests, archives and checkpoints as DataFrames."""
