"""Stateful operators over streams of samples."""
