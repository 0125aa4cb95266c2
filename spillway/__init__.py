"""Spillway: a PySpark-native engine for labelled event and flow analytics."""
