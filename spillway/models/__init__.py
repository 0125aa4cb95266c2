"""Fitted heads, novelty scores, detectors and mined rules."""
