"""Transcript, retake and corpus analytics on Spark DataFrames."""
