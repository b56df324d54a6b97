"""Folia: document-layout analytics on Spark DataFrames."""
