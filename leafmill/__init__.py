"""Leafmill: document analytics as Spark jobs.

``sources`` read files into DataFrames, ``functions`` are Column expressions,
``operators`` are DataFrame to DataFrame functions, ``plans`` put operators
together over the standard tables, ``streaming`` holds the continuously merged
forms.
"""
