"""featurelens: tabular modelling on Spark DataFrames.

Sub-packages: ``sources`` (readers and sinks), ``functions`` (column
expressions), ``operators`` (profiling, drift, transforms, models, metrics),
``plans`` (fit/score jobs assembled from the operators).
"""
