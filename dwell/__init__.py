"""Usage analytics on Spark: foreground-window samples -> sessions -> reports.

Sub-packages
------------
functions   column expressions (clock, units, dates, text)
sources     readers and writers, the shared work folder, the stored usage tables
operators   DataFrame -> DataFrame building blocks
plans       named reports and the registered queries
streaming   Structured Streaming jobs
"""
