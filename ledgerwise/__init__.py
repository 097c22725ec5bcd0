"""Account-movement analytics as Spark DataFrame jobs.

Every operator is a function from DataFrames (plus a date argument where the result depends on "today") to a
DataFrame.  Nothing reads the clock, nothing collects rows to the driver; only ``sources`` and ``streaming`` do I/O.
"""
