"""metaloom: catalog analytics as Spark DataFrame jobs.

Every operator takes DataFrames and returns DataFrames.  Nothing here holds
data, collects data to the driver or keeps state between calls.
"""
