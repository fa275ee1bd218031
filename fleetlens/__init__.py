"""fleetlens — GPU and LLM-serving telemetry analytics on Spark.

Every operator takes DataFrames and returns DataFrames built from Spark SQL
expressions, so Catalyst plans, prunes and pushes down the whole job.

Sub-packages:

* ``sources``   — landed raw data (CSV probe lines, device samples, streamed
                  response chunks, request logs, stored text times, archives)
                  turned into typed tables.
* ``functions`` — column expressions (workload classification, memory view,
                  severity, session measures, display formatting).
* ``operators`` — relational operators (range scans, latest state, series
                  statistics, downsampling, trends, process events, sessions,
                  roll-ups, metric snapshots).
* ``sinks``     — table maintenance on Parquet (append, upsert, archive,
                  retention, compaction of micro-batch partitions).
* ``streaming`` — the same operators under Structured Streaming.
* ``plans``     — end-to-end jobs composed from the above (hourly upkeep, chart
                  and session panels) and the registry of named queries used by
                  ``__spark_entry__``.
"""

__version__ = "0.1.0"
