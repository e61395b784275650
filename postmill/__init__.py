"""postmill: post-training data preparation and evaluation as Spark DataFrame jobs.

Sub-packages:
  sources/    readers and writers (JSON array / JSON lines / split corpora / parquet)
  functions/  Column-level building blocks (text, answers, arrays, statistics)
  operators/  DataFrame -> DataFrame operators (curate, sample, countdown, tokens, losses, evals)
  plans/      query catalogue over the driver tables, skew-safe scans, derived inputs
  streaming/  Structured Streaming jobs (answer scoring, windowed rewards)
"""

__version__ = "0.1.0"
