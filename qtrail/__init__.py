"""qtrail: audit-log query mining on Spark DataFrames.

Packages
  functions  – scalar expressions (templates, keys, labels) and predicates
  sources    – distributed audit-log scan, statement scan, edge/trace readers,
               the log rendered from the driver tables
  operators  – catalogues, successor pairs and confidence, traces, query
               graph (legend, chains, components), statement structure
  sinks      – CSV / JSON writers of the reference's outputs
  plans      – end-to-end jobs over a log (the reference's three scripts)
  streaming  – the line-local part of the scan on a file stream
"""

__version__ = "0.1.0"
