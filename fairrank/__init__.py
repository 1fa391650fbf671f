"""fairrank: retail affinity analytics and fairness-aware recommendation on Spark.

Every operator is a DataFrame-in, DataFrame-out function built from Spark
built-ins.  Sub-packages:

* ``sources``    contract ingest, parquet readers/writers, report sinks
* ``functions``  column-expression helpers shared by the operators
* ``operators``  the data operators (interactions, quality, features, labels,
                 scoring, fairness, ranking evaluation, co-occurrence, ML)
* ``plans``      jobs composing operators end to end, plus driver-table fixtures
* ``streaming``  Structured Streaming variants (request-log monitoring)
"""

__version__ = "0.1.0"
