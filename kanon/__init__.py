"""kanon — business-registry analytics as Spark DataFrame / SQL / Structured Streaming jobs.

Layout:
    kanon.functions   Column -> Column normalisers and JSON readers (no Python UDFs)
    kanon.sources     table readers, landing-payload flatteners, fixture bindings, sinks
    kanon.operators   match / merge / identity / search / analytics / quality / monitor / billing jobs
    kanon.streaming   Structured Streaming versions of the incremental jobs
    kanon.plans       the query catalogue used by ``__spark_entry__`` and ``bench.py``
"""

__version__ = "0.1.0"
