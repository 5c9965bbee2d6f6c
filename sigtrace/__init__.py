"""sigtrace: mobile-network signalling-trace analytics on Spark.

Readers / sinks (``sigtrace.sources``): ``pdml.read_pdml``, ``packets.read_jsonl``,
``packets.normalize_packets``, ``packets.write_packets``, ``packets.load_packets``;
streaming ingest: ``sigtrace.streaming.ingest.ingest_stream``.

Operators (``sigtrace.operators``) take and return DataFrames over the ``packets``
table: ``enrich`` (B), ``catalog`` (C), ``predicates`` (D), ``listing`` (E),
``measure`` (F), ``correlate`` (G), ``release`` (R), ``callflow`` (T), ``lookup`` (V),
``sqlsurface`` (Q).  Call ``sigtrace.session.configure(spark)`` once per session.
"""

__version__ = "0.1.0"
