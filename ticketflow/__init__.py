"""ticketflow: Spark-native analytics for multilingual support tickets.

Every operator is a function DataFrame -> DataFrame or Column -> Column.
Sub-packages:

* ``functions``  column expressions (cleaning, hashing, urgency, rendering)
* ``operators``  table-level jobs (language, intents, templates, metrics,
  evaluation, splits, augmentation, ranking helpers)
* ``sources``    readers, sinks and the fixture views over the test tables
* ``plans``      composed jobs (``enrich_tickets``) and the query registry
* ``streaming``  Structured Streaming versions of enrichment and metrics
"""

__version__ = "0.1.0"
