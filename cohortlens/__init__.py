"""cohortlens — survey and cohort analytics as Spark DataFrame jobs.

Layers (in data-flow order):

* ``sources``   readers for wide extracts, indicator CSVs, conformed tables,
                SQL pulls, table sinks, and analogue views over generic tables;
* ``functions`` column expressions: recodes, classifiers, CMC dates, rates;
* ``operators`` reusable DataFrame operators: reshape, conform, quality checks,
                fan-out aggregation, ranking/trend windows, distributed ranks,
                exact ROC/AUC;
* ``plans``     named analyses (the twelve queries and the published extracts),
                the wide-to-star ETL, and the facility-delivery model;
* ``streaming`` incremental append of new extracts into the conformed tables.
"""

__version__ = "0.1.0"
