"""claimlens: insurance-claims analytics as Spark DataFrame plans.

Layout
------
``sources``    read the driver tables and derive the claims star schema, load or
               write materialised models, and the synthetic generator.
``functions``  column builders (month start, day differences, exact rounding).
``operators``  reusable DataFrame operators (share of total, outcome rates,
               top-k, top-per-group, pre-aggregated joins, dual-date monthly
               KPIs, table profiles, data-quality rules).
``plans``      the report queries, views, presentation queries and checks.
``streaming``  incremental refresh of the reporting views from a claims feed.
"""

__version__ = "0.1.0"
