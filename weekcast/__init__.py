"""Weekly player projections expressed as Spark DataFrame operators.

``functions``  column expressions (scoring, odds, labels, generated text)
``operators``  domain-free DataFrame operators (aggregates, joins, windows)
``sources``    readers, sinks, and the adapter that derives the domain tables
``plans``      compositions: box score, context, gold features, slates,
               evaluation, insight text, serving queries, dashboard views
``streaming``  empty on purpose: every input of this engine is bounded
"""
