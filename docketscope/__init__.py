"""Rulemaking-docket analytics as PySpark DataFrame jobs.

``functions``  Column -> Column building blocks (text, stance, dates, labels, fields)
``sources``    table contracts and readers, dimensions, source registry, sinks
``operators``  DataFrame -> DataFrame queries
``plans``      rollup builders and composed reports
"""
