"""Receivables reconciliation as Spark DataFrame jobs.

``functions``  column expressions (text, money, dates, fingerprints, masks, documents)
``sources``    statement files, invoice CSV files, document files, tenant tables, sinks
``operators``  DataFrame -> DataFrame reconciliation operators
``plans``      the operators put together: reconciliation and statement import
``streaming``  the statement import as a file stream
"""

__version__ = "0.1.0"
