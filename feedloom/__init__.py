"""feedloom — customer-feedback analytics on Spark DataFrames.

Every operator is either ``Column -> Column`` (``feedloom.functions``) or
``DataFrame -> DataFrame`` (``feedloom.operators``), so it composes with
``df.transform`` and is planned by Catalyst like any other Spark query.
"""

__version__ = "0.1.0"
