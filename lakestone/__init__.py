"""lakestone: a Spark-native bronze/silver/gold quality pipeline and the statistics around it.

Every operator is a DataFrame (or SQL) plan: rules are ``Column`` expressions, reports
are single-pass aggregates, gold tables are grouped aggregates, and the generators are
projections over an index column.  Nothing data-sized is pulled to the driver.
"""

__version__ = "0.1.0"
