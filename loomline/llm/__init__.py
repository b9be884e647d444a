"""Operators for preparing language-model training data on Spark.

Every operator is a function from DataFrame to DataFrame that reads only the columns it is told to
read, so extra columns, whatever their names, never reach its plan.  ``queries`` holds the thin
``opN_<name>`` queries over the test tables.
"""
