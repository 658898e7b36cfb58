"""Animal-tracking analytics as Spark DataFrame operators.

Every public function takes DataFrames and returns DataFrames.  Canonical
column names: ``id`` (the tag) and ``date`` (the hour end of a series row, or
the calendar day of a daily row).  Run sessions in UTC.
"""
