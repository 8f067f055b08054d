"""Operations of a training-data pipeline, as Spark jobs.

Nothing else in the library imports this package.  Text means a row of a table like
``documents`` (doc_id, text, ...); a word is a run of characters other than space,
tab, line feed, vertical tab, form feed and carriage return.
"""
