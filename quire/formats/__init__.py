"""Binary document formats, read and written with the standard library.

Readers take (path or id, content) columns, as Spark's ``binaryFile`` source
gives them, and return rows; a file that cannot be read gives a row with an
error instead of failing the job.
"""
