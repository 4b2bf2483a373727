"""SQL expressions for text, booleans, similarity, verdict fields and statistics.

Every function takes column names or SQL expressions and returns a SQL expression, to be
used with ``F.expr``, ``selectExpr``, ``where`` or inside ``spark.sql``.  An expression of
any size then reaches Spark in one call, and all of it stays native.
"""
