"""Column expressions: addresses, headers, bodies, dates and numbers.

Every function takes and returns columns, so it stays inside the JVM plan.
"""
