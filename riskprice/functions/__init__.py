"""Column factories: every pricing formula as a built-in Spark ``Column``.

Nothing here touches a DataFrame; the functions take column names (the plan-time
schema) and parameters and return expressions that Catalyst folds into one
whole-stage-codegen projection.
"""
