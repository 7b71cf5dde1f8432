"""scriptorium: literature-attribution analytics as Spark DataFrame jobs.

Sub-packages
------------
sources    table loading, derived fixture tables, CSV logs, materialisation
functions  Column builders (text, JSON actions, chat rendering, seeded draws)
operators  DataFrame -> DataFrame operators (k-NN, search, ranking, scoring, ...)
plans      composite jobs and the registry of named queries
streaming  the stateless scorers applied to streaming DataFrames
"""

__all__ = ["session"]
