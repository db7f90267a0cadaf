"""Operations of a training-data pipeline, each over whole Spark tables.

Nothing else in the library imports this subpackage.
"""
