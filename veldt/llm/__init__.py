"""Operations of large-scale training-data pipelines, on DataFrames.

Nothing outside this subpackage imports it; ``queries.py`` holds what the
driver contract registers.
"""
