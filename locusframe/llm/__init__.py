"""Operations of a training-data pipeline: scoring, similarity, extraction, mixing, search.

Nothing outside this subpackage imports it; `queries.py` registers its queries.
"""
