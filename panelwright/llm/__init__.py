"""Operations of a training-data pipeline: documents in, decisions, spans, files and sequences out.

Nothing else in the library imports this subpackage.
"""
