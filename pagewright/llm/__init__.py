"""Operations of a training-data pipeline: tokens, languages, duplicates, archives, vectors, media.

Nothing else in the library imports this subpackage; it can be deleted as a whole.
"""
