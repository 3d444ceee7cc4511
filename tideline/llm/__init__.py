"""Training-data preparation: ten corpus operators and the pipeline built on them.

Nothing else in the library imports this subpackage.
"""
