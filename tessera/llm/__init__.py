"""Training-data operators: ten corpus operators and the pipeline stages built from them.

Nothing outside this folder imports it; ``__spark_entry__`` registers its
queries only when the folder is present.
"""
