"""Training-data operators: ten corpus-scale operations over documents and pages.

Each module holds one operator with its own general interface; ``queries`` holds the thin
queries over the test tables. Nothing outside this package imports it.
"""
