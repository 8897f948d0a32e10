"""Training-data operators: chat formatting, search, tokenising, de-duplication,
scoring, licence and archive handling, and source mixing.

Nothing outside this package imports it.
"""
