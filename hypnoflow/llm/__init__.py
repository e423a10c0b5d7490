"""Training-data operators: language, quality, duplicates, contamination, mixing, sharding, pages, archives, chats, vectors.

Nothing outside this package imports it.
"""
