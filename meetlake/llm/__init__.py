"""Operators for building training corpora: text in, filtered, deduplicated, mixed and encoded text out.

Each module holds one operator and the thin query that applies it to the star-schema folder's tables. The modules
import nothing from the rest of the library, and nothing else imports them.
"""
