"""Helpers that several test modules import by name."""


def by_id(df, key="borrower_id"):
    """Rows of a DataFrame as dicts, by their key."""
    return {r[key]: r.asDict() for r in df.collect()}
