"""A feed for the polling source's test."""


def feed(cursor):
    rows = [(cursor, f"v{cursor}"), (cursor + 1, f"v{cursor + 1}")]
    return rows, cursor + 2


feed.schema = "id int, v string"
