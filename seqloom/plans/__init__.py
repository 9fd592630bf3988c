from . import catalogue, changes, files, relational  # noqa: F401 - all fill catalogue.QUERIES
