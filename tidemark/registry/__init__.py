"""Every registered query with its ANSI SQL twin where SQL can say the same."""
from . import landed, news, prices, series, space, stores, streams, text  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401
