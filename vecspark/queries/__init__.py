"""The registered queries. Importing the package registers all of them."""

from vecspark.queries import expressions, maintenance, models, ranking, searching, statistics, streams, structures  # noqa: F401
