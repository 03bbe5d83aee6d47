"""All queries of the library and their SQL."""

from skeinworks.plans import answer_queries, code_queries, graph_queries, index_queries, profile_queries, search_queries, source_queries  # noqa: F401
from skeinworks.plans.queries import ORACLE_SQL, QUERIES  # noqa: F401
