"""The queries of the library by name, and the SQL that checks them."""

from codeloom.plans import analysis_queries, code_queries, graph_queries, search_queries, service_queries, text_queries

FLAGSHIP = "knn_centroid_topk"
QUERIES = search_queries.QUERIES | graph_queries.QUERIES | text_queries.QUERIES | code_queries.QUERIES | analysis_queries.QUERIES | service_queries.QUERIES
ORACLES = search_queries.ORACLES | graph_queries.ORACLES | text_queries.ORACLES | code_queries.ORACLES | analysis_queries.ORACLES | service_queries.ORACLES
