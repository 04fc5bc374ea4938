"""Table schemas, as DDL."""

NODES = "tax STRING, node_id STRING, name STRING, comment STRING, depth INT, attributes MAP<STRING,STRING>, ord INT"
EDGES = "tax STRING, child_id STRING, parent_id STRING, ord INT"
DISJOINT = "tax STRING, node_id STRING, other_id STRING, ord INT"
MATCHES = "pair STRING, approach STRING, mode STRING, source_id STRING, target_id STRING, confidence DOUBLE"
JUDGEMENTS = "pair STRING, mode STRING, source_id STRING, candidate_id STRING, is_match BOOLEAN, confidence DOUBLE, fallback BOOLEAN"
RECORDS = (
    "approach STRING, pair STRING, source STRING, target STRING, mode STRING, precision DOUBLE, recall DOUBLE, f1 DOUBLE, matches BIGINT, total_predicted BIGINT, "
    "total_gt BIGINT, wall_time DOUBLE, api_time DOUBLE, per_node DOUBLE, requests BIGINT, judgements BIGINT, retries BIGINT, model STRING, postprocess STRING, rule STRING, "
    "min_votes INT, modes ARRAY<STRING>, mode_requests MAP<STRING,BIGINT>, seed BIGINT, config MAP<STRING,STRING>, "
    "match_pairs ARRAY<STRUCT<source_id:STRING,target_id:STRING,confidence:DOUBLE>>"
)
JOURNAL = (
    "key STRING, pair STRING, source STRING, target STRING, mode STRING, source_id STRING, request STRING, timestamp STRING, status_code INT, response STRING, error STRING, "
    "latency_seconds DOUBLE, probabilities ARRAY<STRUCT<source_id:STRING,target_id:STRING,probability:DOUBLE>>"
)
