"""Schemas of the records that flow between operators, as DDL."""

from __future__ import annotations

METADATA = "map<string,string>"
DOCUMENT = f"doc_id string, text string, metadata {METADATA}"
CHUNK = f"chunk_id string, doc_id string, text string, start_char int, end_char int, token_count int, metadata {METADATA}"
QUERY = f"query_id string, text string, metadata {METADATA}"
QREL = "query_id string, doc_id string, relevance double"
#: One row for each query, stage and candidate.
STAGE_HIT = "query_id string, stage string, chunk_id string, score double, stage_rank int"
RANKED = "query_id string, chunk_id string, similarity double, rank int"
EXAMPLE = f"query_id string, question string, reference_answer string, metadata {METADATA}"
INTERACTION = "example_id string, question string, table_text string, answers array<string>, table_start_token int, table_end_token int, long_answer_start int, long_answer_end int"
SPAN = "struct<start_token:int,end_token:int>"
NQ_RECORD = (
    "example_id string, question_text string, document_html string, document_tokens array<struct<token:string>>, "
    "long_answer_candidates array<struct<start_token:int,end_token:int,top_level:boolean>>, "
    f"annotations array<struct<long_answer:struct<start_token:int,end_token:int,candidate_index:int>,short_answers:array<{SPAN}>>>"
)
ROWS = "array<array<string>>"
TABLE_CHUNK = "id string, table_id string, chunk_type string, content string, metadata string"
