"""Schemas of the tables that operators exchange, as DDL; ``struct`` parses one in a running session."""

from __future__ import annotations

from pyspark.sql import types as T

BBOX = "struct<x0:double,top:double,x1:double,bottom:double>"
IMAGE = f"struct<id:string,path:string,page:int,text_offset:int,text_length:int,bbox:{BBOX},position:map<string,int>>"

DOCUMENTS = f"doc_id string, text string, source_path string, doc_type string, doc_hash string, title string, degraded boolean, images array<{IMAGE}>, extra map<string,string>"
SECTIONS = f"doc_id string, pos int, type string, text string, page int, bbox {BBOX}, html string"
CHUNKS = f"chunk_id string, doc_id string, chunk_index int, text string, section_type string, page_num int, bbox {BBOX}, table_html string, source_path string, collection string, tags array<string>"
POSTINGS = "chunk_id string, term string, tf bigint"
DOC_LENGTHS = "chunk_id string, dl bigint, unique_terms bigint"
RESULTS = "query_id string, chunk_id string, score double, rank int"
HISTORY = "file_hash string, file_path string, status string, collection string, error_msg string, processed_at timestamp, updated_at timestamp"
IMAGES = "image_id string, file_path string, collection string, doc_hash string, page_num int, caption string, created_at timestamp"
SUMMARY_CACHE = "cache_key string, summary string, created_at timestamp"
STAGE = "struct<stage:string,timestamp:string,elapsed_ms:double,data:string>"
TRACES = f"trace_id string, trace_type string, started_at string, finished_at string, total_elapsed_ms double, stages array<{STAGE}>, metadata string"
GOLDEN = "query string, reference string, expected_chunk_ids array<string>, expected_sources array<string>, reference_contexts array<string>, persona_name string, query_style string, query_length string"
METRICS = "query_id string, metric string, value double"


def struct(ddl: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(ddl) if isinstance(ddl, str) else ddl
