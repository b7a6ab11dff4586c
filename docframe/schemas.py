"""Schemas of the tables that operators exchange."""

REGION = "region_type string, bbox array<int>, text string, confidence double"
LAYOUT = "page_count int, pages array<struct<page_number:int,width:int,height:int,regions:array<struct<region_type:string,bbox:array<int>,text:string,confidence:double>>>>"
COLUMN = "struct<name:string,type:string,description:string,is_primary_key:boolean>"
TABLE = f"struct<table_name:string,description:string,columns:array<{COLUMN}>>"
RELATIONSHIP = (
    "struct<source_table:string,source_column:string,references_table:string,references_column:string,"
    "link_basis:string,composite_key_columns:array<string>,nullable:boolean,enabled:boolean>"
)
MODEL = f"struct<extraction_type:string,tables:array<{TABLE}>,relationships:array<{RELATIONSHIP}>>"
SECTION = "struct<section_id:string,title:string,page_range:array<int>,assigned_tables:array<string>>"
#: Logical column types and Spark's.
TYPES = {"string": "string", "integer": "bigint", "float": "double", "boolean": "boolean", "date": "date"}
PROVENANCE = {"source_page_numbers": "array<int>", "extraction_confidence": "double", "reconciliation_notes": "string"}
JOB_EVENT = "job_id string, status string, progress double, error_message string, connection_string string, ts timestamp"
