"""Schemas of the persistent tables, the enums and their defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The members of each enum.
ENUMS = {
    "book_status": ["uploaded", "extracting", "extracted", "translating", "review", "done", "failed"],
    "chunk_status": ["pending", "extracted", "translated", "verified", "terminology_reviewed", "approved", "failed"],
    "content_type": ["prose", "heading", "poetry", "quranic_verse", "hadith", "footnote", "numbered_list", "margin_note"],
    "glossary_scope": ["book", "global"],
    "term_category": ["religious", "technical", "scholarly", "name", "other"],
    "human_decision": ["pending", "accepted", "rejected", "edited"],
    "job_kind": ["extraction", "translation", "export", "reapply_glossary"],
    "job_status": ["queued", "running", "succeeded", "failed"],
}
LINE_META = "struct<line_id:string,text:string,type:string,font_size:double,bold:boolean,italic:boolean,alignment:string,rtl:boolean,page:int,content_class:string>"
ISSUES = "struct<has_issues:boolean,issues:array<struct<phrase:string,suggestion:string,reason:string>>>"
FLAGS = "array<struct<term:string,category:string,suggested_translation:string,reasoning:string>>"
TABLES = {
    "book": "id string, title string, author string, source_language string, target_language string, status string, total_chunks int, completed_chunks int, source_path string, page_count int, is_scanned boolean, error string, created_at timestamp, updated_at timestamp",
    "chunk": f"id string, book_id string, index int, raw_text string, translated_text string, format_map array<{LINE_META}>, content_type string, status string, page_start int, page_end int, quality_score double, retry_count int, human_edited boolean, error string, created_at timestamp, updated_at timestamp",
    "glossary_term": "id string, book_id string, original_term string, translation string, category string, with_original_in_brackets boolean, human_approved boolean, scope string, embedding array<float>, usage_count int, notes string, created_at timestamp, updated_at timestamp",
    "verification_result": "id string, chunk_id string, suggestions array<struct<phrase:string,suggestion:string,reason:string>>, score double, summary string, attempt int, accepted boolean, applied_at timestamp, created_at timestamp",
    "terminology_flag": "id string, chunk_id string, term string, suggested_translation string, category string, show_in_brackets boolean, rationale string, human_decision string, final_value string, applied_to_book boolean, created_at timestamp",
    "job": "id string, book_id string, kind string, status string, progress double, message string, error string, started_at timestamp, finished_at timestamp",
}


def key(*parts: Column) -> Column:
    """A deterministic id from a row's natural key."""
    return F.md5(F.concat_ws("|", *parts))


def in_domain(value: Column, enum: str) -> Column:
    return value.isin(ENUMS[enum])
