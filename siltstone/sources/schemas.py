"""Schemas of the engine's data model."""

from __future__ import annotations

from dataclasses import dataclass

BLOCK = "pdf_path string, num_pages int, page_number int, page_height float, page_width float, num_blocks int, block_type string, block_content string, block_summary string, block_embedding array<float>, image_path string, image_caption string, image_footer string, block_bbox array<float>, block_id long, document_title string, section_title string"
TEXT_CHUNK = "tokens int, content string, full_doc_id string, chunk_order_index int"
NODE = "entity_name string, entity_type string, description string, source_id array<string>, degree int"
EDGE = "src string, tgt string, weight double, description string, source_id array<string>, `order` int"
COMMUNITY = "level int, title string, edges array<array<string>>, nodes array<string>, chunk_ids array<string>, occurrence double, sub_communities array<string>, report_string string"
TRIPLE = "head string, head_desc string, relation string, relation_desc string, tail string, tail_desc string"
HIT = "query_id long, doc_id string, page int, text string, vector_score double, text_score double, score double"
ANSWER = "question string, kind string, value string, refs array<struct<sha1: string, page: int>>"
BLOCK_TYPES = ("text", "image", "table", "flatten")


@dataclass(frozen=True)
class QueryParam:
    """How a graph query is answered."""

    mode: str = "hi"
    level: int = 2
    top_k: int = 20
    top_m: int = 10
    text_tokens: int = 10_000
    entity_tokens: int = 20_000
    relation_tokens: int = 20_000
    bridge_tokens: int = 12_500
    community_tokens: int = 12_500
    one_community: bool = False


@dataclass(frozen=True)
class RunConfig:
    """How a batch of questions is answered."""

    top_n: int = 10
    sample_size: int = 36
    chunk_size: int = 300
    chunk_overlap: int = 50
    alpha: float = 0.5
