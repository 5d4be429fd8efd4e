"""Schemas of extracted items, results and files. Document ids are strings: leading zeros count."""

MATRIX = "array<array<string>>"
TABLE = f"index:int,kind:string,start:int,end:int,raw:string,matrix:{MATRIX},span_pages:struct<start:int,end:int>"
EXTRACTED = f"struct<tables:array<struct<{TABLE}>>,body:string>"
HEADING = "index:int,level:int,text:string"
OP = "op:string,cost:double,gt_index:int,pred_index:int,gt_level:int,pred_level:int,text_similarity:double,gt_text_preview:string,pred_text_preview:string"

MANIFEST = (
    "system string, adapter string, constraints struct<uses_ground_truth:boolean,uses_pdf:boolean,uses_document_id_rules:boolean,merges_or_splits_tables:boolean,reorders_content:boolean>, "
    "rules array<string>, totals map<string,bigint>, files array<struct<id:string,source:string,output:string,source_sha256:string,output_sha256:string,changes:map<string,bigint>,"
    "validation:struct<table_count:int,heading_count:int,artifact_headings_removed:int,table_matrices_preserved:boolean,heading_sequence_preserved:boolean,idempotent:boolean>>>")
CONSTRAINTS = ("uses_ground_truth", "uses_pdf", "uses_document_id_rules", "merges_or_splits_tables", "reorders_content")

SUMMARY = ("system", "system_name", "id", "document", "final_score", "table_score", "title_layout_score", "text_score", "table_structure_score", "table_content_score", "matched_table_count", "missing_table_count",
           "extra_table_count", "primary_selected_pair_count", "semi_semantic_selected_pair_count", "prediction", "normalization_adapter", "normalization_manifest", "report")
LEADERBOARD = ("rank", "system", "system_name", "document_count", "final_score", "table_score", "title_layout_score", "text_score")
