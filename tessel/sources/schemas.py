"""Schemas of the files that are read, as DDL."""

IMAGES = "STRUCT<paths: ARRAY<STRING>, bytes: ARRAY<BINARY>, resolutions: ARRAY<ARRAY<INT>>>"
ANNOTATIONS = "pairid BIGINT, reference STRING, target_hard STRING, caption STRING, target_soft MAP<STRING, DOUBLE>, img_set STRUCT<members: ARRAY<STRING>>"
FASHION = "candidate STRING, target STRING, captions ARRAY<STRING>"
EDITS = "sample_id STRING, source_file_name STRING, edited_file_name STRING, edit_instruction STRING, augmented_instructions ARRAY<STRING>, img_width INT, img_height INT, category STRING, style STRING, kind STRING"
TRAINING = ", ".join(f"{p}_text STRING, {p}_image {IMAGES}" for p in ("query", "pos", "neg")) + ", global_dataset_name STRING"
RETRIEVED = "ARRAY<STRUCT<rank: INT, candidate_image: STRING, similarity_score: DOUBLE, candidate_index: INT>>"
RETRIEVAL = f"metadata MAP<STRING, STRING>, queries ARRAY<STRUCT<query_id: BIGINT, pairid: BIGINT, reference_image: STRING, target_hard: STRING, modification_text: STRING, retrieval_results: {RETRIEVED}>>"
HARD_NEGATIVES = "reference_image STRING, modification_text STRING, target_image STRING, hard_negative_image STRING, rank_position INT, gt_rank INT, gt_topk_rank INT, gt_in_candidates BOOLEAN, gt_similarity DOUBLE, similarity_score DOUBLE, is_real_retrieval BOOLEAN"
AUGMENTED = "reference_image STRING, modification_text STRING, target_image STRING, original_target_image STRING, original_mod_text STRING, is_augmented BOOLEAN, hard_negative_rank INT, similarity_score DOUBLE"
QRELS = "`query-id` STRING, `corpus-id` STRING, score INT"
EMBEDDINGS = "id STRING, pos INT, embedding ARRAY<FLOAT>"
