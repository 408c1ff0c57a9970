"""Explicit schemas of the engine's tables; nothing is inferred."""

CORPUS = "id string, text_cleaned string, text_raw_length bigint, text_cleaned_length bigint, label bigint"
CHUNK = "chunk_id string, doc_id string, chunk_index int, text string, word_count int, char_start int, char_end int"
HIT = "rank int, chunk_id string, doc_id string, chunk_index int, score double, text string, char_start int, char_end int, word_count int, method string"
CLAIM = "claim_index int, claim_text string, source_sentence string, method string"
NLI = "verdict string, confidence double, probabilities struct<supported:double,contradicted:double,unsupported:double>"
FLAG = "type string, severity string, claim_items array<string>, evidence_items array<string>, description string"
TRIPLE = "example_id string, doc_id string, chunk_id string, claim string, evidence string, gold_label string, claim_type string, is_perturbed boolean"
OCCURRENCE = "occ_id bigint, doc_id string, left_ctx string, right_ctx string"
OCCURRENCE_SCORE = "occ_id bigint, rule string, p_not float, p_nor float, p_now float, p_non float, p_no float, p_number float, top1 string, top1_p float"
