"""The tables' schemas."""

PAGE = "text string, page_number int, source_file string, source_path string, source_type string, author string, chapter int, language string, has_latex boolean"
CHUNK = (
    "chunk_id string, text string, source_file string, source_path string, source_type string, author string, page int, chapter int, language string, has_latex boolean, chunk_index int, "
    "block_type string, has_theorem boolean, has_proof boolean, has_definition boolean, start_char int, end_char int, parent_id string, parent_content string, is_parent boolean, child_count int, "
    "child_ids array<string>, embedding array<float>, extra map<string,string>"
)
POSTINGS = "chunk_id string, term string, tf bigint, dl bigint"
LENGTHS = "chunk_id string, dl bigint"
TERMS = "term string, df bigint, idf double, n_docs bigint, avgdl double"
QUOTA_STATE = "count int, start_time double"
