"""The stored tables. Names and order of the columns."""

TEMPLATES = "id string, name string, version string, created_at timestamp_ntz, is_active boolean, embedding array<float>, title string, title_emb array<float>"
TEMPLATE_CHUNKS = "chunk_id string, template_id string, ord int, heading string, text string, embedding array<float>"
DOCS_INSERTED = (
    "id string, name string, version string, created_at timestamp_ntz, is_active boolean, embedding array<float>, similar_id string, similarity_score double, "
    "session_id string, user_choice_doc_id string, title string, title_emb array<float>"
)
DOCS_INSERTED_CHUNKS = "chunk_id string, doc_id string, ord int, heading string, text string, embedding array<float>"
