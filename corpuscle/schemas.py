"""Schemas of the stored tables. Reserved metadata are columns, user metadata a map of JSON texts."""

SIGNATURES = "repo_id string, path string, hash string"
PARENTS = "repo_id string, id string, content string, meta map<string,string>"
CHUNKS = """
repo_id string, file_path string, id string, category string, repository_id string, workspace_id string,
user_id string, timestamp string, file_type string, chunk_index int, chunk_type string, parent_id string,
function_name string, start_line int, end_line int, content string, vector array<float>, meta map<string,string>
"""
REPO_STATES = "id string, repo_url string, local_path string, last_processed_snapshot string"
JOBS = "job_id string, state string, reason string, changed_at timestamp, attempts long"
SESSIONS = "session_id long, turn long, role string, text string"
COMMITS = "stream string, batch long"
OPEN_SESSIONS = "user_id long, created_at timestamp, last_accessed_at timestamp, message_count long, state string"
