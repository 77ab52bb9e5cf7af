"""Tables of the store as Spark schemas."""

REPOS = "id bigint, github_id bigint, owner string, name string, full_name string, status string, total_prs int, indexed_prs int, indexed_at timestamp, created_at timestamp"
PULL_REQUESTS = (
    "id bigint, repo_id bigint, number int, github_id bigint, title string, body string, author string, author_type string, outcome string, labels array<string>, files_changed array<string>, "
    "additions int, deletions int, created_at timestamp, merged_at timestamp, closed_at timestamp, in_corpus boolean, exclusion_reason string, raw string"
)
CHUNKS = "id bigint, pr_id bigint, repo_id bigint, file_path string, hunk_index int, content string, token_count int, was_truncated boolean, additions int, deletions int, embedding array<float>, created_at timestamp"
EVAL_QUERIES = "id bigint, pr_id bigint, subsystem string, split string"
JUDGMENTS = "id bigint, query_pr_id bigint, candidate_pr_id bigint, grade smallint, reason string, round smallint, batch string, self_authored boolean, seconds_spent int, labeled_at timestamp"
SIMILARITY_RESULTS = (
    "id bigint, query_pr_id bigint, repo_id bigint, results array<struct<pr_id:bigint,pr_number:int,title:string,outcome:string,final_score:double,vector_score:double,file_score:double,bm25_score:double,reason:string>>, "
    "weights map<string,double>, computed_at timestamp, posted boolean, posted_at timestamp, comment_url string"
)
TABLES = {"repos": REPOS, "pull_requests": PULL_REQUESTS, "chunks": CHUNKS, "eval_queries": EVAL_QUERIES, "judgments": JUDGMENTS, "similarity_results": SIMILARITY_RESULTS}
