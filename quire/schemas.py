"""Schemas of the tables that stages exchange, as DDL."""

PAGES = "doc_id long, page_number int, text string, token_count int"
TOC_ITEMS = "doc_id long, pos int, structure string, title string, physical_index int"
NODES = (
    "doc_id long, pos int, parent_pos int, path array<int>, depth int, node_id string, title string, "
    "start_index int, end_index int, summary string, text string"
)
MD_SECTIONS = "doc_id long, pos int, level int, line_num int, title string, text string"
REQUESTS = "req_id string, doc_id long, stage string, key string, prompt string, inputs map<string,string>"
COMPLETIONS = "req_id string, text string, finish_reason string, status string, error string"
SEARCH = "query_id long, doc_id long, thinking string, node_ids array<string>"
ANSWERS = (
    "query_id long, doc_id long, answer string, context string, "
    "citations array<struct<node_id:string,title:string,start_page:int,end_page:int>>"
)
TREE_NODE = "title string, start_index int, end_index int, node_id string, summary string, text string"
TRAINING_PAIR = (
    "arxiv_id string, document_text string, page_count int, total_tokens int, tree string, "
    "metadata struct<model:string,provider:string,generation_time_seconds:double,timestamp:string>"
)
ERROR_RECORD = "arxiv_id string, error string, elapsed_seconds double, timestamp string"
EXAMPLE = "messages array<struct<role:string,content:string>>"
