"""Explicit schemas. Task annotations are maps, so a new task never changes a schema."""

ANNOTATION = (
    "struct<label:boolean,status:string,reason:string,annotator:string,source:string,confidence:double>"
)
ANNOTATIONS = f"map<string,{ANNOTATION}>"
PREDICTION = "struct<label:boolean,confidence:double,reason:string>"
RESULTS = f"map<string,{PREDICTION}>"

RAW_ANSWERS = (
    "question string, question_detail string, answer_full string, answer string, answer_truncated string, "
    "author string, votes bigint, comment_count bigint, platform string, url string, collected_at string"
)

CLEANED_SAMPLES = (
    "sample_id string, question string, question_detail string, content string, model_input string, "
    f"answer_preview string, answer_full_clean string, task_annotations {ANNOTATIONS}, "
    "author string, votes bigint, comment_count bigint, platform string, url string, collected_at string, "
    "extra struct<preview_was_truncated:boolean,preview_max_chars:int,had_html:boolean,has_spam:boolean,"
    "has_contact_hint:boolean,source_answer_chars:int,clean_answer_chars:int>"
)

PRELABELED_SAMPLES = (
    CLEANED_SAMPLES + f", predicted_task_annotations {ANNOTATIONS}, need_review boolean, "
    "auto_label_meta struct<provider:string,model:string,output_format:string,review_threshold:double,"
    "generated_at:string>"
)

REVIEW_DECISIONS = (
    "reviewer string, session string, seq bigint, sample_id string, task_id string, choice string, "
    "reason_no int, decided_at timestamp_ntz"
)

REVIEWED_SAMPLES = (
    "sample_id string, text string, model_input string, question string, answer_preview string, "
    f"full_context string, platform string, url string, task_annotations {ANNOTATIONS}, "
    f"predicted_task_annotations {ANNOTATIONS}"
)

EXAMPLES = (
    "text string, category string, label string, "
    "task_annotations map<string,struct<label:boolean,reason:string>>"
)

SCORE_REQUESTS = "text string, platform string, task_ids array<string>"

PLATFORMS = (
    "id string, name string, url_pattern string, detectors array<string>, effects array<string>, enabled boolean"
)
DETECTORS = "id string, name string, description string, enabled boolean, threshold double"
EFFECTS = "id string, name string, enabled boolean, options map<string,double>"

TASKS = (
    "task_id string, ordinal int, name string, description string, positive_label string, "
    "negative_label string, reason_options array<string>"
)
