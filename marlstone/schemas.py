"""Schemas of the records that sources deliver and operators pass on."""

from __future__ import annotations

#: A text record's payload: the union of what the source types have.
PAYLOAD = "struct<title: string, page_title: string, author: string, authors: array<string>, subreddit: string, score: bigint, num_comments: bigint, description: string, content: variant, comments: array<string>, categories: array<string>>"
#: The envelope of a snapshot line.
RECORD = f"id string, kind string, source string, timestamp string, url string, payload {PAYLOAD}"
#: A chunk of a record, as it is indexed.
PASSAGE = "row_index bigint, id string, doc_id string, source string, timestamp date, title string, content string, contents string, url string, chunk_idx int"
#: Columns of a knowledge-graph file, in order; it has no header.
GKG = "DATE string, NUMARTS string, COUNTS string, THEMES string, LOCATIONS string, PERSONS string, ORGANIZATIONS string, TONE string, CAMEOEVENTIDS string, SOURCES string, SOURCEURLS string"
#: A forecast question, flat.
QUESTION = "market_id string, question string, description string, resolution_criteria string, domain string, open_time string, resolve_time string, resolved_time string, sample_time string, difficulty string, sampled_prob_yes double, label int, horizon string"
#: A forecast.
RESULT = "market_id string, domain string, difficulty string, predicted_prob double, label int, brier_score double, reasoning_summary string, latency_sec double, total_tokens bigint, steps_count bigint, error string"
#: What a memory keeps of a solved question.
EXPERIENCE = "experience_id string, source_question_id string, domain string, zone string, level string, title string, summary string, content string, created_at string, source_open_time string, source_resolved_time string, outcome int, correctness boolean, support_count bigint, merged_from array<string>, embedding array<double>"
