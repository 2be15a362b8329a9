"""Vocabularies and table schemas."""

from __future__ import annotations

# Labels, tags and flags of the data format.
LABELS = ("cs", "co", "aa", "bk", "ar", "cc", "other")
TARGETS = LABELS[:6]
RAW_TAGS = {"cs": "cs", "co": "co", "aa": "aa", "aap": "aa", "bk": "bk", "ar": "ar", "arp": "ar", "cc": "cc"}
PRECEDENCE = ("cc", "co", "cs", "ar", "aa", "bk")
PROPOSALS = ("cs", "co")
MARKERS = ("%-", "%--")
ERROR_FLAGS = ("ref_unresolved", "ref_malformed", "time_invalid", "type_unavailable")
STATUSES = ("ok", "no_pair", "malformed", "ambiguous")
DROP_FLAGS = ("is_nonspeech", "is_nonlabeled", "is_empty")
SPLITS = ("train", "val", "test")
WORD_KINDS = ("w", "vocalsound", "nonvocalsound", "comment", "disfmarker", "pause")

PARSED = (
    "seg_id string, meeting string, agent string, channel string, speaker_id string, src_start double, src_end double, start double, "
    "end double, timing_method string, position int, source_da_id string, element_ordinal int, part_index int, n_parts int, raw_type string, "
    "original_type string, part_type string, adjacency_raw string, comment string, text string, "
    "words array<struct<text:string,kind:string,start:double,end:double>>, quality_flags array<string>"
)
ANNOTATION = (
    "label string, label_bk_merged string, target_tags array<string>, is_multi_target boolean, is_layer2_proposal boolean, "
    "general_tags array<string>, disruption_markers array<string>"
)
ANNOTATED = f"{PARSED}, {ANNOTATION}, is_nonspeech boolean, is_nonlabeled boolean, is_empty boolean"
CLEANED = f"{PARSED}, {ANNOTATION}"
RELEASED = f"{CLEANED}, split string, fold int"
LINK = "proposal_id string, responder_chains array<array<string>>, has_response boolean, status string, adjacency_tokens array<string>, pair_group string"
ORDER = ("meeting", "src_start", "src_end", "agent", "element_ordinal", "part_index")
