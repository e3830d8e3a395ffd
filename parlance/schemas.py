"""Schemas of the engine's tables. Every table carries meeting_id and ordinals: rows of a DataFrame have no order."""

WORDS = "meeting_id string, segment_id int, word_idx int, word string, start double, end double, probability double, speaker string"
SEGMENTS = "meeting_id string, segment_id int, start double, end double, text string, avg_logprob double, no_speech_prob double, compression_ratio double"
EDITS = "meeting_id string, ordinal int, segment_id int, original string, replacement string, reason string, confidence double, source string"
CHUNKS = "meeting_id string, chunk_idx int, segment_id int, start double, end double, word_refs array<struct<segment_id:int,word_idx:int>>, whole_segment int, kind string"
UTTERANCES = "meeting_id string, utt_idx int, segment_id int, speaker string, start double, end double, text string"
DECISIONS = "meeting_id string, ordinal int, statement string, evidence string"
ACTIONS = "meeting_id string, ordinal int, task string, owner string, deadline string, evidence string"
TURNS = "meeting_id string, side string, start double, end double, speaker string"
RECORD_JSON = "summary string, minutes array<string>, decisions array<struct<statement:string,evidence:string>>, action_items array<struct<task:string,owner:string,deadline:string,evidence:string>>"
EDITS_JSON = "edits array<struct<segment_id:int,original:string,replacement:string,reason:string,confidence:double>>"
VERDICTS_JSON = "verdicts array<struct<index:int,keep:boolean,why:string>>"
