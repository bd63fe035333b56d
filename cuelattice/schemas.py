"""Explicit schemas of the tables that the library keeps and of the series that its operators take, as DDL."""

from __future__ import annotations

CUES = "file_id string, idx int, start_ms long, end_ms long, text string"
SEGMENTS = "video string, model string, idx int, start double, end double, text string"
SPEECH = "video string, model string, start double, end double"
POINTS = "file_id string, a double, c double"
FILES = (
    "id long, video_path string, subtitle_path string, lang string, sync_status string, correctness_flag string, reason string, note string, "
    "avg_score double, auto_action string, sync_max_shift_s double, sync_split_blocks int, video_mtime double, video_size long, subtitle_mtime double, "
    "subtitle_size long, line_order_cache string, line_order_cache_key string, run_id long, processed_at timestamp"
)
HISTORY = "id long, video_path string, subtitle_path string, flag string, avg_score double, run_id long, checked_at timestamp"
RUNS = "id long, trigger string, mode string, dry_run boolean, force boolean, status string, files_total long, files_done long, files_fixed long, files_suspect long, files_error long, files_generated long, started_at timestamp, finished_at timestamp, error_message string"
LOG_LINES = "id long, run_id long, level string, message string, at timestamp"
LIBRARY_VIDEOS = "video_path string, kind string, title string, season_episode string, subtitle_langs array<string>, embedded_langs array<string>, series_id long, episode_id long, movie_id long, matched boolean, mtime double, size long"
TRANSCRIPTS = "video_path string, slot int, provider string, model string, start_s double, clip_seconds double, audio_lang string, transcript string, segments array<struct<start:double,end:double,text:string>>, mtime double, size long"
FULL_TRANSCRIPTS = "video_path string, spoken_lang string, provider string, model string, segments array<struct<start:double,end:double,text:string>>, mtime double, size long, created_at timestamp"
SPEECH_CACHE = "video_path string, model string, intervals array<struct<start:double,end:double>>, mtime double, size long, created_at timestamp"
GAP_PROBES = "video_path string, start_ms long, dur_ms long, audio_lang string, provider string, model string, segments array<struct<start:double,end:double,text:string>>, created_at timestamp"
ATTEMPTS = "video_path string, lang string, ok boolean, error string, at timestamp"
ACTIONS = "id long, subtitle_path string, video_path string, kind string, provider string, subs_id string, language string, series_id long, episode_id long, movie_id long, run_id long, outcome string, created_at timestamp, resolved_at timestamp"
SETTINGS = "key string, value string"
USERS = "id long, name string, password_hash string"
SESSIONS = "token string, user_id long, expires_at timestamp"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
