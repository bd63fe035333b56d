"""Statuses to labels: precedence chains are data, evaluated in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reasons that make a file suspect, with the label of each.
SUSPECT_LABELS = {
    "wrong_subtitle": "wrong",
    "partly_out_of_sync": "partial",
    "missing_lines": "missing_part",
    "past_audio_end": "past_end",
    "lines_out_of_order": "swapped",
    "unreliable_timing": "noisy",
}
ATTENTION_FLAGS = ("SUSPECT", "unknown")
REPLACEMENT_FAILED = "original kept, marked wrong"
# Status shapes behind each kind of timing result.
SYNC_KINDS = {
    "moved": "(sync_status ilike 'fixed (Δ%' or sync_status ilike 'would fix (Δ%' or sync_status = 'fixed')",
    "rescaled": "(sync_status ilike 'fixed (framerate%' or sync_status ilike 'fixed (rate%')",
    "fixed": "(sync_status ilike 'fixed%' or sync_status ilike 'would fix%')",
    "replaced": "(auto_action ilike 'remediated: %' or auto_action ilike '%; remediated: %')",
    "nochange": "(sync_status = 'already in sync')",
    "unchanged": "(sync_status ilike 'left unchanged%')",
}


def cascade(rules: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first rule that holds."""
    out = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    for when, value in reversed(rules):
        out = F.when(when, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def verdict(status: Column, flag: Column, reason: Column, action: Column) -> Column:
    """Label of a file, by the first rule that fits its status, flag and reason."""
    status, flag, action = (F.coalesce(c, F.lit("")) for c in (status, flag, action))
    fixed = status.startswith("fixed") | status.startswith("would fix")
    suspect = flag == "SUSPECT"
    return cascade(
        [
            (status == "missing", "nosub"),
            (flag == "generated", "generated"),
            (flag == "skipped", "skipped"),
            ((flag == "unknown") & F.coalesce(reason.isin("no_speech_heard"), F.lit(False)), "no_speech"),
            ((flag == "unknown") & F.coalesce(reason.isin("check_failed"), F.lit(False)), "check_failed"),
            (flag == "unknown", "unknown"),
            (suspect & action.contains(REPLACEMENT_FAILED), "repl_failed"),
            *[(suspect & F.coalesce(reason == r, F.lit(False)), label) for r, label in SUSPECT_LABELS.items()],
            (suspect, "needs_attention"),
            ((flag == "ok") & action.rlike("(^|; )remediated: "), "insync"),
            ((flag == "ok") & (status.startswith("fixed (framerate") | status.startswith("fixed (rate")), "fixed_rate"),
            ((flag == "ok") & fixed, "fixed_shift"),
            (flag == "ok", "insync"),
            (flag == "disabled", "disabled"),
            ((flag == "no local Whisper binary") | flag.rlike(r"^no \S+ API key$"), "no_key"),
            (status.startswith("error") | (status == "unexpected-error"), "sync_error"),
        ],
        "not_checked",
    )


def shift_seconds(text: Column) -> Column:
    """``-H:M:S`` or plain seconds to signed seconds."""
    sign = F.when(F.ltrim(text).startswith("-"), -1.0).otherwise(1.0)
    parts = F.transform(F.split(F.regexp_replace(text, r"[^0-9.:]", ""), ":"), lambda p: p.try_cast("double"))
    return sign * F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p)


def parse_delta(status: Column) -> Column:
    return F.regexp_extract(status, r"Δ\s*([+-]?\d+(?:\.\d+)?)\s*s", 1).try_cast("double")


def parse_sections(status: Column) -> Column:
    return F.regexp_extract(status, r"(\d+) (?:sync blocks?|anchor regions?)", 1).try_cast("int")


def parse_rates(status: Column) -> Column:
    pair = lambda k: F.regexp_extract(status, r"(\d+(?:\.\d+)?)\s*(?:→|->)\s*(\d+(?:\.\d+)?)", k).try_cast("double")
    return F.when(pair(1).isNotNull(), F.struct(pair(1).alias("made_for"), pair(2).alias("rescaled_to")))


def clock(seconds: Column) -> Column:
    """``m:ss``"""
    whole = F.floor(seconds).cast("long")
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def percent(part: Column, whole: Column) -> Column:
    """Percent to a tenth; null of nothing."""
    return F.when(whole > 0, F.floor(1000 * part / whole + 0.5) / 10)


def run_percent(done: Column, total: Column, running: Column) -> Column:
    """Whole percent, 99 at most while a run goes on; null without a total."""
    share = F.floor(100 * done / total)
    return F.when(total > 0, F.when(running, F.greatest(F.lit(0), F.least(F.lit(99), share))).otherwise(share)).cast("int")


def duration_text(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    whole = lambda a, b: F.floor(a / b).cast("string")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(whole(s, 60), F.lit("m "), (s % 60).cast("string"), F.lit("s"))).otherwise(F.concat(whole(s, 3600), F.lit("h "), whole(s % 3600, 60), F.lit("m")))


def bytes_text(n: Column) -> Column:
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**k, F.concat(F.format_number(n / 1024**k, 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def stretch_name(ratio: Column) -> Column:
    return F.format_string("%+.2f%%", (ratio - 1) * 100)


# Texts of actions taken on a file that failed its check, of outcomes, and reasons why nothing was verified.
NO_ACTION = "none (action=off)"
NOT_VERIFIED = "Not verified — no usable Whisper sample"
SKIPPED_SILENCE = "VAD silence-skip"


def suspect_action(reason: Column, act_on_missing: Column, configured: Column) -> Column:
    """What is done about a file that failed; lines that are missing are only reported unless ``act_on_missing``."""
    return F.when((F.coalesce(reason, F.lit("")) == "missing_lines") & ~F.coalesce(act_on_missing, F.lit(False)), "off").otherwise(configured)


def action_text(action: Column, dry_run: Column, known: Column, moved: Column, listed: Column) -> Column:
    """What an action came to. ``known``: the file has a source to report; ``moved``: where it was put away, null if that failed; ``listed``: its source was barred."""
    put = F.concat(F.lit("quarantined -> "), moved)
    return cascade(
        [
            (action == "off", NO_ACTION),
            (dry_run, F.concat(F.lit("would "), action, F.lit(" [dry-run]"))),
            (((action == "quarantine") | ~known) & moved.isNull(), "quarantine failed"),
            (action == "quarantine", put),
            (~known, F.concat(put, F.lit("; blacklist skipped (no match)"))),
            (~listed & moved.isNull(), "blacklist failed, and could not quarantine either"),
            (~listed, F.concat(F.lit("blacklist failed; "), put, F.lit(" instead"))),
        ],
        "blacklisted",
    )


def unknown_reason(errors: Column) -> Column:
    """Why a file is unknown, by its samples' errors (null for a sample without): a failed check, to be tried again, or no speech heard."""
    failed = F.exists(errors, lambda e: F.coalesce((e != "") & ~e.startswith(SKIPPED_SILENCE), F.lit(False)))
    return F.when(errors.isNull() | (F.size(errors) == 0) | failed, "check_failed").otherwise("no_speech_heard")


def timing_reason(jitter: Column, least: float = 0.5) -> Column:
    """What anchors that condemn a file's timing say: each line is off by its own, or a stretch is off as one."""
    return F.when(F.coalesce(jitter >= least, F.lit(False)), "unreliable_timing").otherwise("partly_out_of_sync")


def line_order_note(confirmed: Column, flagged: Column, tested: Column) -> Column:
    """What is reported about lines in the other order; nothing is rewritten. ``tested`` is a struct ``(confirmed, checked)`` or null."""
    share = F.when(tested.isNotNull(), F.concat(F.lit(", "), tested["confirmed"].cast("string"), F.lit("/"), tested["checked"].cast("string"), F.lit(" of the tested candidates"))).otherwise("")
    sure = F.when(confirmed > 0, F.concat(F.lit(" Line order: "), confirmed.cast("string"), F.lit(" block(s) confirmed swapped by Whisper"), share, F.lit(" — reported, not repaired."))).otherwise("")
    return F.concat(sure, F.when(flagged > 0, F.concat(F.lit(" Line order: "), flagged.cast("string"), F.lit(" block(s) flagged for manual review (unconfirmed)."))).otherwise(""))


def outcome(flag: Column, status: Column, shift: Column, score: Column, action: Column) -> Column:
    """``struct(outcome, text)`` of a file's run for its log line: ok, sync or suspect. ``score`` is text."""
    done = F.trim(F.substring_index(F.substring_index(F.coalesce(action, F.lit("")), ";", 1), " -> ", 1))
    out = lambda kind, said: F.struct(F.lit(kind).alias("outcome"), (said if isinstance(said, Column) else F.lit(said)).alias("text"))
    took = F.when(done.isin("", "-", NO_ACTION), "").otherwise(F.concat(F.lit(" ("), done, F.lit(")")))
    moved = F.coalesce(F.format_string("Synced (Δ%.1fs)", shift), F.lit("Synced"))
    moved = F.when(shift.isNull(), "Synced").otherwise(moved)
    return cascade(
        [
            (flag == "SUSPECT", out("suspect", F.concat(F.lit("SUSPECT — needs redownload"), took))),
            (flag == "unknown", out("suspect", NOT_VERIFIED)),
            (status.startswith("fixed"), out("sync", F.concat(moved, F.coalesce(F.concat(F.lit(", score "), score), F.lit(""))))),
        ],
        out("ok", F.concat(F.lit("OK"), F.coalesce(F.concat(F.lit(" (score "), score, F.lit(")")), F.lit("")))),
    )
