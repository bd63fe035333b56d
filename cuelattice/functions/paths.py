"""Names, paths, languages and settings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Three-letter and named languages to two-letter codes.
LANGUAGES = {
    "eng": "en", "english": "en", "dan": "da", "danish": "da", "swe": "sv", "swedish": "sv", "nor": "no", "norwegian": "no", "fin": "fi", "finnish": "fi",
    "ger": "de", "deu": "de", "german": "de", "fre": "fr", "fra": "fr", "french": "fr", "spa": "es", "spanish": "es", "ita": "it", "italian": "it",
    "dut": "nl", "nld": "nl", "dutch": "nl", "por": "pt", "portuguese": "pt", "pol": "pl", "polish": "pl", "rus": "ru", "russian": "ru",
    "jpn": "ja", "japanese": "ja", "kor": "ko", "korean": "ko", "chi": "zh", "zho": "zh", "chinese": "zh",
}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column, up: int = 1) -> Column:
    return F.get(F.split(path, "/"), F.size(F.split(path, "/")) - 1 - up)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]+$", "")


def episode_code(name: Column) -> Column:
    """``SxxEyy`` with two digits at least, null where a name has none."""
    season, episode = F.regexp_extract(name, r"(?i)s(\d{1,2})e(\d{1,3})", 1), F.regexp_extract(name, r"(?i)s(\d{1,2})e(\d{1,3})", 2)
    padded = lambda x: F.when(F.length(x) < 2, F.lpad(x, 2, "0")).otherwise(x)
    return F.when(season != "", F.concat(F.lit("S"), padded(season), F.lit("E"), padded(episode)))


def season_of(code: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(code, 1, 3), F.lit("")), F.lit("Unknown"))


def language_of_file(path: Column) -> Column:
    """The last dotted part before the ending that is a two- or three-letter code."""
    parts = F.split(base_name(path), r"\.")
    before = F.filter(F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.lower), lambda p: p.rlike("^[a-z]{2,3}$"))
    return F.when(F.size(before) > 0, F.element_at(before, -1))


def language_after_stem(name: Column, length: Column) -> Column:
    """The first dotted part after a stem of ``length`` characters, if it is a code and not the ending itself."""
    parts = F.filter(F.split(F.substr(name, length + 1), r"\."), lambda p: p != "")
    return F.when((F.size(parts) >= 2) & F.lower(F.get(parts, F.lit(0))).rlike("^[a-z]{2,3}$"), F.lower(F.get(parts, F.lit(0))))


def language_code(value: Column) -> Column:
    """Two-letter code of a name, three-letter or two-letter code; null when unknown."""
    low = F.lower(F.trim(value))
    return F.coalesce(_map(LANGUAGES)[low], F.when(low.rlike("^[a-z]{2}$"), low))


def same_language(a: Column, b: Column) -> Column:
    """Equal before the region; an unknown side counts as equal."""
    head = lambda x: F.lower(F.substring_index(x, "-", 1))
    return F.coalesce(head(F.nullif(a, F.lit(""))) == head(F.nullif(b, F.lit(""))), F.lit(True))


def title_of(path: Column) -> Column:
    """The show's folder: the one above a season folder, else the parent, else the name without ending."""
    up = parent(path)
    folder = F.when(up.rlike(r"(?i)^(season|series|s)[ ._-]*\d+$"), parent(path, 2)).otherwise(up)
    return F.coalesce(F.nullif(folder, F.lit("")), stem(path))


def target_label(title: Column, code: Column) -> Column:
    return F.concat_ws(" ", title, code)


def original_name(name: Column) -> Column:
    """An archived name without its time stamp."""
    return F.regexp_replace(name, r"\.\d{8}[-_T]?\d{6}(?=\.[^.]+$|$)", "")


def normalized_url(url: Column) -> Column:
    trimmed = F.rtrim(F.trim(url), F.lit("/"))
    return F.when(trimmed == "", trimmed).when(trimmed.rlike(r"^[a-zA-Z]+://"), trimmed).otherwise(F.concat(F.lit("http://"), trimmed))


def path_pairs(text: Column) -> Column:
    """``a=b,c=d`` to pairs in their order."""
    pairs = F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda p: p.contains("="))
    return F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("theirs"), F.trim(F.substr(p, F.instr(p, "=") + 1)).alias("ours")))


def mapped_path(path: Column, pairs: Column, back: bool = False) -> Column:
    """The path with its first matching prefix rewritten, in list order; unchanged where none matches."""
    old, new = ("ours", "theirs") if not back else ("theirs", "ours")
    fits = F.filter(pairs, lambda p: path.startswith(p[old]))
    return F.when(F.size(fits) > 0, F.concat(F.get(fits, F.lit(0))[new], F.substr(path, F.length(F.get(fits, F.lit(0))[old]) + 1))).otherwise(path)


def suggested_pair(ours: Column, theirs: Column) -> Column:
    """What is left of two paths before their longest common ending."""
    a, b = F.reverse(F.split(ours, "/")), F.reverse(F.split(theirs, "/"))
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, e: F.struct((s["on"] & e).alias("on"), (s["n"] + (s["on"] & e).cast("int")).alias("n")))
    left = lambda x: F.array_join(F.slice(F.split(x, "/"), F.lit(1), F.size(F.split(x, "/")) - same["n"]), "/")
    return F.struct(left(theirs).alias("theirs"), left(ours).alias("ours"))


def cpu_list(text: Column) -> Column:
    """``0-3,6`` to sorted numbers; null when malformed."""
    ranges = F.transform(F.split(F.regexp_replace(text, r"\s+", ""), ","), lambda p: F.sequence(F.substring_index(p, "-", 1).cast("int"), F.substring_index(p, "-", -1).cast("int")))
    good = text.rlike(r"^\s*\d+(\s*-\s*\d+)?(\s*,\s*\d+(\s*-\s*\d+)?)*\s*$")
    return F.when(good, F.array_sort(F.array_distinct(F.flatten(ranges))))


def kind_for(path: Column, movie_roots: list[str], series_roots: list[str]) -> Column:
    under = lambda roots: F.lit(False) if not roots else F.greatest(*[path.startswith(r.rstrip("/") + "/") for r in roots], F.lit(False))
    return F.when(under(series_roots), "series").when(under(movie_roots), "movie").when(episode_code(base_name(path)).isNotNull(), "series").otherwise("movie")


def media_root_for(path: Column, roots: list[str]) -> Column:
    out = F.regexp_replace(path, "/[^/]*$", "")
    for root in reversed(roots):
        out = F.when(path.startswith(root.rstrip("/") + "/"), F.lit(root)).otherwise(out)
    return out


def setting_value(kind: str, raw: Column, default: object) -> Column:
    """A stored text as its declared kind, with a default where it cannot be read."""
    if kind == "bool":
        return F.coalesce(F.when(raw == "1", F.lit(True)).when(raw == "0", F.lit(False)), F.lit(default))
    if kind in ("int", "float"):
        return F.coalesce(F.expr("null") if raw is None else raw.try_cast("long" if kind == "int" else "double"), F.lit(default))
    if kind == "list":
        return F.coalesce(F.from_json(raw, "array<string>"), F.array(*map(F.lit, default)) if default else F.expr("cast(array() as array<string>)"))
    return F.coalesce(raw, F.lit(default))


def setting_text(kind: str, value: Column) -> Column:
    if kind == "bool":
        return F.when(value, "1").otherwise("0")
    return F.to_json(value) if kind == "list" else value.cast("string")
