"""Column functions over log text. Word boundaries are ASCII ones on both sides, white space is spelled out, and nothing needs a Python function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns, token names and lengths that the log format and its signatures use.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
SPACES = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
HEADER = rf"\A~#?\[{SPACE}*(\d+)\];{SPACE}*(\d{{4}}-\d{{2}}-\d{{2}});{SPACE}*([\d:.]+);{SPACE}*([A-Z]+);{SPACE}?([^\n\r\x{{2028}}\x{{2029}}]*)\z"
ADDRESS = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d+)?"
GUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
_L, _R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
SIGNATURE_TOKENS = (
    (r"0x[0-9a-fA-F]+", "<ptr>"),
    (rf"{_L}[0-9A-F]{{8,}}{_R}", "<hex>"),
    (ADDRESS, "<addr>"),
    (GUID, "<guid>"),
    (rf"{_L}\d{{4}}-\d{{2}}-\d{{2}}{_R}", "<date>"),
    (rf"{_L}\d+{_R}", "<n>"),
)
COARSE_TOKENS = ((r"[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}", "<id>"), (rf"{_L}\d{{1,3}}(?:\.\d{{1,3}}){{3}}{_R}", "<ip>"), (r"\d+", "#"))
OBJECT = rf"{_L}([A-Za-z]{{3,}}(?:\.\d+){{1,4}}){_R}"
CAMERA = rf"(?iu)(?:камер[а-я]*|canal|канал[а-я]*|camera|channel|device|устройств[а-я]*){SPACE}*[#№:]?{SPACE}*(\d[A-Za-z0-9_.\-]*)"
TIME = r"\A\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d{1,3})?\z"
COMPONENT_WITHIN, SIGNATURE_LENGTH, SAMPLE_LENGTH, COARSE_LENGTH, ERROR_KEY_LENGTH, MESSAGE_LENGTH, ENTITIES = 80, 200, 500, 120, 100, 600, 6


def trim(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def replaced(x: Column, tokens) -> Column:
    for pattern, by in tokens:
        x = F.regexp_replace(x, pattern, by)
    return x


def group(x: Column, pattern: str, n: int) -> Column:
    """A group of the first match, null without a match."""
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, n))


def first_line(x: Column) -> Column:
    return F.substring_index(x, "\n", 1)


def _bracketed(rest: Column) -> tuple[Column, Column]:
    """Whether a text begins with a name in brackets, and where these end. Plain searches: every line is asked."""
    end = F.instr(rest, "]")
    return F.startswith(rest, F.lit("[")) & (end > 2), end


def component(rest: Column) -> Column:
    """`[X] message` gives X; else what stands before the first `: `, if that is near enough; an empty one is null."""
    at = F.instr(rest, ": ")
    before = F.nullif(trim(F.substring(rest, F.lit(1), at - 1)), F.lit(""))
    bracketed, end = _bracketed(rest)
    return F.when(bracketed, F.substring(rest, F.lit(2), end - 2)).when((at > 0) & (at <= COMPONENT_WITHIN + 1), before)


def message(rest: Column) -> Column:
    at = F.instr(rest, ": ")
    bracketed, end = _bracketed(rest)
    after = F.ltrim(F.substring(rest, end + 1, F.length(rest)), F.lit(SPACES))
    return F.when(bracketed, after).when((at > 0) & (at <= COMPONENT_WITHIN + 1), F.substring(rest, at + 2, F.length(rest))).otherwise(rest)


def address(msg: Column) -> Column:
    return F.nullif(F.regexp_extract(msg, f"({ADDRESS})", 1), F.lit(""))


def signature(level: Column, comp: Column, msg: Column) -> Column:
    line = first_line(msg)
    # most lines have neither `0x` nor `-`, which three of the patterns need; no token has them
    plain = ~(F.contains(line, F.lit("0x")) | F.contains(line, F.lit("-")))
    tokens = F.when(plain, replaced(line, [t for t in SIGNATURE_TOKENS if t[1] in ("<hex>", "<addr>", "<n>")])).otherwise(replaced(line, SIGNATURE_TOKENS))
    short = F.substring(trim(tokens), 1, SIGNATURE_LENGTH)
    return F.concat(F.coalesce(level, F.lit("null")), F.lit("|"), F.coalesce(comp, F.lit("")), F.lit("|"), short)


def sample(msg: Column) -> Column:
    return F.substring(first_line(msg), 1, SAMPLE_LENGTH)


def coarse_signature(msg: Column) -> Column:
    return F.lower(F.substring(replaced(msg, COARSE_TOKENS), 1, COARSE_LENGTH))


def error_key(msg: Column) -> Column:
    return F.substring(F.regexp_replace(msg, r"\d+", "#"), 1, ERROR_KEY_LENGTH)


def minute(ts: Column) -> Column:
    return F.substring(ts, 1, 16)


def entities(addr: Column, msg: Column, thread: Column) -> Column:
    """`kind:value` in the order address, GUIDs, objects, cameras, thread; distinct, the first few."""

    def marked(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.concat(F.lit(kind + ":"), v))  # what the patterns find has no white space around it

    def one(kind: str, value: Column) -> Column:
        return F.array_compact(F.array(F.when(trim(value) != "", F.concat(F.lit(kind + ":"), trim(value)))))

    guids = F.transform(F.regexp_extract_all(msg, F.lit(f"{_L}({GUID}){_R}")), F.lower)
    found = [one("address", addr), marked("object", guids), marked("object", F.regexp_extract_all(msg, F.lit(OBJECT))), marked("camera", F.regexp_extract_all(msg, F.lit(CAMERA))), one("thread", thread)]
    return F.slice(F.array_distinct(F.concat(*found)), 1, ENTITIES)


def entity_kind(entity: Column) -> Column:
    return F.substring_index(entity, ":", 1)


def entity_value(entity: Column) -> Column:
    return F.substring(entity, F.instr(entity, ":") + 1, F.length(entity))


def entity_label(entity: Column, names: dict[str, str]) -> Column:
    kind = entity_kind(entity)
    label = F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in names.items()), kind)
    return F.concat_ws(" ", label, entity_value(entity))


def service(file: Column) -> Column:
    short = F.regexp_replace(F.regexp_replace(file, r"(?i)\.log\z", ""), r"(?i)\AAPP_HOST\.", "")
    return F.when(short == "", file).otherwise(short)


def epoch_ms(ts: Column) -> Column:
    """Milliseconds of `date time` text in UTC; null where it isn't a time."""
    return F.when(ts.rlike(TIME), F.unix_millis(F.try_to_timestamp(ts)))


def time_text(ts: Column) -> Column:
    return F.substring(ts, F.instr(ts, " ") + 1, F.length(ts))


def timeline_message(msg: Column) -> Column:
    # most lines are ASCII with single blanks, and nothing is to be replaced in them
    odd = F.octet_length(msg) != F.length(msg)
    for c in ("  ", "\t", "\n", "\x0b", "\x0c", "\r"):
        odd = odd | F.contains(msg, F.lit(c))
    return F.substring(trim(F.when(odd, F.regexp_replace(msg, f"{SPACE}+", " ")).otherwise(msg)), 1, MESSAGE_LENGTH)


def level_class(level: Column) -> Column:
    """0 errors, 1 warnings, 2 the rest."""
    return F.when(level.isin("ERROR", "FATAL"), 0).when(level.isin("WARN", "WARNING"), 1).otherwise(2)


def level_name(level: Column) -> Column:
    return F.get(F.array(F.lit("ERROR"), F.lit("WARN"), F.lit("INFO")), level_class(level))


def integer_prefix(x: Column) -> Column:
    return F.regexp_extract(x, rf"\A{SPACE}*([+-]?\d+)", 1).try_cast("int")


def family(version: Column, current: str = "current", legacy: str = "legacy", unknown: str = "unknown") -> Column:
    """Major version 5 and up, 3 and 4, others."""
    major = integer_prefix(F.substring_index(version, ".", 1))
    return F.when(major >= 5, current).when(major.isin(3, 4), legacy).otherwise(unknown)


def rounded(x: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(x + 0.5)


def slug(title: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(title), r"[^a-z0-9а-я]+", "-"), r"\A-+|-+\z", ""), 1, 40)


def text_list(x: Column) -> Column:
    """Lines of a text, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(x, r"\r?\n"), trim), lambda v: v != "")


def clock(ms: Column, millis: bool = False) -> Column:
    return F.date_format(F.timestamp_millis(ms), "HH:mm:ss.SSS" if millis else "HH:mm:ss")


def bytes_text(n: Column) -> Column:
    """Whole bytes below 1024, one decimal above; nothing is 0 bytes."""
    power = F.when(n >= 1024, F.least(F.floor(F.log(n.cast("double")) / F.log(F.lit(1024.0)) + 1e-9), F.lit(4))).otherwise(0)
    unit = F.get(F.array(*(F.lit(u) for u in ("B", "KB", "MB", "GB", "TB"))), power.cast("int"))
    large = F.concat_ws(" ", F.format_string("%.1f", n / F.pow(F.lit(1024.0), power)), unit)
    return F.when(F.coalesce(n, F.lit(0)) == 0, "0 B").when(n < 1024, F.format_string("%.0f B", n.cast("double"))).otherwise(large)


def short_time(ts: Column, date: bool = False) -> Column:
    """Hours and minutes of a log time, with day and month if asked; a dash for none, and the text itself if it isn't a time."""
    at = F.try_to_timestamp(ts)
    return F.when(F.coalesce(ts, F.lit("")) == "", "\u2014").otherwise(F.coalesce(F.date_format(at, "dd.MM HH:mm" if date else "HH:mm"), ts))


def health_band(score: Column) -> Column:
    return F.when(score.isNull(), "muted").when(score >= 80, "good").when(score >= 50, "fair").otherwise("poor")


def source_kind(product: Column) -> Column:
    return F.when(F.lower(F.coalesce(product, F.lit(""))).startswith("jira"), "jira").otherwise("doc")


def solution_text(title: Column, steps: Column) -> Column:
    numbered = F.transform(steps, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
    return F.concat(title, F.lit("\n\n"), F.array_join(numbered, "\n"))


def lane_height(n: Column, most: Column, floor: float = 14.0) -> Column:
    """Percent of a lane, by logarithms."""
    return F.when(n > 0, F.greatest(F.lit(floor), F.log1p(n.cast("double")) / F.log1p(most.cast("double")) * 100)).otherwise(0.0)


def grams(x: Column, n: int = 3) -> Column:
    """The distinct runs of n characters of a text, in one pass over it."""
    chars = F.split(x, "", -1)
    chars = F.filter(chars, lambda c: c != "")
    runs = chars
    for k in range(1, n):
        runs = F.zip_with(F.slice(runs, F.lit(1), F.greatest(F.length(x) - k, F.lit(0))), F.slice(chars, F.lit(k + 1), F.length(x)), lambda a, b: F.concat(a, b))
    return F.array_distinct(runs)
