"""Text and hash functions as columns: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no weight in searches, and the patterns of words.
STOPWORDS = tuple(
    """
    a an and are as at be by for from has have in is it its of on or that the
    this to was were will with not no but do does did done if then else when
    while return none true false self cls init new null undefined let const var
    def class import from export function async await using include pragma
    sizeof typeof int float double bool char string void public private
    protected static final override virtual
    """.split()
)
TOKEN = "[A-Za-z0-9_]{2,40}"
WORD = "[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])|[a-z0-9]+"

# Phrases that tell a note's kind, in order of precedence.
KIND_HINTS = {
    "decision": ("we decided", "decided to", "decision", "we chose", "chosen", "agreed on", "design decision", "will use", "we use", "we will"),
    "gotcha": ("gotcha", "got bitten", "got burned", "watch out", "beware", "pitfall", "careful", "breaks", "breaks if", "surprising", "gotcha:", "trick", "got stuck", "does not work", "doesn't work", "failed", "failure"),
    "api": ("signature", "takes", "returns", "params", "parameter", "endpoint", "api", "sdk", "function", "method", "interface", "argument", "callback", "response", "payload", "headers", "auth", "token"),
    "convention": ("convention", "style", "naming", "format", "pattern", "consistent", "always", "usually", "normally", "standard"),
    "task": ("todo", "to do", "follow-up", "follow up", "later", "next step", "fix", "bpf", "need to", "should", "must", "remember to"),
    "tip": ("tip", "faster", "better", "instead", "recommend", "try", "use this", "pro tip", "simpler", "cleaner", "workaround"),
}
KINDS = ("decision", "gotcha", "tip", "api", "convention", "task", "note")
TTL_DAYS = {"task": 30, "tip": 365, "gotcha": 730, "decision": 730, "api": 730, "convention": 730}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strings(*values: str) -> Column:
    return F.array(*map(F.lit, values)) if values else F.expr("cast(array() as array<string>)")


def split_words(text: Column | str) -> Column:
    """Lower-case words of identifiers and prose, stopwords dropped, duplicates and order kept."""
    runs = F.regexp_extract_all(col(text), F.lit(TOKEN), F.lit(0))
    words = F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(WORD), F.lit(0))))
    return F.filter(F.transform(words, F.lower), lambda w: ~w.isin(*STOPWORDS))


def split_words_py(text: str) -> list[str]:
    """split_words of a query, on the driver."""
    import re

    return [w for r in re.findall(TOKEN, text) for w in (p.lower() for p in re.findall(WORD, r)) if w not in STOPWORDS]


def char_ngrams(words: Column | str, n: int) -> Column:
    """Character n-grams of words joined together; short ones are padded with spaces."""
    return F.when(F.size(col(words)) == 0, strings()).otherwise(grams_of_text(F.rpad(F.array_join(col(words), ""), F.greatest(F.length(F.array_join(col(words), "")), F.lit(n)), F.lit(" ")), n))


def grams_of_text(text: Column | str, n: int) -> Column:
    """Character n-grams of a text, none of a shorter one: in one pass, as to cut each out by its place would walk to it from the start."""
    return F.regexp_extract_all(col(text), F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def gram_pieces(text: Column | str, n: int, size: int = 64) -> Column:
    """Overlapping pieces of a text that hold each of its n-grams once, so that no row holds all grams of a long text."""
    return F.regexp_extract_all(col(text), F.lit(f"(?s)(?=(.{{1,{size + n - 1}}})).{{1,{size}}}"), F.lit(1))


def short_hash(text: Column | str, length: int = 8) -> Column:
    return F.substring(F.sha1(col(text)), 1, length)


def fingerprint(text: Column | str) -> Column:
    """A signature of a text's bag of words; of the text itself where it has none."""
    # The first of the two that isn't empty: a condition would have the words split twice.
    told = F.filter(F.array(F.array_join(F.sort_array(split_words(text)), "\x01"), col(text)), lambda x: x != "")
    return F.when(col(text).isNotNull(), short_hash(F.coalesce(F.get(told, F.lit(0)), F.lit("")), 16))


def estimate_tokens(text: Column | str) -> Column:
    runs = F.size(F.regexp_extract_all(col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    return F.greatest(F.lit(1), F.floor(F.length(col(text)) / 4) + F.floor(runs / 3)).cast("bigint")


def line_count(text: Column | str) -> Column:
    t = col(text)
    breaks = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return (breaks + F.when((F.length(t) > 0) & ~t.endswith("\n"), 1).otherwise(0)).cast("bigint")


def truncate(text: Column | str, width: int) -> Column:
    return F.when(F.length(col(text)) > width, F.concat(F.substring(col(text), 1, width - 1), F.lit("…"))).otherwise(col(text))


def first_line(text: Column | str) -> Column:
    return F.trim(F.substring_index(F.trim(col(text)), "\n", 1))


def human_bytes(n: Column | str) -> Column:
    n = col(n)
    sized = F.when(n < 1024, F.format_string("%d B", n))
    for power, unit in ((1, "KB"), (2, "MB")):
        sized = sized.when(n < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", F.bround(n / 1024**power, 1)))
    return sized.otherwise(F.format_string("%.1f GB", F.bround(n / 1024**3, 1)))


def human_count(n: Column | str) -> Column:
    return F.format_number(col(n), 0)


def time_ago(ts: Column | str, as_of: int) -> Column:
    """How long before as_of (epoch seconds) a time was; its date from 30 days on."""
    ts = col(ts)
    age = F.greatest(F.lit(as_of) - ts, F.lit(0))
    return (
        F.when(age < 60, "just now")
        .when(age < 3600, F.format_string("%dm ago", F.floor(age / 60)))
        .when(age < 86400, F.format_string("%dh ago", F.floor(age / 3600)))
        .when(age < 30 * 86400, F.format_string("%dd ago", F.floor(age / 86400)))
        .otherwise(F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd"))
    )


def safe_name(text: Column | str) -> Column:
    return F.regexp_replace(col(text), "[^A-Za-z0-9_.:/-]", "_")


def stable_key(*parts: Column | str) -> Column:
    return F.concat_ws("::", *map(col, parts))


def parse_int_or(text: Column | str, default: int) -> Column:
    return F.coalesce(F.trim(col(text)).try_cast("int"), F.lit(default))


def iso(ts: Column | str) -> Column:
    return F.date_format(F.timestamp_seconds(col(ts)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def repo_relative(path: Column | str, root: str) -> Column:
    p = F.replace(col(path), F.lit("\\"), F.lit("/"))
    root = root.rstrip("/") + "/"
    return F.when(p.startswith(root), F.substr(p, F.lit(len(root) + 1))).otherwise(p)


def unsafe_path(path: Column | str) -> Column:
    """Absolute, or with a .. segment."""
    p = F.replace(col(path), F.lit("\\"), F.lit("/"))
    return p.startswith("/") | p.rlike("^[A-Za-z]:") | F.array_contains(F.split(p, "/"), "..")


def natural_key(text: Column | str) -> Column:
    """A key that sorts runs of digits by their number: each is written with its length before it."""
    parts = F.regexp_extract_all(F.lower(col(text)), F.lit("[0-9]+|[^0-9]+"), F.lit(0))

    def one(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 4, "0"), digits)).otherwise(p)

    return F.array_join(F.transform(parts, one), "")


def autocategorize(text: Column | str) -> Column:
    """The kind whose hint a text holds, in the order of KIND_HINTS; else note."""
    low, out = F.lower(col(text)), None
    for kind, hints in KIND_HINTS.items():
        hit = F.lit(False)
        for h in hints:
            hit = hit | low.contains(h)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("note")


def normalize_tags(tags: Column | str) -> Column:
    """Distinct lower-case tags of at most 40 characters, in order of their first mention."""
    pieces = F.flatten(F.transform(col(tags), lambda t: F.split(F.lower(t), r"[,\s]+")))
    return F.array_distinct(F.filter(pieces, lambda p: (F.length(p) > 0) & (F.length(p) <= 40)))


def valid_kind(kind: Column | str) -> Column:
    return F.when(col(kind).isin(*KINDS), col(kind)).otherwise("note")


def recency(created: Column | str, as_of: int) -> Column:
    return 6.0 / (1.0 + F.greatest(F.lit(as_of) - col(created), F.lit(0)) / 3600.0 / 24.0)
