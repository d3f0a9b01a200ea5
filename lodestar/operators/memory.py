"""A log of notes: adding, recalling, updating, forgetting, and collecting what has expired.

memory(log_pos, id, kind, text, tags, file, line, source, importance, ttl_days, link,
created_at, updated_at, fingerprint): an append-only table of Parquet or JSON files. Every
function that depends on the time takes ``as_of`` in epoch seconds.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.checkpoints import cut
from lodestar.functions import text as T
from lodestar.shipping import bounded_batches, ship

SCHEMA = "id string, kind string, text string, tags array<string>, file string, line int, source string, importance int, ttl_days int, link string, created_at bigint, updated_at bigint, fingerprint string, format_version int"


def with_defaults(rows: DataFrame) -> DataFrame:
    """Rows of the log with missing fields filled in."""
    return rows.withColumns(
        {
            "kind": T.valid_kind("kind"),
            "text": F.coalesce("text", F.lit("")),
            "tags": F.coalesce("tags", T.strings()),
            "importance": F.least(F.greatest(F.coalesce("importance", F.lit(3)), F.lit(1)), F.lit(5)),
            "created_at": F.coalesce("created_at", F.lit(0)).cast("bigint"),
            "fingerprint": F.coalesce("fingerprint", T.fingerprint(F.coalesce("text", F.lit("")))),
        }
    )


def new_entries(rows: DataFrame, as_of: int, auto_kind: bool = True) -> DataFrame:
    """Rows (text, kind, tags, file, line, source, importance, ttl_days, link) made into entries."""
    kind = F.when(F.col("kind").isNull() & F.lit(auto_kind), T.autocategorize("text")).otherwise(T.valid_kind("kind"))
    text = F.trim("text")
    return rows.select(
        T.short_hash(F.concat(text, F.lit(str(as_of))), 12).alias("id"), kind.alias("kind"), text.alias("text"), F.array_sort(T.normalize_tags(F.coalesce("tags", T.strings()))).alias("tags"), "file", F.col("line").cast("int").alias("line"),
        F.coalesce("source", F.lit("cli")).alias("source"), F.least(F.greatest(F.coalesce("importance", F.lit(3)), F.lit(1)), F.lit(5)).cast("int").alias("importance"), F.col("ttl_days").cast("int").alias("ttl_days"), "link",
        F.lit(as_of).cast("bigint").alias("created_at"), F.lit(as_of).cast("bigint").alias("updated_at"), T.fingerprint(text).alias("fingerprint"), F.lit(1).alias("format_version"),
    )


def tail_duplicates(log: DataFrame, window: int = 200) -> DataFrame:
    """The log in order with ``duplicate``: whether an entry's fingerprint is among the ``window`` entries kept before it.

    What is kept depends on all earlier decisions, but only of one fingerprint's entries on
    each other and on how many others were kept between them. The fold over one log is in
    order by nature, so logs (column ``log``) are folded apart from each other, as a stream.
    """

    ship(log.sparkSession)
    schema = log.select("log", "log_pos", "fingerprint").schema.simpleString()[7:-1].replace(":", " ")
    ordered = log.select("log", "log_pos", "fingerprint").repartition("log").sortWithinPartitions("log", "log_pos")

    def stream(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by log: each log's state starts anew, and only the tail that matters is kept.
        at, last, kept = None, {}, 0
        for p in parts:
            out = []
            for name, fp in zip(p["log"], p["fingerprint"], strict=True):
                if name != at:
                    at, last, kept = name, {}, 0
                dup = fp in last and kept - last[fp] <= window
                if not dup:
                    last[fp] = kept
                    kept += 1
                    if len(last) > 4 * window:
                        last = {k: v for k, v in last.items() if kept - v <= window}
                out.append(dup)
            yield p.assign(duplicate=out)

    return ordered.mapInPandas(stream, f"{schema}, duplicate boolean")


def filters(rows: DataFrame, kind: str | None = None, tag: str | None = None, file: str | None = None) -> DataFrame:
    if kind:
        rows = rows.where(F.col("kind") == kind)
    if tag:
        rows = rows.where(F.array_contains("tags", tag))
    if file:
        rows = rows.where(F.col("file").contains(file))
    return rows


def matches(text: Column | str, query: str) -> Column:
    """Whether a text shares a word with the query; nothing matches an empty query."""
    words = list(dict.fromkeys(T.split_words_py(query)))
    return F.arrays_overlap(T.split_words(text), T.strings(*words)) if words else F.lit(False)


def recall(log: DataFrame, as_of: int, query: str | None = None, *, kind: str | None = None, tag: str | None = None, file: str | None = None, limit: int = 20) -> DataFrame:
    """Entries by relevance, recency and importance; by the last two alone without a query."""
    rows = filters(log, kind, tag, file)
    words = list(dict.fromkeys(T.split_words_py(query or "")))
    base = T.recency("created_at", as_of) + 0.5 * F.col("importance")
    if words:
        low = F.lower("text")
        # A word that overlaps or holds one of the query's has its letters in the text: others needn't be split.
        maybe = F.lit(False)
        for w in words:
            maybe = maybe | low.contains(w)
        rows = rows.where(maybe).withColumn("_words", T.split_words("text"))
        overlap = F.size(F.array_intersect("_words", T.strings(*words)))
        partial = sum((F.exists("_words", _holds(w)).cast("int") for w in words), F.lit(0))
        literal = sum((low.contains(w).cast("int") for w in words), F.lit(0))
        rows = rows.withColumns({"_o": overlap, "_p": F.when(overlap > 0, 0).otherwise(partial)}).where("_o > 0 OR _p > 0")
        base = base + 4.0 * F.col("_o") + 1.5 * F.col("_p") + literal + (3.0 if file else 0.0)
    rows = rows.withColumn("score", F.round(base, 6))
    return rows.orderBy(F.desc("score"), F.desc("created_at"), "log_pos").limit(limit).drop("_words", "_o", "_p")


def _holds(word: str):
    return lambda x: x.contains(word)


def ttl(kind: Column, own: Column) -> Column:
    """Days that an entry lives: its own, or its kind's; null for ever."""
    default = F.element_at(F.create_map(*(F.lit(x) for pair in T.TTL_DAYS.items() for x in pair)), kind)
    return F.coalesce(own, default)


def expired(as_of: int) -> Column:
    return F.coalesce((F.lit(as_of) - F.col("created_at")) > ttl(F.col("kind"), F.col("ttl_days")) * F.lit(86400).cast("bigint"), F.lit(False))


def gc_flags(log: DataFrame, as_of: int, hard_cap: int = 50_000, oldest_first: bool = False) -> DataFrame:
    """The log with ``fate``: expired, duplicate, evicted or kept; and kept entries' tags with their duplicates'.

    The first live entry of a fingerprint stays. Beyond the cap the least important go, the
    newest of them first (the oldest, on demand). Ranks are global, so the cap ranks only
    as many rows as it evicts.
    """
    # Fates are settled on a few columns, which are written once, and joined to the whole rows at the end.
    rows = cut(log.select("log_pos", "fingerprint", "tags", "importance", "created_at", expired(as_of).alias("expired")))
    # Groupings with partial aggregation, joined back: one fingerprint may have any number of rows.
    live = rows.where(~F.col("expired"))
    first = live.groupBy("fingerprint").agg(F.min("log_pos").alias("first"))
    tags = live.select("fingerprint", F.explode("tags").alias("tag")).distinct().groupBy("fingerprint").agg(F.array_sort(F.collect_list("tag")).alias("all_tags"))
    rows = rows.join(first.join(tags, "fingerprint", "left"), "fingerprint", "left")
    rows = rows.withColumn("fate", F.when(F.col("expired"), "expired").when(F.col("log_pos") != F.col("first"), "duplicate").otherwise("kept"))
    kept = rows.where("fate = 'kept'")
    over = kept.count() - hard_cap
    if over > 0:
        out = first_rows(kept, over, oldest_first).select("log_pos", F.lit(True).alias("out"))
        rows = rows.join(out, "log_pos", "left").withColumn("fate", F.when(F.col("out"), "evicted").otherwise(F.col("fate")))
    told = rows.select("log_pos", "fate", F.when(F.col("fate") == "kept", F.coalesce("all_tags", T.strings())).alias("merged"))
    out = log.join(told, "log_pos")
    return out.select(*(F.coalesce("merged", "tags").alias("tags") if c == "tags" else c for c in log.columns), "fate")


def first_rows(kept: DataFrame, n: int, oldest_first: bool) -> DataFrame:
    """The first n rows by importance, age and place: whole levels of importance and whole days by their counts, and of one day as many as are left."""
    day = F.floor(F.col("created_at") / 86400) * (1 if oldest_first else -1)
    rows = kept.withColumn("day", day)
    levels = sorted(rows.groupBy("importance").agg(F.count("*").alias("k")).collect(), key=lambda r: (r["importance"] is not None, r["importance"]))
    whole = F.lit(False)
    for r in levels:
        level = F.col("importance").eqNullSafe(F.lit(r["importance"]))
        if r["k"] > n:
            break
        whole, n = whole | level, n - r["k"]
    else:
        return rows.where(whole).drop("day")
    before = F.lit(False)
    for r in sorted(rows.where(level).groupBy("day").agg(F.count("*").alias("k")).collect(), key=lambda r: (r["day"] is not None, r["day"])):
        if r["k"] > n:
            break
        before, n = F.col("day").isNull() | (F.col("day") <= F.lit(r["day"])), n - r["k"]
    age = F.col("created_at") if oldest_first else F.desc("created_at")
    rest = rows.where(level & F.col("day").eqNullSafe(F.lit(r["day"]))).orderBy(age, "log_pos").limit(n)
    return rows.where(whole | level & before).unionByName(rest).drop("day")


def gc(log: DataFrame, as_of: int, **how) -> DataFrame:
    """The entries that stay."""
    return gc_flags(log, as_of, **how).where("fate = 'kept'").drop("fate")


def gc_report(log: DataFrame, as_of: int, **how) -> DataFrame:
    """One row: before, after, expired, deduped (with those evicted)."""
    fate = F.col("fate")
    return gc_flags(log, as_of, **how).agg(F.count("*").alias("before"), F.count_if(fate == "kept").alias("after"), F.count_if(fate == "expired").alias("expired"), F.count_if(fate.isin("duplicate", "evicted")).alias("deduped"))


def stats(log: DataFrame) -> DataFrame:
    """Entries of each kind, zero for those without, and a total."""
    kinds = log.sparkSession.createDataFrame([(k,) for k in T.KINDS], "kind string")
    counts = log.groupBy("kind").agg(F.count("*").alias("n"))
    each = kinds.join(counts, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return each.unionByName(log.agg(F.lit("total").alias("kind"), F.count("*").alias("n")).select("kind", "n"))


def get(log: DataFrame, entry_id: str) -> DataFrame:
    return log.where(F.col("id") == entry_id).orderBy("log_pos").limit(1)


def update(log: DataFrame, entry_id: str, as_of: int, **fields) -> DataFrame:
    """The log with an entry's fields changed; a new text gets its fingerprint."""
    allowed = {"kind", "text", "tags", "file", "line", "importance", "ttl_days", "link"}
    mine = F.col("id") == entry_id
    new: dict[str, Column] = {}
    for name, value in fields.items():
        if name not in allowed:
            raise ValueError(f"{name} can't be changed")
        kind = log.schema[name].dataType
        value = F.array_sort(T.normalize_tags(T.strings(*value))) if name == "tags" else F.lit(value).cast(kind)
        value = T.valid_kind(value) if name == "kind" else value
        new[name] = F.when(mine, value).otherwise(F.col(name))
    if "text" in fields:
        new["fingerprint"] = F.when(mine, T.fingerprint(F.lit(fields["text"]))).otherwise(F.col("fingerprint"))
    new["updated_at"] = F.when(mine, F.lit(as_of).cast("bigint")).otherwise(F.col("updated_at"))
    return log.withColumns(new)


def forget(log: DataFrame, entry_id: str) -> DataFrame:
    return log.where(~F.col("id").eqNullSafe(entry_id))


def forget_matching(log: DataFrame, query: str) -> DataFrame:
    return log.where(~matches("text", query))


def _sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, body) of rows (kind, line) in order: one row for each kind, without a second copy of its text."""

    def row(kind: str | None, text: bytearray) -> pa.RecordBatch:
        if len(text) >= 1 << 31:
            raise ValueError(f"a section of {len(text)} bytes is longer than a row can be")
        body = pa.StringArray.from_buffers(1, pa.py_buffer(struct.pack("<ii", 0, len(text))), pa.py_buffer(text))
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.string()), body], ["kind", "body"])

    at, text, begun, empty = None, bytearray(), False, True
    for b in batches:
        for kind, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if begun and kind != at:
                yield row(at, text)
                text, empty = bytearray(), True
            at, begun = kind, True
            if line is not None:
                text += line if empty else b"\n" + line
                empty = False
    if begun:
        yield row(at, text)


def markdown(log: DataFrame, as_of: int, kind: str | None = None, tag: str | None = None) -> DataFrame:
    """One row for each kind that has entries, in order: (section_ord, kind, body), newest entries first.

    Long sections stay rows of their own; write them with one file each, or join them on the driver.
    """
    rows = filters(log, kind, tag)
    where = F.when(F.col("file").isNotNull(), F.concat(F.lit(" · `"), F.col("file"), F.lit("@"), F.coalesce(F.col("line").cast("string"), F.lit("?")), F.lit("`"))).otherwise("")
    tags = F.when(F.size("tags") > 0, F.concat(F.lit(" "), F.array_join(F.transform("tags", lambda t: F.concat(F.lit("`#"), t, F.lit("`"))), " "))).otherwise("")
    line = F.concat(F.lit("- **"), F.substring("id", 1, 8), F.lit("** ("), T.time_ago("created_at", as_of), F.lit(")"), where, tags, F.lit("\n  "), F.col("text"))
    lines = rows.select("kind", (-F.col("created_at")).alias("o"), "log_pos", line.cast("binary").alias("line"))
    # Ranges are sorted by many tasks, and one, which makes the rows, takes them in order: it holds no more than the section it writes.
    ordered = lines.orderBy("kind", "o", "log_pos", "line").coalesce(1).select("kind", "line")
    ship(log.sparkSession)
    bounded_batches(log.sparkSession)
    body = ordered.mapInArrow(_sections, "kind string, body string")
    order = F.array_position(T.strings(*T.KINDS), F.col("kind"))
    return body.select(order.cast("int").alias("section_ord"), "kind", "body")


def footer(log: DataFrame, kind: str | None = None, tag: str | None = None) -> DataFrame:
    """The last row of a Markdown export: (section_ord, kind, body) with the number of entries."""
    total = filters(log, kind, tag).agg(F.count("*").alias("n"))
    return total.select(F.lit(len(T.KINDS) + 1).alias("section_ord"), F.lit("total").alias("kind"), F.concat(F.lit("---\n_Total: "), "n", F.lit(" entries._")).alias("body"))


def to_json(log: DataFrame) -> DataFrame:
    """(log_pos, json): every entry of the log, expired ones too."""
    return log.select("log_pos", F.to_json(F.struct(*(c for c in log.columns if c != "log_pos"))).alias("json"))


#: What an answer shows of an entry.
SHOWN = ("id", "kind", "text", "tags", "file", "line", "created_at", "importance")


def recall_with_files(log: DataFrame, as_of: int, query: str, found: DataFrame | None = None, limit: int = 10, **how) -> DataFrame:
    """One answer of notes and, where there is a query, of files: (source, place, id, score), each source by its own order."""
    notes = recall(log, as_of, query or None, limit=limit, **how)
    order = Window.orderBy(F.desc("score"), F.desc("created_at"), "log_pos")  # at most limit rows
    out = notes.select(F.lit("memory").alias("source"), F.row_number().over(order).alias("place"), F.col("id"), "score")
    if found is None or not query:
        return out
    files = found.limit(limit).select(F.lit("file").alias("source"), F.row_number().over(Window.orderBy(F.desc("score"), "path")).alias("place"), F.col("path").alias("id"), "score")
    return out.unionByName(files)


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The log from JSON lines; a line that is no JSON object is an error (or dropped, if not strict)."""
    rows = spark.read.schema(SCHEMA).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return with_defaults(rows).withColumn("log_pos", F.monotonically_increasing_id())


def count(spark: SparkSession, path: str) -> int:
    """Lines that aren't blank, unparsed."""
    return spark.read.text(path).where(F.trim("value") != "").count()


def append(entries: DataFrame, path: str) -> None:
    """New files beside the old ones: nothing is rewritten."""
    entries.write.mode("append").json(path)
