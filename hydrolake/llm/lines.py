"""Line deduplication: repeated passages of lines go, the first copy stays.

A rolling hash over the hashes of ``WINDOW`` neighbouring lines that are not blank is
taken at every line. Windows whose hash occurs more than once anywhere are
compared byte by byte; of equal windows the first, by doc_id and place, stays. The
others, joined where they overlap, are the chunks to remove: a chunk begins and ends
where the text stops being a copy, so its boundaries depend on the repeated lines alone and
not on what stands around them. A line of more than ``LONG`` words is a window by itself.
(Boundaries that one line's hash decides leave passages without a whole chunk.)

DataFrame expressions only. Window hashes are counted with a map-side combine;
only windows that pass a bitmap of repeated hashes (2 MB, whatever the input)
send their text to another machine, and equal texts are combined before. Joins back to the occurrences carry
one row per text on one side, so a hot text is a skewed join that Spark splits.

The first copy of any line stays: no window with it can have stood earlier. Null texts stay
null and hold no lines. Rows with the same doc_id and text count as one document and are
treated alike; a null doc_id comes before all others. Blank lines (empty, or spaces only) are
in no window; they go with the lines around them where a removed window spans them. An empty
table gives an empty table. Columns named like a result column are replaced; others pass
through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolake.llm.filters import hash_filter, maybe_in
from hydrolake.sources.shared import materialize

#: Lines that the rolling hash sees, and words beyond which a line is a passage by itself.
WINDOW, LONG = 2, 50
#: Words of a line.
WORD = r"[^\x20\x09-\x0D]+"

KEY = ("_id", "_text_hash")


def place() -> Column:
    """Where a window stands, in the order that decides which copy stays."""
    return F.struct(*KEY, "_k")


def keyed(docs: DataFrame) -> DataFrame:
    """The text with a key that tells documents apart even where doc_id is null or repeats; column i of the input is ``_c<i>``."""
    own = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    identity = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    return docs.select(*own, identity.alias("_id"), F.xxhash64("text").alias("_text_hash"), F.col("text").alias("_text"))


def is_long(line: Column) -> Column:
    return F.when(F.length(line) > 2 * LONG, F.regexp_count(line, F.lit(WORD)) > LONG).otherwise(False)


def windows(df: DataFrame) -> DataFrame:
    """One row per window: the key, its number ``_k``, its hash ``_h``, its text ``_chunk`` and its lines ``_from`` to ``_to`` (from 1)."""
    lines = F.transform(F.split("_text", "\n", -1), lambda x, i: F.struct((i + 1).alias("at"), x.alias("line"), F.xxhash64(x).alias("h")))
    full = F.filter(lines, lambda x: F.trim(x["line"]) != "")
    # inline() keeps the array computed once: the optimizer does not copy expressions through it.
    listed = df.where(F.col("_text").isNotNull()).select(*KEY, F.inline(F.array(F.struct(full.alias("_full")))))

    def window(k: Column, size: int) -> Column:
        seen = [F.get("_full", k + ahead) for ahead in range(size)]
        return F.struct(
            k.alias("_k"),
            F.xxhash64(*[x["h"] for x in seen], F.lit(size)).alias("_h"),
            F.concat_ws("\n", *[x["line"] for x in seen]).alias("_chunk"),
            seen[0]["at"].alias("_from"),
            seen[-1]["at"].alias("_to"),
        )

    several = F.transform(F.slice("_full", 1, F.greatest(F.size("_full") - (WINDOW - 1), F.lit(0))), lambda x, k: window(k, WINDOW))
    single = F.filter(F.transform("_full", lambda x, k: F.when(is_long(x["line"]), window(k, 1))), lambda x: x.isNotNull())
    return listed.select(*KEY, F.inline(F.concat(several, single)))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Lines to remove: the document's key and the array ``_gone`` of line numbers (from 1, some more than once)."""
    found = windows(docs)
    # Rows that repeat with their id are counted too; the places below sort them out.
    twice = found.groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1")
    suspects = materialize(maybe_in(found, "_h", hash_filter(twice, "_h")), "window-suspects")
    # Stored, so that the join below shuffles both sides itself and Spark can split a hot text.
    firsts = suspects.groupBy("_h", "_chunk").agg(F.min(place()).alias("_first"), F.max(place()).alias("_last")).where("_first < _last")
    firsts = materialize(firsts.drop("_last"), "window-firsts")
    again = suspects.join(firsts, ["_h", "_chunk"]).where(place() > F.col("_first"))
    return again.groupBy(*KEY).agg(F.flatten(F.collect_set(F.sequence("_from", "_to"))).alias("_gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All documents, ``text`` without repeated passages, with ``n_lines`` before and ``n_removed`` lines gone.

    A text that loses all its lines becomes empty. ``n_chars``, if there is
    such a column, is counted anew where lines went.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    base = keyed(docs.select(*columns))
    own = [f"_c{i}" for i in range(len(columns))]
    joined = base.join(repeated_lines(base), list(KEY), "left")
    # Only texts that lose something are cut again; for the others all of this is null.
    lines = F.split(F.when(F.col("_gone").isNotNull(), F.col("_text")), "\n", -1)
    cut = joined.select(*own, "_text", "_gone", F.inline(F.array(F.struct(lines.alias("_lines")))))
    kept = F.transform(F.array_except(F.sequence(F.lit(1), F.size("_lines")), "_gone"), lambda i: F.get("_lines", i - 1))
    left = cut.select(*own, "_text", F.size("_lines").alias("_before"), F.inline(F.array(F.struct(kept.alias("_kept")))))
    new = F.array_join("_kept", "\n")
    out = {"text": F.coalesce(new, "_text")}
    if "n_chars" in columns:
        out["n_chars"] = F.coalesce(F.length(new).cast(docs.schema["n_chars"].dataType), F.col(own[columns.index("n_chars")]))
    all_lines = F.coalesce(F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    return left.select(
        *[out.get(c, F.col(o)).alias(c) for c, o in zip(columns, own)],
        all_lines.alias("n_lines"),
        F.when(F.col("_kept").isNotNull(), F.col("_before") - F.size("_kept")).otherwise(0).cast("long").alias("n_removed"),
    )
