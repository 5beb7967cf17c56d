"""Benchmark decontamination with spaced seeds.

A mask such as 110111 reads only the positions marked 1 of a run of words, so
one substituted word on a 0 does not change the hash. Hashes of all masks at
all word positions of the documents meet those of the benchmark items. Around
each hit the words of document and item are compared one to one on that
alignment: a window of ``width`` words (the whole item, if shorter) must agree
in ``least`` of its words. Items shorter than ``width`` also have masks as long as
themselves, which ignore every set of substitutions that the window allows them; an item of
fewer than five words allows none, so its mask is the whole item.

DataFrame expressions only. A text is looked up in stretches of ``STRETCH``
places, and a hit carries only the words near it: Spark holds all that the
joins make of one row, so a task holds the hits of one stretch at a time,
however long the text is and however often an item stands in it. The items'
seeds, each with the words near it, are broadcast while their counted size is
below ``BROADCAST_BYTES``, so a document's words never leave their task. Beyond
it the places that pass a bitmap of the seeds are joined to them by a shuffle,
and the stretches that have hits are joined to these.

Words are maximal runs of letters and digits, in lower case. Null texts count
as empty, and an item without words is never found. Repeated documents and items are reported each by its id;
rows that repeat an id and a text give one row. Documents with the same id are
one document; a null id is an id. Empty tables give an empty table. Other columns of the inputs are not
carried, whatever their names.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolake.llm.filters import hash_filter, maybe_in
from hydrolake.sources.shared import materialize

#: 1: the word counts, 0: it is ignored.
MASKS = ("110111", "111011", "1101011")
#: Words of a window and the share of them that must agree.
WIDTH, LEAST = 13, 0.8
#: Seeds are broadcast while their counted size stays below this.
BROADCAST_BYTES = 64 << 20
#: Places of a text that are looked up together; a task holds their hits at a time.
STRETCH = 256


def with_words(df: DataFrame) -> DataFrame:
    """Add ``_words``; inline() keeps it computed once, where a filter on it would compute it again."""
    return df.select("*", F.inline(F.array(F.struct(word_hashes(F.col("text")).alias("_words"))))).drop("text")


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def whole_masks(n: int, least: float) -> list[str]:
    """Masks of length ``n`` of which one reads none of any n - ceil(n * least) positions."""
    free = n - ceil(n * least - 1e-9)
    if not free:
        return ["1" * n]
    # Positions are dealt to two groups more than there are substitutions; each mask ignores as many groups.
    return ["".join("0" if i % (free + 2) in out else "1" for i in range(n)) for out in combinations(range(free + 2), free)]


def numbered_masks(lengths: list[int], least: float) -> list[tuple[int, str]]:
    return [(1000 * length + k, m) for length in lengths for k, m in enumerate(whole_masks(length, least))]


def first_place(short: list[tuple[int, str]]) -> int:
    """The first place at which a mask fits: before the text if a whole item's mask ignores its first words."""
    return -max((m.index("1") for _, m in short), default=0)


def stretches(df: DataFrame, masks: tuple[str, ...], short: list[tuple[int, str]], width: int, stretch: int, *more: Column) -> DataFrame:
    """A row for each ``stretch`` places of the text: ``_words`` holds the words that masks and windows at these places
    can reach, and nothing else; in it the places are ``_low`` to ``_high``. ``more``: other columns of these rows.

    A text ends inside ``_words`` only where it really ends, so a stretch is treated like a text by itself.
    The lambda function keeps this from being compiled into one loop with what follows.
    """
    n, last = F.size("_words"), F.size("_words") - (1 if short else min(map(len, masks)))

    def one(a: Column) -> Column:
        begin = F.greatest(a - (width - 1), F.lit(0))
        end = F.least(a + (stretch + max(map(len, masks)) + width), n)
        words = F.slice("_words", begin + 1, end - begin)
        return F.struct(words.alias("_near"), (a - begin).alias("_low"), (F.least(a + (stretch - 1), last) - begin).alias("_high"))

    parts = F.transform(F.sequence(F.lit(first_place(short)), last, F.lit(stretch)), one)
    return df.select(*[c for c in df.columns if c != "_words"], F.inline(F.when(last >= 0, parts))).withColumnRenamed("_near", "_words")


def seeds(df: DataFrame, masks: tuple[str, ...], short: list[tuple[int, str]] = ()) -> DataFrame:
    """Rows (other columns, ``_words``, ``_at``, ``_seed``) of stretches: the hash of each mask at each place where it fits.

    The masks ``short`` are those of whole items. What they read must lie inside the words, what they
    ignore need not: words beyond the ends of a text count as substituted.
    """
    n, at = F.size("_words"), F.col("_at")
    places = df.withColumn("_at", F.explode(F.sequence("_low", "_high"))).drop("_low", "_high")

    def hashed(number: int, mask: str, inside: Column) -> Column:
        parts = [F.get("_words", at + i) for i, bit in enumerate(mask) if bit == "1"]
        return F.when(inside, F.xxhash64(F.lit(number), *parts))

    found = [hashed(k, m, (at >= 0) & (at + len(m) <= n) if short else at + len(m) <= n) for k, m in enumerate(masks)]
    found += [hashed(k, m, (at + m.index("1") >= 0) & (at + m.rindex("1") < n)) for k, m in short]
    return places.withColumn("_seed", F.explode(F.array(*found))).where(F.col("_seed").isNotNull())


def item_seeds(items: DataFrame, masks: tuple[str, ...], short: list[tuple[int, str]], width: int, stretch: int) -> DataFrame:
    """Seeds of the items; the masks ``short`` are read at the begin of items of their length only."""
    known = seeds(stretches(items, masks, [], width, stretch), masks)
    if not short:
        return known
    own = F.array(*[F.when(F.size("_words") == len(m), F.xxhash64(F.lit(k), *[F.get("_words", F.lit(i)) for i, bit in enumerate(m) if bit == "1"])) for k, m in short])
    whole = items.where(F.size("_words") < width).withColumn("_at", F.lit(0)).withColumn("_seed", F.explode(own)).where(F.col("_seed").isNotNull())
    return known.unionByName(whole)


def near(df: DataFrame, words: str, at: str, width: int, reach: int) -> DataFrame:
    """Leave of ``_words`` what a window around the seed at ``_at`` can hold, as ``words``; ``at``: the seed's place in it."""
    begin = F.greatest(F.col("_at") - (width - 1), F.lit(0))
    end = F.least(F.col("_at") + (reach + width - 1), F.size("_words"))
    others = [c for c in df.columns if c not in ("_words", "_at")]
    return df.select(*others, F.slice("_words", begin + 1, end - begin).alias(words), (F.col("_at") - begin).alias(at))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def agreement(doc: Column, item: Column, doc_at: Column, item_at: Column, span: Column) -> Column:
    """Most agreeing words in a window of ``span`` aligned words, of the words of document and item ``near`` the seed."""
    shift = doc_at - item_at
    low = F.greatest(-shift, F.lit(0))
    high = F.least(F.size(item), F.size(doc) - shift)
    # Running sums of agreement: the words before each place that agree.
    pairs = F.zip_with(F.slice(item, low + 1, high - low), F.slice(doc, low + shift + 1, high - low), lambda a, b: (a == b).cast("int"))
    sums = F.aggregate(pairs, F.array(F.lit(0)), lambda t, x: F.concat(t, F.array(F.element_at(t, -1) + x)))

    def best(sums: Column) -> Column:
        return F.array_max(F.transform(sums, lambda x, i: x - F.get(sums, F.greatest(i - span, F.lit(0)))))

    return bound(sums, best)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    masks: tuple[str, ...] = MASKS,
    width: int = WIDTH,
    least: float = LEAST,
    broadcast_bytes: int = BROADCAST_BYTES,
    stretch: int = STRETCH,
) -> DataFrame:
    """One row per document and item found in it: ``doc_id``, ``item_id``, ``n_hits`` (seed hits that were
    confirmed) and ``agreeing`` (words that agree in the best window)."""
    items = with_words(benchmark.select("item_id", "text")).distinct()
    # At most width - 1 lengths.
    lengths = sorted(r[0] for r in items.select(F.size("_words")).where(F.size("_words").between(1, width - 1)).distinct().collect())
    short = numbered_masks(lengths, least)
    reach = max(map(len, masks))
    # The window is shorter for an item that is shorter.
    items = items.withColumn("_span", F.least(F.lit(width), F.size("_words")))
    known = near(item_seeds(items, masks, short, width, stretch), "_item", "_item_at", width, reach)
    size = known.agg(F.coalesce(F.sum(F.size("_item") * 8 + 40), F.lit(0))).head()[0]
    parts = stretches(with_words(docs.select("doc_id", "text")), masks, short, width, stretch)
    if size <= broadcast_bytes:
        hits = seeds(parts, masks, short).join(F.broadcast(known), "_seed")
    else:
        # Rows of one id with different words meet their own words only; a row that repeats counts each time, as above.
        # inline() keeps the key computed once a stretch, where the places would compute it each.
        key = F.xxhash64("_low", "_words")
        parts = parts.select("*", F.inline(F.array(F.struct(key.alias("_part")))))
        thin = maybe_in(seeds(parts, masks, short).drop("_words"), "_seed", hash_filter(known, "_seed"))
        met = materialize(thin.join(known, "_seed"), "contamination-hits")
        texts = maybe_in(parts.select(F.col("doc_id").alias("_own"), F.col("_part").alias("_own_part"), "_words"), "_own_part", hash_filter(met, "_part")).distinct()
        hits = met.join(texts, met["doc_id"].eqNullSafe(F.col("_own")) & (met["_part"] == F.col("_own_part")))
    hits = near(hits.select("doc_id", "item_id", "_words", "_at", "_item", "_item_at", "_span"), "_doc", "_doc_at", width, reach)
    need = F.ceil(F.col("_span") * least - 1e-9)
    best = agreement(F.col("_doc"), F.col("_item"), F.col("_doc_at"), F.col("_item_at"), F.col("_span"))
    # Behind inline(), the check stays above the join; as its condition it would have every place write the words out.
    found = hits.select("doc_id", "item_id", F.inline(F.array(F.struct(need.alias("_need"), best.alias("agreeing"))))).where("agreeing >= _need")
    return found.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_hits"), F.max("agreeing").cast("long").alias("agreeing"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no benchmark item was found, all columns as they were."""
    name = max(["_found", *docs.columns], key=len) + "_"  # longer than any other, so no column of the table
    found = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col(name)), "left_anti")
