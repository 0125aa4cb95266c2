"""Benchmark decontamination with DataFrame functions alone.

The normalised word n-grams of the test items form a hash set. Every position
of a training text looks up the hash of its first two words in the set of such
hashes of the n-grams; where that answers yes, the whole n-gram is compared with
those of the items, so that hits are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spillway.llm.common import only, save, table, text_hash, text_of, without

NGRAM = 13
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words: ASCII but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Most distinct n-grams that go to every executor; about 25 MB. Beyond it both sides are shuffled.
MAX_BROADCAST = 200_000


def words_of(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A to Z."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), BETWEEN), lambda w: w != "")


def item_windows(benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """(window, size, items): each distinct n-gram, its number of words and the item_ids (as strings) that have it.

    An item of fewer than ``n`` words, but not none, is one window.
    """
    words = only(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item_id"), words_of(text_of()).alias("w"))
    words = words.where(F.size("w") > 0).withColumn("size", F.least(F.size("w"), F.lit(n)))
    starts = words.select("item_id", "w", "size", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("at"))
    windows = starts.select("item_id", "size", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("window"))
    return windows.groupBy("window", "size").agg(F.collect_set(F.coalesce("item_id", F.lit(""))).alias("items"))


def _anchor(window: Column) -> Column:
    """What a position must have as hash of its first two words (of its only word, if the window has one)."""
    parts = F.split(window, " ")
    return F.when(F.size(parts) > 1, F.xxhash64(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).otherwise(F.xxhash64(F.get(parts, F.lit(0))))


def _in_list(values: list[int]) -> str:
    return f"IN ({', '.join(f'{v}L' for v in values)})" if values else "IS NULL"


def window_hits(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text) and each of its hits: row, doc_id, n_words, at, size, items.

    ``at`` is the hit's first word, from 1. A row without hits comes once, with
    nulls. ``row`` numbers the rows, since doc_id may be null or repeated.
    """
    windows = item_windows(benchmark, n)
    known = windows.select("size", _anchor(F.col("window")).alias("anchor")).distinct()
    listed = known.limit(max_broadcast + 1).collect()  # bounded by max_broadcast
    fits = len(listed) <= max_broadcast and windows.limit(max_broadcast + 1).count() <= max_broadcast
    sizes = sorted(r["size"] for r in (known.select("size").distinct().collect()))
    if fits:
        windows = F.broadcast(windows)

    def starts(size: int) -> str:
        """SQL for the hit candidates of one window length: structs of position, length and n-gram."""
        pair = "xxhash64(get(words, i - 1), get(words, i))" if size > 1 else "xxhash64(get(words, i - 1))"
        test = f"{pair} {_in_list([r['anchor'] for r in listed if r['size'] == size])}" if fits else "true"
        positions = f"filter(if(n_words >= {size}, sequence(1, n_words - {size - 1}), array()), i -> {test})"
        return f"transform({positions}, i -> named_struct('at', i, 'size', {size}, 'window', array_join(slice(words, i, {size}), ' ')))"

    base = only(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(text_of()).alias("words"))
    base = base.withColumn("n_words", F.size("words"))
    found = f"concat({', '.join(starts(s) for s in sizes)})" if sizes else "cast(array() as array<struct<at:int,size:int,window:string>>)"
    hits = base.select("row", "doc_id", "n_words", F.explode_outer(F.expr(found)).alias("hit"))
    hits = hits.select("row", "doc_id", F.col("n_words").cast("long").alias("n_words"), "hit.at", "hit.size", "hit.window")
    return hits.join(windows.drop("size"), "window", "left").select("row", "doc_id", "n_words", "at", "size", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, one_in: int = 20, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    A word inside any occurrence of a window is hit; ``spans`` has the first and
    last word (from 1) of each run of hit words, as text `first-last`, comma-joined.
    contaminated: at least one of ``one_in`` words is hit. Null texts have no words;
    a null item_id counts as the empty string; null, empty or repeated items add
    nothing; an empty benchmark contaminates nothing. Further columns aren't read.
    """
    hits = window_hits(docs, benchmark, n, max_broadcast)
    hit = F.when(F.col("items").isNotNull(), F.struct(F.col("at").alias("a"), (F.col("at") + F.col("size") - 1).alias("b")))
    by_row = hits.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.collect_set(hit)).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("ids"))
    runs = F.expr("""aggregate(hits, cast(array() as array<struct<a:int,b:int>>), (runs, h) ->
        if(size(runs) > 0 and h.a <= element_at(runs, -1).b + 1,
           concat(slice(runs, 1, size(runs) - 1), array(named_struct('a', element_at(runs, -1).a, 'b', greatest(element_at(runs, -1).b, h.b)))),
           concat(runs, array(h))))""")
    by_row = by_row.withColumn("runs", runs)
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n_, r: n_ + r["b"] - r["a"] + 1)
    out = by_row.withColumn("n_hit", n_hit)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.lit(one_in) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.array_join(F.transform("runs", lambda r: F.concat_ws("-", r["a"], r["b"])), ",").alias("spans"),
        "row",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, one_in: int = 20) -> DataFrame:
    """``docs``, all columns, without the rows that are contaminated.

    Rows are told apart by doc_id and text, as equal ones are contaminated alike.
    """
    hashed = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("hash")).alias("doc_id"), "text")
    bad = contamination(hashed, benchmark, n, one_in).where("contaminated").select("doc_id.*")
    return without(docs, save(bad, "contaminated"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("row")


OP8_SQL = """
WITH low AS (SELECT row_number() OVER () AS r, doc_id,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 13) AS n FROM items WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
lens AS (SELECT DISTINCT n FROM wins),
pos AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM low, lens WHERE len(w) >= n),
hits AS (SELECT p.r, p.i, p.n, v.item_id FROM (SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM pos) p JOIN wins v ON p.win = v.win AND p.n = v.n),
spots AS (SELECT DISTINCT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM hits)),
per AS (SELECT r, count(*) AS n_hit FROM spots GROUP BY r),
ids AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS s FROM hits GROUP BY r),
edges AS (SELECT r, k, k - row_number() OVER (PARTITION BY r ORDER BY k) AS g FROM spots),
runs AS (SELECT r, min(k) AS a, max(k) AS b FROM edges GROUP BY r, g),
said AS (SELECT r, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM runs GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(spans, '') AS spans
FROM low LEFT JOIN per USING (r) LEFT JOIN ids USING (r) LEFT JOIN said USING (r)
"""
