"""Importance resampling of documents towards a target distribution of n-grams.

Documents and target texts become bags of hashed n-grams. A bucket's gain says
how much commoner it is in the target; a document's weight is the sum of its
n-grams' gains. Gumbel noise from a hash of its id turns the largest scores into
a weighted draw without replacement.

Words lie in a position table (``posexplode``). Following words come by ``lead``
windows over each document, in slices that overlap by what the longest n-gram
needs, so a document of any length fits; single words need no following ones,
so order 1 alone makes no window and shuffles no word. N-grams are summed by
bucket where they arise: 10,000 rows leave a task at most, and the gains, as many,
are broadcast. Ranks come from ranges of the scores and the rows before each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.windows import ranged
from .common import doc_text, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"

ORDERS, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024

#: Words of a slice of a document's positions.
SLICE = 4096


def words(text: str = "text") -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(1))


def features(texts: DataFrame, keep: list[str], orders: int = ORDERS, buckets: int = BUCKETS, length: int = SLICE) -> DataFrame:
    """``keep``, ``size`` and ``bucket`` of every run of 1 to ``orders`` words; a row with null size for a text without any."""
    if orders == 1:
        grams = texts.select(*keep, F.posexplode_outer(words()).alias("pos", "gram")).withColumn("size", F.when(F.col("gram").isNotNull(), 1))
    else:
        slices = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(length)), lambda i: F.slice("w", i + 1, length + orders - 1))
        parts = texts.select(*keep, F.monotonically_increasing_id().alias("__text"), words().alias("w")).select(*keep, "__text", F.posexplode(slices).alias("__slice", "part"))
        placed = parts.select(*keep, "__text", "__slice", F.posexplode_outer("part").alias("pos", "word"))
        of_text = Window.partitionBy("__text", "__slice").orderBy("pos")
        gram, runs = F.col("word"), []
        for k in range(1, orders + 1):
            runs.append(F.struct(F.lit(k).alias("size"), gram.alias("gram")))
            gram = F.concat(gram, F.lit(" "), F.lead("word", k).over(of_text))  # null at a text's end
        grams = placed.select(*keep, "pos", "word", F.array(*runs).alias("runs"))
        # Words beyond a slice's own length belong to the next one.
        grams = grams.where(f"pos < {length} OR pos IS NULL").select(*keep, "word", F.inline("runs")).where("gram IS NOT NULL OR word IS NULL AND size = 1")
        grams = grams.withColumn("size", F.when(F.col("gram").isNotNull(), F.col("size")))
    return grams.select(*keep, "size", (F.crc32(F.col("gram").cast("binary")) % buckets).alias("bucket"))


def _summed(texts: DataFrame, name: str, orders: int, buckets: int, length: int) -> DataFrame:
    return features(texts, [], orders, buckets, length).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias(name))


def gains(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, length: int = SLICE) -> DataFrame:
    """bucket and gain, one row for each bucket."""
    found = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    for texts, name in ((docs, "s"), (target, "t")):
        found = found.join(_summed(texts, name, orders, buckets, length), "bucket", "left").fillna(0, [name])
    every = Window.partitionBy()  # one row a bucket
    all_s, all_t = F.sum("s").over(every) + buckets, F.sum("t").over(every) + buckets
    ratio = ((F.col("t") + 1).cast("double") * all_s) / ((F.col("s") + 1).cast("double") * all_t)
    return found.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def noise(seed: int = SEED) -> Column:
    """1000 times a Gumbel variate from the id's hash, rounded down."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    orders: int = ORDERS,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
    length: int = SLICE,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every row of ``docs``, towards the texts of ``target``.

    Null and empty texts have no features and weight 0; all words of a text of
    any length count. Of the rows with ``least_words`` words, ``percent`` in a
    hundred are drawn, rounded down; equal scores by the smaller doc_id, then
    weight and number of features. Rows that share an id are rows of their own
    with one noise; those without one share the noise of an empty id and come
    last among equal scores. An empty table gives none, an empty target counts
    as no features; columns besides doc_id and text are ignored.
    """
    texts = doc_text(docs)
    wanted = target.select(F.col("text").cast("string").alias("text"))
    gain = stored(gains(texts, wanted, orders, buckets, length))
    found = features(texts.withColumn("__row", F.monotonically_increasing_id()), ["__row", "doc_id"], orders, buckets, length).join(F.broadcast(gain), "bucket", "left")
    each = found.groupBy("__row", "doc_id").agg(
        F.count("size").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"), F.count_if(F.col("size") == 1).alias("n_words")
    )
    scored = stored(each.select("doc_id", "n_features", "weight", (F.col("weight") + noise(seed)).alias("score"), (F.col("n_words") >= least_words).alias("enough")))
    first = [F.desc("enough"), F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features")]
    parts = ranged(scored, first)
    before, n, rows = [], 0, parts.where("enough").groupBy("__part").count().collect()
    for part, count in sorted(map(tuple, rows)):
        before.append((part, n))
        n += count
    ahead = F.broadcast(parts.sparkSession.createDataFrame(before, "__part int, __before long"))  # one row a part
    rank = F.col("__before") + F.row_number().over(Window.partitionBy("__part").orderBy(*first))
    rank = F.when(F.col("enough") & (rank <= percent * n // 100), rank)
    return parts.join(ahead, "__part", "left").select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def drawn(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose ids ``resample`` has drawn."""
    return docs.join(found.where("rank IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_semi").select(docs.columns)


#: The checksum is worked out byte by byte over a table that its polynomial gives, once for each distinct word.
SQL = rf"""
WITH c AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY b) AS crc
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b)
), d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word FROM d),
v AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM e)),
y AS (SELECT word, list_transform(range(0, len(x) // 2), lambda i: CAST(16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1 AS BIGINT)) AS bytes FROM v),
b AS (SELECT word, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, z: xor(a >> 8, crc[(xor(a, z) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM y, c),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN b USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM e JOIN b USING (word) GROUP BY bucket),
g AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM dw) + {BUCKETS})) / (CAST(s + 1 AS DOUBLE) * ((SELECT count(*) FROM e) + {BUCKETS})))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)
), f AS (SELECT doc_id, sum(gain) AS weight FROM dw JOIN b USING (word) JOIN g USING (bucket) GROUP BY doc_id),
h AS (SELECT doc_id, len(w) AS n, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || sha256('{SEED}:' || doc_id)[1:8] AS BIGINT) AS h FROM d LEFT JOIN f USING (doc_id)),
r AS (SELECT doc_id, n, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM h),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM r WHERE n >= {LEAST_WORDS})
SELECT r.doc_id, CAST(r.n AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= {PERCENT} * k.n // 100 THEN CAST(rank AS BIGINT) END AS rank
FROM r LEFT JOIN k USING (doc_id)
"""
