"""Spelling variants by a symmetric-delete join.

Every word emits itself and its distinct single deletions. Two words share a key if and only if one character was
inserted, deleted or replaced, or two characters at different places; the keys are joined by equality, and what remains
is verified for distance one. A key is a 64-bit hash of the deletion, computed for all deletions of a word from prefix
sums in time linear in its length, so a run of a million letters costs a million numbers and not their square. Equal
strings have equal hashes, so no pair is lost; different strings with one hash fall at the verification.

A word's form is its most frequent near word, if that is frequent enough; roots follow the forms by pointer doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm.staging import discard, replaced, staged

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse among 64-bit numbers
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Code points of words that are hashed at a time.
SLICE = 1 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, word, first, last) of every word and of its distinct deletions.

    ``word`` is the word's number in the list; ``first`` and ``last`` bound the places whose deletion gives this string
    (a run of one character), and are -1 for the word itself.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    starts, total = ends - sizes, len(points)
    values = _mixed(points + np.uint64(1))
    base = np.full(total + 1, _BASE, np.uint64)
    base[0] = 1
    power = np.cumprod(base, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[:total], dtype=np.uint64)])
    inverse = np.full(total + 1, _INVERSE, np.uint64)
    inverse[0] = 1
    back = np.cumprod(inverse, dtype=np.uint64)

    owner = np.repeat(np.arange(len(words)), sizes)
    begins = np.ones(total, bool)  # a deletion counts once for each run of one character
    begins[1:] = (points[1:] != points[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(begins)
    until = np.append(at, total)[1:] - 1
    word = owner[at]
    start, end = starts[word], ends[word]
    left = sums[at] - sums[start]
    right = (sums[end] - sums[at + 1]) * np.uint64(_INVERSE)
    own = (sums[ends] - sums[starts]) * back[starts]
    deleted = (left + right) * back[start]
    length = np.concatenate([sizes, sizes[word] - 1]).astype(np.uint64)
    key = _mixed(np.concatenate([own, deleted]) + length * np.uint64(0xD6E8FEB86659FD93))
    gone = np.full(len(words), -1)
    return key.view(np.int64), np.concatenate([np.arange(len(words)), word]), np.concatenate([gone, at - start]), np.concatenate([gone, until - start])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, word) -> (key, id, first, last)."""
    for batch in batches:
        ids, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        first = 0
        while first < len(words):
            upto, held = first, 0
            while upto < len(words) and (upto == first or held + len(words[upto]) <= SLICE):
                held += len(words[upto])
                upto += 1
            key, word, low, high = deletion_keys(words[first:upto])
            columns = [pa.array(key), pa.array(ids[first:upto][word]), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))]
            whole = pa.RecordBatch.from_arrays(columns, ["key", "id", "low", "high"])
            for i in range(0, len(whole), 1 << 16):
                yield whole.slice(i, 1 << 16)
            first = upto


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of the ids of ``words`` (id, word) at distance exactly one; each pair once.

    Words that share a deletion at the same place differ by one replaced character; a word that is a deletion of another
    by one inserted character. Others that share a key differ at two places: the places tell, so only candidates that
    can be near are emitted, and a key that many words share emits no more than their links.
    """
    keys = staged(words.select("id", "word").mapInArrow(_keys, "key bigint, id bigint, low int, high int"), "spell-keys")
    one, other = keys.alias("x"), keys.alias("y")
    replaced_one = F.col("x.low") <= F.col("y.high")
    same_place = (F.col("x.low") >= 0) & (F.col("y.low") >= 0) & replaced_one & (F.col("y.low") <= F.col("x.high"))
    inserted = (F.col("x.low") < 0) != (F.col("y.low") < 0)
    found = one.join(other, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (same_place | inserted))
    pairs = staged(found.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), "spell-pairs")
    discard(keys)
    text = words.select("id", "word")
    checked = pairs.join(text.select(F.col("id").alias("a"), F.col("word").alias("wa")), "a").join(text.select(F.col("id").alias("b"), F.col("word").alias("wb")), "b")
    out = staged(checked.where(F.levenshtein("wa", "wb", 1) == 1).select("a", "b"), "spell-near")
    return replaced(pairs, out)


def variant_groups(counts: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``counts`` (word, n), whose words are distinct.

    ``form`` is the near word of largest n (ties: the smallest in code-point order) if its n is at least ``ratio`` times
    the word's, else null; ``root`` is the end of the chain of forms, the word itself if it has none. A null word is left
    out, an empty word is near every word of one character, an empty table gives an empty result; other columns are left out.
    """
    words = staged(counts.where("word is not null").select("word", F.col("n").cast("long").alias("n")).withColumn("id", F.monotonically_increasing_id()), "spell-words")
    pairs = near_pairs(words)
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    best = F.min(F.struct((-F.col("n")).alias("less"), "word", F.col("id").alias("form_id")))
    near = both.join(words, both["b"] == words["id"]).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    near = replaced(pairs, staged(near.select("id", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.word").alias("form"), F.col("best.form_id").alias("form_id")), "spell-best"))
    known = words.join(near, "id", "left")
    follows = F.col("form_n") >= F.lit(ratio) * F.col("n")
    known = replaced(near, staged(known.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(follows, F.col(c)).alias(c) for c in ("form_n", "form", "form_id")]), "spell-known"))
    discard(words)
    roots = staged(known.where("form_id is not null").select("id", F.col("form_id").alias("root_id"), F.col("form").alias("root")), "spell-roots")
    while True:  # counts grow along the chain, so it has an end; each round doubles the steps taken
        onward = roots.select(F.col("id").alias("at"), F.col("root_id").alias("next_id"), F.col("root").alias("next"))
        stepped = roots.join(onward, roots["root_id"] == onward["at"], "left")
        moved = staged(stepped.select("id", F.coalesce("next_id", "root_id").alias("root_id"), F.coalesce("next", "root").alias("root"), F.col("next_id").isNotNull().alias("moved")), "spell-roots")
        roots = replaced(roots, moved)
        if roots.where("moved").isEmpty():
            break
    out = known.join(roots.select("id", "root"), "id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def lowered(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of at least seven code points that occur twice, of all documents, where the row's checksum has deleted some letters."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    run = F.explode(F.regexp_extract_all(lowered(F.coalesce("text", F.lit(""))), F.lit(r"[A-Za-zÀ-ÿ]+"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), run.alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "doc", "run").cast("binary")))
    place = (F.col("h") % F.length("run")).cast("int")
    damaged = F.concat(F.col("run").substr(F.lit(1), place), F.col("run").substr(place + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % 31 == 0, damaged).otherwise(F.col("run")).alias("word"))
    counts = words.where(F.length("word") >= 7).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return variant_groups(counts)


def _crc_steps() -> list[int]:
    """The checksum's register after four bits, by its lowest four."""
    out = range(16)
    for _ in range(4):
        out = [(c >> 1) ^ (0xEDB88320 if c & 1 else 0) for c in out]
    return list(out)


ORACLE = rf"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' AS doc, unnest(regexp_extract_all(
    translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
once AS (SELECT doc, run, hex(doc || run) AS x, count(*) AS n FROM runs GROUP BY ALL),
nibbles AS (SELECT run, n, list_transform(range(length(x)), lambda i: instr('123456789ABCDEF', substr(x, xor(i, 1) + 1, 1))::BIGINT) AS l FROM once),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, l),
    lambda c, b: xor(c >> 4, list_extract({_crc_steps()}::BIGINT[], (xor(c, b) & 15) + 1))), 4294967295) AS h FROM nibbles),
damaged AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM places),
near AS (SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
         UNION SELECT a.word, c.word, c.n FROM words a JOIN cuts c ON a.word = c.k
         UNION SELECT c.word, a.word, a.n FROM words a JOIN cuts c ON a.word = c.k),
best AS (SELECT word, count(*) AS n_near, min({{'less': -n, 'other': other}}) AS b FROM near GROUP BY word),
known AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, b.other AS form, -b.less AS form_n
          FROM words LEFT JOIN best USING (word)),
forms AS (SELECT word, form FROM known WHERE form_n >= 10 * n),
chain AS (SELECT word, form AS root FROM forms UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON chain.root = forms.word),
ends AS (SELECT word, root FROM chain ANTI JOIN forms ON chain.root = forms.word)
SELECT known.word, forms.form, coalesce(ends.root, known.word) AS root, n, n_near,
       CASE WHEN forms.form IS NOT NULL THEN form_n END AS form_n
FROM known LEFT JOIN forms USING (word) LEFT JOIN ends USING (word)
"""
